"""Exact copies by deterministic block naming.

A text is cut into blocks of ``BLOCK`` bytes.  Blocks are sorted and equal blocks get
one integer name, the smallest occurrence number among them.  Then the names of
adjacent blocks are paired and every distinct pair is named the same way, halving the
number of names per text each round, until every text has one name.  Two texts of as
many blocks share it exactly when they are identical: no hash decides.

Only built-in expressions run.  The text is shuffled once; hot blocks are dealt to
several tasks first and their few local names are united afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gsx.llm.row_numbers import NumberedRows
from gsx.session import settle

BLOCK = 2048
#: Blocks are counted in so many hash buckets to find those that must be split.
BUCKETS = 65536
#: A bucket of more than this many blocks, and of more than four mean buckets, is split.
SPLIT = 1000


def _blocks(docs: DataFrame, doc_id: str, text: str, number: str | None) -> DataFrame:
    """One row per block; the first block of a text carries its id and digest."""
    rid = F.monotonically_increasing_id() if number is None else F.col(number)
    raw = docs.select(
        rid.alias("rid"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )
    count = F.greatest(F.ceil(F.octet_length("raw") / BLOCK), F.lit(1)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.substring(F.col("raw"), i * BLOCK + 1, F.lit(BLOCK)),
    )
    # the digest is taken below the explode, once per text
    digested = raw.withColumns({"sha": F.sha2("raw", 256), "n": count})
    rows = digested.select("rid", "doc_id", "sha", "n", F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    return rows.select(
        "rid",
        "pos",
        "n",
        "block",
        F.monotonically_increasing_id().alias("u"),
        F.when(first, F.struct("doc_id", "sha")).alias("info"),
    )


def _bucket(block) -> F.Column:
    return F.pmod(F.xxhash64(block), F.lit(BUCKETS)).cast("int")


def _split_table(blocks: DataFrame) -> DataFrame:
    """(bucket, parts) of the crowded buckets: at most BUCKETS / 4 rows."""
    counts = blocks.groupBy(_bucket("block").alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    counts = settle(counts)
    total = counts.agg(F.sum("c")).first()[0] or 0
    limit = max(SPLIT, 4 * total // BUCKETS)
    return counts.filter(F.col("c") > limit).select(
        "bucket", F.ceil(F.col("c") / limit).cast("int").alias("parts")
    )


def _name_blocks(docs: DataFrame, doc_id: str, text: str, number: str | None) -> DataFrame:
    """(rid, pos, n, u, info, name), settled."""
    blocks = _blocks(docs, doc_id, text, number)
    parts = _split_table(blocks)
    dealt = (
        blocks.withColumn("bucket", _bucket("block"))
        .join(F.broadcast(parts), "bucket", "left")
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")), F.lit(0)))
    )
    own = F.min("u").over(Window.partitionBy("block", "part"))
    local = settle(
        dealt.withColumn("name", own).select(
            "rid",
            "pos",
            "n",
            "u",
            "info",
            "name",
            # one occurrence of every split block goes on to the second step
            F.when(F.col("parts").isNotNull() & (F.col("u") == F.col("name")), F.col("block")).alias(
                "again"
            ),
        )
    )
    united = local.filter(F.col("again").isNotNull()).select(
        "name", F.min("name").over(Window.partitionBy("again")).alias("low")
    )
    return local.drop("again").join(united, "name", "left").select(
        "rid", "pos", "n", "u", "info", F.coalesce("low", "name").alias("name")
    )


def _pair_up(names: DataFrame) -> DataFrame:
    """Adjacent names become one; ``n`` counts what is left of a text."""
    even = F.pmod(F.col("pos"), F.lit(2)) == 0
    pairs = names.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.ceil(F.max("n") / 2).cast("int").alias("n"),
        F.min("u").alias("u"),
        F.max("info").alias("info"),
        F.max(F.when(even, F.col("name"))).alias("l"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"),
    )
    named = pairs.groupBy("l", "r").agg(F.min("u").alias("name"))
    return pairs.join(named, ["l", "r"]).select("rid", "pos", "n", "u", "info", "name")


def text_names(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", number: str | None = None
) -> DataFrame:
    """(rid, doc_id, sha, rounds, name) per row; equal (rounds, name) means equal text.

    ``rid`` is the column ``number`` where one is named.
    """
    names = settle(_name_blocks(docs, doc_id, text, number))
    most = names.agg(F.max("n")).first()[0] or 1
    done = [names.filter("n = 1").withColumn("rounds", F.lit(0))]
    rest, rounds = names.filter("n > 1"), 0
    while most > 1:
        rounds += 1
        most = (most + 1) // 2
        named = settle(_pair_up(rest))
        done.append(named.filter("n = 1").withColumn("rounds", F.lit(rounds)))
        rest = named.filter("n > 1")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("rid", "info.doc_id", "info.sha", "rounds", "name")


def copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts stays.  NULL text is the
    empty text.  Rows that repeat an id with one text are separate rows of one group, of
    which one stays; a NULL id is smaller than any other and gives keep_id NULL only if
    the whole group has none.  Other columns are ignored; an empty table gives no rows.
    """
    return _groups(text_names(docs, doc_id, text)).drop("rid")


def _groups(names: DataFrame) -> DataFrame:
    groups = names.groupBy("rounds", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size")
    )
    return names.join(groups, ["rounds", "name"]).select(
        "rid",
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("top.rid") == F.col("rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns are kept.

    The row that stays is that of :func:`copy_groups`.
    """
    table = NumberedRows(docs)
    groups = _groups(text_names(table.rows, doc_id, text, table.name))
    return table.without(groups.filter(~F.col("kept")).select("rid"))


def text_digest(text) -> F.Column:
    """sha256 of a text, NULL being empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)

