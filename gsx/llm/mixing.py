"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a seeded hash order; sources whose target exceeds their size
queue again.  A document's virtual finish time is the words of its source up to and including it,
divided by the source's target.  All queues together are sorted by finish time, and the line is
cut where its running total reaches the budget: what a source gives is decided there alone.
A document longer than a quantum queues in pieces with finish times of their own, so that a very
long one is not served or left as a whole.

Only built-in expressions run.  No source is sorted in one task: running sums add the
totals of smaller hash buckets, or of earlier ranges, to a window inside the own one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gsx.functions.hashing import hash_key
from gsx.llm.texts import unused_name
from gsx.operators.ordered import global_positions, null_safe_join
from gsx.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words that are served at once; what a source gives differs from its target by little more.
QUANTUM = 128
#: Rows of one hash bucket, the unit that one task sorts.
BUCKET_ROWS = 4_000


def word_count(text) -> F.Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lined_up(rows: DataFrame, order: list, values: list[str]) -> DataFrame:
    """``rows`` with the sums of ``values`` over all rows before each one in ``order``, as ``<value>_ahead``.

    Rows are sorted in ranges; a range adds the totals of the ranges before it.
    """
    ranged = settle(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # one row per range
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({f"{v}_ahead": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = summed.join(F.broadcast(offsets), "_pid")
    return joined.withColumns({f"{v}_ahead": F.col(f"{v}_ahead") + F.col(f"_o_{v}") for v in values}).drop(
        "_pid", *[f"_o_{v}" for v in values]
    )


def source_targets(
    sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Weights repeat over the sources in code point order, NULL last.  ``share`` of all
    words is dealt by weight; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight until no target is above its stop.

    Sources stop in the order of stop / weight.  The first one that the rest of the budget, dealt
    by weight to it and those after it, does not stop gives the level of all that stay open.
    """
    order = global_positions(sources, [F.col("source").asc_nulls_last()], "sid")
    deal = F.array(*[F.lit(float(w)) for w in weights])
    weighed = order.withColumns(
        {
            "weight": F.get(deal, ((F.col("sid") - 1) % len(weights)).cast("int")),
            "stop": F.col("source_size") * F.lit(float(most)),
        }
    )
    ratio = F.try_divide("stop", "weight")
    line = lined_up(weighed.withColumn("ratio", ratio), [F.col("ratio"), F.col("sid")], ["stop", "weight"])
    size, weight = line.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit((size or 0) * float(share)) - F.col("stop_ahead")
    levels = line.withColumn("level", F.try_divide(left, F.lit(float(weight or 0)) - F.col("weight_ahead")))
    level = levels.filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", "sid"))).first()[0]
    target = F.col("stop") if level is None else F.least(F.col("weight") * level, F.col("stop"))
    return line.withColumn("target", target).select(*sources.columns, "sid", "weight", "target")


def queue(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 42,
) -> DataFrame:
    """One row per document with its source's target and the words queued before it.

    rid, doc_id, source, size, place (its seeded hash), sid (number of the source),
    source_size, target, before.  Equal places keep the order of rid.
    """
    sized = settle(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(text).alias("size"),
            hash_key(seed, doc_id).alias("place"),
        )
    )
    per = settle(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("c"))
    )
    targets = source_targets(per, weights, share, most).withColumn(
        # hex digits of the hash that cut a source into buckets of bounded size
        "digits", F.greatest(F.ceil(F.log(16.0, F.col("c") / BUCKET_ROWS)), F.lit(0)).cast("int"),
    )
    rows = null_safe_join(sized, settle(targets.drop("c", "weight")), ["source"], "inner")
    rows = rows.withColumn("bucket", F.substring(F.col("place"), F.lit(1), F.col("digits")))
    totals = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("_t"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "bucket", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    inside = (
        Window.partitionBy("sid", "bucket")
        .orderBy("place", "rid")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["sid", "bucket"])
        .withColumn("before", F.col("_o") + F.col("_in"))
        .drop("_o", "_in", "bucket", "digits")
    )


def mix(docs: DataFrame, *names, most: float = MOST, quantum: int = QUANTUM, **options) -> DataFrame:
    """The mix: one row per document and pass of its source's queue.

    The columns of :func:`queue`, and pass (0, 1, ...), finish (virtual finish time of its
    last piece), taken (words of this row) and served (words of the whole mix up to the end of this
    row, in the order of finish times; NULL where nothing is taken).  The budget is the sum of the
    targets.  The piece at which the line reaches it is taken in part, all pieces after it
    are left, so a source differs from its target by at most ``quantum`` words, and by what the
    others, at most ``quantum`` each, left of theirs.

    NULL text and text without words have size 0 and take nothing; NULL is a source of
    its own; rows that repeat an id queue separately; other columns are ignored; an empty
    table gives no rows.
    """
    queued = settle(queue(docs, *names, most=most, **options))
    targets = queued.groupBy("sid").agg(F.first("target").alias("target"))
    budget = math.floor((targets.agg(F.sum("target")).first()[0] or 0) + 1e-6)
    passes = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    last = F.greatest(F.ceil(F.col("size") / quantum).cast("int") - 1, F.lit(0))
    pieces = passes.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    words = F.least(F.col("size") - F.col("piece") * F.lit(quantum), F.lit(quantum)).cast("long")
    end = F.col("before") + F.col("pass") * F.col("source_size") + F.col("piece") * F.lit(quantum) + words
    rows = pieces.select(
        "rid", "pass", "piece", "sid", "place", words.alias("words"),
        F.try_divide(end.cast("double"), F.col("target")).alias("finish"),
    )
    order = [F.col(c) for c in ("finish", "sid", "pass", "place", "rid", "piece")]
    taken = F.greatest(F.least(F.col("words"), F.lit(budget) - F.col("words_ahead")), F.lit(0))
    line = lined_up(rows, order, ["words"]).withColumn("taken", taken.cast("long"))
    whole = line.groupBy("rid", "pass").agg(
        F.max("finish").alias("finish"),
        F.sum("taken").alias("taken"),
        F.max(F.when(F.col("taken") > 0, F.col("words_ahead") + F.col("taken"))).alias("served"),
    )
    return queued.join(whole, "rid")


def taken_documents(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed=42) -> DataFrame:
    """The mixed documents themselves, repeated as often as they are taken.

    A document cut by the end of the budget stays if at least half of it is taken.  Each
    pass takes a prefix of its source's queue, so one hash limit per source and pass
    decides, and no text is shuffled.
    """
    rows = mix(docs, doc_id, text, source, seed=seed)
    half = (F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size"))
    held_to, again = unused_name("limits", docs.columns), unused_name("again", docs.columns)
    limits = settle(
        rows.filter(half)
        .groupBy("source", "pass")
        .agg(F.max("place").alias("limit"))
        .groupBy("source")
        .agg(F.collect_list("limit").alias(held_to))
    )
    clash = docs.withColumnRenamed(source, "source") if source != "source" else docs
    place = hash_key(seed, doc_id)
    held = null_safe_join(clash, limits, ["source"], "inner")
    often = F.size(F.filter(F.col(held_to), lambda limit: limit >= place))
    repeated = held.withColumn(again, F.explode(F.array_repeat(F.lit(0), often)))
    return repeated.select(*[F.col("source").alias(source) if c == source else F.col(c) for c in docs.columns])
