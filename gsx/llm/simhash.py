"""Near copies by SimHash fingerprints joined on pigeonhole blocks.

Fingerprints of 64 bits are cut into five blocks.  Two that differ in at most three bits
agree in at least two blocks, so each of the ten pairs of blocks is a join key of 25 or
26 bits.  Distinct fingerprints that share a key are compared; inside one bucket only a
spanning forest of the links leaves the task, never all pairs.  A bucket too large for
one task is cut into chunks that meet pairwise, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.llm.components import components
from gsx.llm.exact_dedup import text_digest
from gsx.llm.row_numbers import NumberedRows
from gsx.llm.texts import word_lists
from gsx.llm.workers import released
from gsx.session import settle, ship

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Widths of the pigeonhole blocks, from the lowest bit up.
WIDTHS = (13, 13, 13, 13, 12)
#: Members of a bucket that one task compares at once are at most twice this many.
CHUNK = 4096

_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)


def fingerprint(data: bytes) -> int:
    """SimHash of the word shingles of a UTF-8 text, 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    votes, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_lists(data.lower()):
        words = tail + words
        tail = words[1 - SHINGLE :]
        if len(words) < SHINGLE:
            tail = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
        parts = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            votes[8 * k : 8 * k + 8] += np.bincount(parts[:, k], minlength=256) @ _BITS
        total += len(hashes)
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("raw")
        fps = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], "fp"]
        )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more) -> DataFrame:
    """(doc_id, more..., fp): one fingerprint per row as a signed 64-bit integer."""
    ship(docs.sparkSession)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *more, raw)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(released(_fingerprints), f"{schema}, fp bigint")


def block_keys(fp: str) -> F.Column:
    """The join keys of a fingerprint: number of the pair of blocks, and their bits."""
    low = np.concatenate([[0], np.cumsum(WIDTHS)])
    block = [
        F.shiftrightunsigned(F.col(fp), int(at)).bitwiseAND(F.lit((1 << width) - 1))
        for at, width in zip(low, WIDTHS)
    ]
    pairs = combinations(range(len(WIDTHS)), len(WIDTHS) - DISTANCE)
    return F.array(
        *[
            F.lit(number << 32).bitwiseOR(F.shiftleft(block[i], WIDTHS[j])).bitwiseOR(block[j])
            for number, (i, j) in enumerate(pairs)
        ]
    )


def _forest(group: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Index of the root of each row; rows of a group link at DISTANCE or fewer bits."""
    n = len(fp)
    root = np.arange(n)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, step = np.arange(n), 0
    while True:
        step += 1
        left = left[left + step < n]
        left = left[group[left] == group[left + step]]
        if not len(left):
            return root
        near = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= DISTANCE]
        near = near[root[near] != root[near + step]]
        if len(near):
            for a in near.tolist():
                x, y = find(a), find(a + step)
                parent[max(x, y)] = min(x, y)
            root = np.array(parent)
            while not np.array_equal(up := root[root], root):
                root = up


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of buckets; rows come sorted by bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = np.zeros((4, 0), np.int64)

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        new = np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)
        group = np.concatenate([[0], np.cumsum(new)]) if rows.shape[1] else np.zeros(0, int)
        root = _forest(group, rows[3].view(np.uint64))
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([rows[3][child], rows[3][root[child]]], schema=schema)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
        rows = np.concatenate([rest, rows], axis=1)
        if not rows.shape[1]:
            continue
        # the last bucket may go on in the next batch
        open_ = np.all(rows[:3] == rows[:3, -1:], axis=0)
        cut = int(np.argmax(open_))
        rest = rows[:, cut:]
        if cut:
            yield solve(np.ascontiguousarray(rows[:, :cut]))
    if rest.shape[1]:
        yield solve(np.ascontiguousarray(rest))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that span all their components."""
    ship(fps.sparkSession)
    keyed = fps.select(F.explode(block_keys("fp")).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("own"))
    # chunk c meets every other chunk; a bucket of one chunk meets itself
    meets = F.when(F.col("chunks") > 1, others).otherwise(F.array(F.lit(0)))
    dealt = (
        shared.withColumn("own", own)
        .withColumn("other", F.explode(meets))
        .select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    )
    sorted_ = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")
    return sorted_.mapInArrow(released(_links), "a bigint, b bigint")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more) -> DataFrame:
    """One row per input row: doc_id, more..., fp, component_id.

    Fingerprints link at DISTANCE or fewer differing bits; component_id is the smallest
    doc_id reachable, the own one included.  NULL and empty text have fingerprint 0 and
    link like any other.  Rows that repeat an id count once for its component.  A NULL id
    is skipped by the minimum, so component_id is NULL only where no row of the component
    has an id.  Other columns are ignored; an empty table gives no rows.
    """
    rows = settle(fingerprints(docs, doc_id, text, *more))
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(fps.select("fp")), "a", "b")
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    rooted = settle(rooted)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row, of the smallest id, of each group of near copies.

    Where rows of a group repeat that id the smallest text digest decides, then the place in the table.
    """
    table = NumberedRows(docs)
    digest = text_digest(F.col(text)).alias("text_sha256")
    return keep_first(table, near_groups(table.rows, doc_id, text, digest, F.col(table.name).alias("rid")))


def keep_first(table: NumberedRows, rows: DataFrame) -> DataFrame:
    """``table`` with the first row of each ``root``; ``rows`` has doc_id, text_sha256, root, rid per row."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256", "rid")
    first = rows.groupBy("root").agg(F.min(order)["rid"].alias("stays"))
    return table.without(rows.join(first, "root").filter("rid <> stays").select("rid"))
