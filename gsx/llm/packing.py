"""Packing token sequences by cutting stock with column generation.

A document fills whole sequences with its first tokens; what is left, its rest, is shorter
than a sequence.  The rests, counted by length class, are a cutting-stock problem: a linear
program chooses how often to use each pattern of classes, a knapsack by dynamic programming
prices new patterns, and the rounded patterns are given to ranked documents, whole.
A class stands for its longest length, so sequences keep small gaps.  A share of the documents,
drawn by hash and just large enough, is not in the program: their tokens, one after another,
are cut to the gaps, and what remains of them fills sequences of its own.

Rests too short for a class of their own are fillers too, the best ones.

The driver sees the length histogram (one count per length below the capacity) and one
pattern per class, whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gsx.llm.tokens import word_tokens
from gsx.llm.workers import released
from gsx.session import settle, ship

CAPACITY = 4096
END = 2
#: Class lengths are multiples of 1 / GRID of the capacity and grow by RATIO at least.
GRID, RATIO = 256, 1.04
#: Rests below 1 / SHORT of the capacity are fillers.
SHORT = 64
_END_IDS = np.array([END], "<u4").tobytes()
#: Rows of one hash bucket, the unit that one task ranks.
BUCKET_ROWS = 20_000


def class_tops(capacity: int = CAPACITY) -> np.ndarray:
    """Longest length of each class in grid units of the capacity, ascending."""
    tops = [max(1, min(GRID, capacity) // SHORT + 1)]
    while tops[-1] < min(GRID, capacity):
        tops.append(min(max(tops[-1] + 1, int(tops[-1] * RATIO)), min(GRID, capacity)))
    return np.array(tops)


def grid_unit(capacity: int) -> int:
    """Tokens of a grid unit."""
    return -(-capacity // min(GRID, capacity))


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of at most ``capacity``: an unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = np.flatnonzero(values > 1e-12)
    s, v = sizes[use], values[use]
    if not len(use):
        return 0.0, np.zeros(len(sizes), np.int64)
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(s, room, "right"))
        best[room] = best[room - 1]
        if fits:
            gain = best[room - s[:fits]] + v[:fits]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], took[room] = gain[k], use[k]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
            continue
        pattern[took[room]] += 1
        room -= sizes[took[room]]
    return float(best[capacity]), pattern


def solve_patterns(demand: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 5000):
    """Patterns of a basis (columns) and how often each is used in the relaxed optimum.

    Primal simplex over the patterns of the classes in demand, started with one pattern of a
    single class for each.  Should rounding spoil the basis, the plan reached so far stands;
    it still meets the demand.
    """
    asked = np.flatnonzero(demand)
    m, s = len(asked), sizes[asked]
    basis = np.diag(capacity // s).astype(float)
    inverse = np.diag(1.0 / np.diag(basis)) if m else np.zeros((0, 0))
    x = inverse @ demand[asked]
    for step in range(1, rounds + 1):
        value, pattern = price(inverse.sum(0), s, capacity)
        if value <= 1 + 1e-6:
            break
        direction = inverse @ pattern
        up = direction > 1e-7
        ratio = np.where(up, np.divide(x, direction, out=np.full(m, np.inf), where=up), np.inf)
        theta = max(float(ratio.min()), 0.0)
        # of the patterns that may leave, the one with the largest pivot
        out = int(np.where(ratio <= theta + 1e-9 * (1 + theta), direction, -1).argmax())
        x = np.maximum(x - theta * direction, 0)
        x[out] = theta
        row = inverse[out] / direction[out]
        basis[:, out] = pattern
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        if step % 40 == 0:
            try:
                inverse = np.linalg.inv(basis)
            except np.linalg.LinAlgError:
                break
    plan = np.zeros((len(sizes), m), np.int64)
    plan[asked] = basis.astype(np.int64)
    return plan, x


def whole_patterns(demand: np.ndarray, basis: np.ndarray, x: np.ndarray, sizes, capacity: int):
    """(pattern, times) with at least ``demand`` slots: rounded down, and the rest by first fit.

    The rest is less than one pattern per class, so it does not grow with the demand.
    """
    times = np.floor(x + 1e-9).astype(np.int64)
    used = basis @ times
    # rounding can only fall short, but a degenerate basis may offer more slots than asked
    plan = [(basis[:, k], int(times[k])) for k in range(len(times)) if times[k]]
    rest = np.maximum(demand - used, 0)
    rooms: list[int] = []
    fill: list[np.ndarray] = []
    for c in range(len(sizes) - 1, -1, -1):
        left, size, k = int(rest[c]), int(sizes[c]), 0
        while left:
            if k == len(rooms):
                rooms.append(capacity)
                fill.append(np.zeros(len(sizes), np.int64))
            put = min(left, rooms[k] // size)
            rooms[k] -= put * size
            fill[k][c] += put
            left, k = left - put, k + 1
    return plan + [(p, 1) for p in fill]


def _tokenized(path: str, capacity: int, short: int):
    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        for batch in batches:
            counts, sums, tails = [], [], []
            for pieces in words.each(raw.as_py() for raw in batch.column("raw")):
                n, crcs, held = 0, [], b""
                for ids in chain(pieces, (_END_IDS,)):
                    n += len(ids) // 4
                    held += ids
                    while len(held) >= 4 * capacity:
                        crcs.append(zlib.crc32(held[: 4 * capacity]))
                        held = held[4 * capacity :]
                if held:
                    crcs.append(zlib.crc32(held))
                counts.append(n)
                sums.append(crcs)
                tails.append(held if len(held) < 4 * short else None)
            more = [
                pa.array(counts, pa.int64()),
                pa.array(sums, pa.list_(pa.int64())),
                pa.array(tails, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "n", "crcs", "tail"]
            )

    return tokenized


def _cut_tokens(path: str):
    """Checksums of the pieces of the documents that fill gaps."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        for batch in batches:
            sums = []
            columns = (batch.column("raw"), batch.column("tail"), batch.column("pieces").to_pylist())
            for raw, tail, pieces in zip(*columns):
                # only the ids from the first piece on are held
                at, low, held = 0, 4 * min(p["start"] for p in pieces), []
                if tail.is_valid:
                    at, low, held = 0, 4 * pieces[0]["base"], [tail.as_py()]
                else:
                    for ids in chain(words.ids(raw.as_py()), (_END_IDS,)):
                        held.append(ids[max(low - at, 0) :])
                        at += len(ids)
                ids = b"".join(held)
                spans = [(4 * p["start"] - low, 4 * p["length"]) for p in pieces]
                sums.append([zlib.crc32(ids[a : a + n]) for a, n in spans])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(sums, pa.list_(pa.int64()))],
                names=[*batch.schema.names[2:], "crcs"],
            )

    return cut


def _running(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of ``values`` over the rows before each one in hash order, as ``<value>_before``.

    Rows carry their hash bucket in ``bucket`` and their order in ``place``.
    """
    totals = rows.groupBy(*keys, "bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "bucket", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = (
        Window.partitionBy(*keys, "bucket")
        .orderBy("place", "rid")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = rows.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = summed.join(offsets, [*keys, "bucket"])
    return joined.withColumns({f"{v}_before": F.col(f"_o_{v}") + F.col(f"_in_{v}") for v in values}).drop(
        *[f"_o_{v}" for v in values], *[f"_in_{v}" for v in values]
    )


def pack(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, filler.

    A piece is ``length`` ids of its document from ``start``; it lies at ``offset`` of its
    sequence.  Every id, the end id included, is in one piece; pieces of a sequence leave
    no gap between them and are at most ``capacity`` together.  ``filler`` marks the documents that
    were cut to the gaps.

    NULL and empty text have the end id only.  Rows that repeat an id are documents of their
    own; a NULL id is kept; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw).alias("digest"), raw.alias("raw"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    counted = base.mapInArrow(
        released(_tokenized(path, capacity, capacity // SHORT)),
        f"doc_id {id_type}, digest bigint, n bigint, crcs array<bigint>, tail binary",
    )
    tops, unit = class_tops(capacity), grid_unit(capacity)
    room, short = capacity // unit, capacity // SHORT
    sized = settle(
        counted.select(
            F.monotonically_increasing_id().alias("rid"),
            "*",
            F.floor(F.col("n") / capacity).cast("long").alias("full"),
            (F.col("n") % capacity).cast("int").alias("rest"),
            F.xxhash64(F.lit(17), "doc_id", "digest").alias("place"),
        )
    )
    lengths = settle(sized.groupBy("rest").agg(F.count(F.lit(1)).alias("c"))).collect()
    count = sum(r["c"] for r in lengths)
    if not count:
        return _empty(spark, id_type)

    # how much of the rests must fill gaps follows from the waste of the program without it
    demand, tokens, spare = _classes(lengths, tops * unit, short)
    plan = whole_patterns(demand, *solve_patterns(demand, tops, room), tops, room)
    waste = max(capacity * sum(t for _, t in plan) - tokens - spare, 0)
    share = min(1.0, 1.03 * waste / (tokens + waste) + 0.002) if tokens else 0.0
    limit = int(-(2**63) + share * 2.0**64) if share < 1 else 2**63 - 1
    buckets = max(1, -(-count // BUCKET_ROWS))
    drawn = F.xxhash64(F.lit(29), "doc_id", "digest") < F.lit(limit)
    rows = sized.withColumns(
        {
            "filler": (F.col("rest") > 0) & (drawn | (F.col("rest") < short)),
            "bucket": F.pmod(F.shiftrightunsigned("place", 17), F.lit(buckets)).cast("int"),
        }
    )
    full = _full_pieces(rows, capacity)
    held = rows.filter(~F.col("filler") & (F.col("rest") > 0))
    packed_lengths = settle(held.groupBy("rest").agg(F.count(F.lit(1)).alias("c"))).collect()
    demand, _, _ = _classes(packed_lengths, tops * unit, short)
    plan = whole_patterns(demand, *solve_patterns(demand, tops, room), tops, room)
    first = sized.agg(F.sum("full")).first()[0]
    slots = settle(_slots(held, plan, tops * unit, capacity, first))
    gaps = settle(
        slots.groupBy("sequence_id").agg(F.sum("length").alias("used")).filter(F.col("used") < capacity)
    )
    first += sum(t for _, t in plan)
    filled = _fill(base, rows.filter("filler"), gaps, drawn, path, capacity, first)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "filler"]
    return full.select(*names).unionByName(slots.select(*names)).unionByName(filled.select(*names))


def _classes(lengths: list, tops: np.ndarray, short: int) -> tuple[np.ndarray, int, int]:
    """Documents per length class, the tokens of their rests, and those of shorter rests."""
    demand, tokens, spare = np.zeros(len(tops), np.int64), 0, 0
    for row in lengths:
        if row["rest"] >= max(short, 1):
            demand[np.searchsorted(tops, row["rest"])] += row["c"]
            tokens += row["rest"] * row["c"]
        else:
            spare += row["rest"] * row["c"]
    return demand, tokens, spare


def _full_pieces(rows: DataFrame, capacity: int) -> DataFrame:
    """Sequences that one document fills alone."""
    ranked = _running(rows.filter("full > 0"), [], ["full"])
    each = ranked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    return each.select(
        "doc_id",
        (F.col("i") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        F.get("crcs", F.col("i").cast("int")).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.col("full_before") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(False).alias("filler"),
    )


def _slots(held: DataFrame, plan: list, tops: np.ndarray, capacity: int, first: int) -> DataFrame:
    """Rests that lie whole in the slots of patterns."""
    # per class: first rank, number of sequences, first sequence and first slot of each pattern
    table: list[list[tuple[int, int, int, int]]] = [[] for _ in tops]
    given, sequence = np.zeros(len(tops), np.int64), first
    for pattern, times in plan:
        slot = 0
        for c in np.flatnonzero(pattern):
            table[c].append((int(given[c]), times, sequence, slot))
            given[c] += pattern[c] * times
            slot += int(pattern[c])
        sequence += times
    arrays = [np.array(t, np.int64).reshape(-1, 4) for t in table]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (batch.column(c).to_numpy() for c in ("cls", "one_before"))
            ids, slots = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                row = arrays[c][np.searchsorted(arrays[c][:, 0], rank[at], "right") - 1]
                local = rank[at] - row[:, 0]
                ids[at] = row[:, 2] + local % row[:, 1]
                slots[at] = row[:, 3] + local // row[:, 1]
            names = [n for n in batch.schema.names if n not in ("cls", "one_before")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(ids), pa.array(slots)],
                names=[*names, "sequence_id", "slot"],
            )

    classed = held.withColumns(
        {
            # how many classes end below the rest
            "cls": F.size(F.filter(F.lit([int(t) for t in tops]), lambda t: t < F.col("rest"))),
            "one": F.lit(1).cast("long"),
        }
    )
    ranked = _running(classed, ["cls"], ["one"]).select(
        "doc_id",
        (F.col("full") * capacity).alias("start"),
        F.col("rest").cast("long").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "cls",
        "one_before",
    )
    kept = [f for f in ranked.schema.fields if f.name not in ("cls", "one_before")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    at = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(released(placed), f"{schema}, sequence_id bigint, slot bigint").select(
        *[f.name for f in kept],
        "sequence_id",
        F.coalesce(F.sum("length").over(at), F.lit(0)).cast("long").alias("offset"),
        F.lit(False).alias("filler"),
    )


def _fill(base, filler: DataFrame, gaps: DataFrame, drawn, path: str, capacity: int, first: int):
    """Pieces of the filler documents: first into the gaps, then into sequences of their own.

    Both lie on one line of tokens.  What is left at the end fills sequences whose lengths
    are powers of two, which need no padding.
    """
    spark = base.sparkSession
    room = gaps.withColumns(
        {
            "gap": capacity - F.col("used"),
            "place": F.col("sequence_id"),
            "rid": F.col("sequence_id"),
            "bucket": F.floor(F.col("sequence_id") / BUCKET_ROWS),
        }
    )
    tape = settle(
        _running(filler.withColumn("rest", F.col("rest").cast("long")), [], ["rest"]).select(
            "rid", "doc_id", "digest", "n", "tail", "rest", F.col("rest_before").alias("at"),
            (F.col("full") * capacity).alias("base"),
        )
    )
    have = tape.agg(F.sum("rest")).first()[0] or 0
    space = room.agg(F.sum("gap")).first()[0] or 0
    own = max(have - space, 0) // capacity
    ends, at = [], space + own * capacity
    for power in range(capacity.bit_length() - 1, -1, -1):
        if have - at >= 1 << power:
            ends.append((first + own + len(ends), at, 1 << power, 0))
            at += 1 << power
    holes = _running(room, [], ["gap"]).select(
        "sequence_id", F.col("gap_before").alias("low"), "gap", F.col("used").alias("offset")
    )
    # at most one sequence per power of two
    holes = holes.union(spark.createDataFrame(ends, "sequence_id bigint, low bigint, gap bigint, offset bigint"))

    def blocks(low, size):
        return F.explode(F.sequence(F.floor(low / capacity), F.floor((low + size - 1) / capacity)))

    left = tape.withColumn("block", blocks(F.col("at"), F.col("rest")))
    right = holes.withColumn("block", blocks(F.col("low"), F.col("gap")))
    start, end = F.greatest("at", "low"), F.least(F.col("at") + F.col("rest"), F.col("low") + F.col("gap"))
    met = (
        left.join(right, "block")
        .filter((start < end) & (F.floor(start / capacity) == F.col("block")))
        .select(
            "rid", "doc_id", "digest", "n", "tail", "base",
            (F.col("base") + start - F.col("at")).alias("start"),
            (end - start).alias("length"),
            "sequence_id",
            (F.col("offset") + start - F.col("low")).alias("offset"),
        )
    )
    # beyond the gaps the line is cut at every capacity
    low, high = F.greatest(F.col("at"), F.lit(space)), F.least(F.col("at") + F.col("rest"), F.lit(space + own * capacity))
    beyond = (
        tape.filter(low < high)
        .withColumn("k", F.explode(F.sequence(F.floor((low - space) / capacity), F.floor((high - 1 - space) / capacity))))
        .withColumns({"a": F.greatest(low, space + F.col("k") * capacity), "b": F.least(high, space + (F.col("k") + 1) * capacity)})
        .select(
            "rid", "doc_id", "digest", "n", "tail", "base",
            (F.col("base") + F.col("a") - F.col("at")).alias("start"),
            (F.col("b") - F.col("a")).alias("length"),
            (F.col("k") + first).alias("sequence_id"),
            (F.col("a") - space - F.col("k") * capacity).alias("offset"),
        )
    )
    piece = F.struct("base", "start", "length", "sequence_id", "offset")
    # a rest is shorter than a sequence, so a row has a bounded number of pieces
    pieces = met.unionByName(beyond).groupBy("rid", "doc_id", "digest", "n", "tail").agg(F.collect_list(piece).alias("pieces"))
    pieces = settle(pieces)
    # short rests carry their ids; the others' texts are found again by the hash that drew them
    texts = (
        base.filter(drawn)
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.first("raw").alias("raw"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    names = ["raw", "tail", "doc_id", "n", "pieces"]
    long = pieces.filter("tail IS NULL").join(texts, same).select(*names)
    brief = pieces.filter("tail IS NOT NULL").withColumn("raw", F.lit(None).cast("binary")).select(*names)
    joined = long.union(brief)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[2:])
    summed = joined.mapInArrow(released(_cut_tokens(path)), f"{kept}, crcs array<bigint>")
    each = summed.select("doc_id", "n", F.explode(F.arrays_zip("pieces", "crcs")).alias("z"))
    return each.select(
        "doc_id",
        F.col("z.pieces.start").alias("start"),
        F.col("z.pieces.length").alias("length"),
        F.col("z.crcs").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        F.col("z.pieces.sequence_id").alias("sequence_id"),
        F.col("z.pieces.offset").alias("offset"),
        F.lit(True).alias("filler"),
    )


def _empty(spark, id_type: str) -> DataFrame:
    return spark.createDataFrame(
        [],
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, filler boolean",
    )
