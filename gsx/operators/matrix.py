"""AUC and confusion counts of every (train, test, subset) cell of a transfer matrix.

Every row has a score in each cell it is tested in.  Scores do not become rows: a task sorts
the scores of a chunk per cell, counts equal ones and cuts them into ranges; a range of a cell
is one row that holds them as binary.  Ranges meet in a shuffle, each yields its own U and
counts, and the U of a cell adds ``P(range) * N(ranges before)``.

Only the cuts between the ranges come from drawn rows, as in Spark's range partitioning.
Every row is scored and counted, and any cuts give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gsx.operators.evaluate import COMBINED, FULL, SCORE_DIGITS, fit_moments, subset_scores, with_cell_folds
from gsx.operators.ordered import auc_from
from gsx.session import settle, ship

#: Rows that a task scores at once.
CHUNK = 1 << 18
#: Rows of the table for each range of a cell.
RANGE_ROWS = 1 << 21
#: Rows drawn for the cuts.
DRAWN_ROWS = 200_000
_GRID = 10.0**SCORE_DIGITS
_LOW_BITS = np.int64(2**63 - 1)
_NAN = np.int64(0x7FF8000000000000)


def order_keys(scores: np.ndarray) -> np.ndarray:
    """Integers in the order of the scores, NaN last; 0 and more stand for scores of 0 and more, and NaN."""
    bits = (scores + 0.0).view(np.int64)
    keys = np.where(bits < 0, bits ^ _LOW_BITS, bits)
    keys[np.isnan(scores)] = _NAN
    return keys


def _subset_keys(x: list, absent: list, params, subsets: list) -> list:
    """Order keys of the baseline score of every subset, or None where it has no direction."""
    mean, std, sign = params
    z = []
    for i in range(len(x)):
        if sign[i] is None or mean[i] is None:
            z.append(0.0)
            continue
        value = sign[i] * (x[i] - mean[i]) / std[i]
        z.append(value if absent[i] is None else np.where(absent[i], 0.0, value))
    out = []
    for at in subsets:
        if all(sign[i] is None for i in at):
            out.append(None)
            continue
        total = np.zeros(len(x[0]))
        for i in at:
            total = total + z[i]
        out.append(order_keys(np.rint(total / len(at) * _GRID) / _GRID))
    return out


def _blobs(keys: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Distinct keys of each range and how often each occurs; no counts say once each."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    tied = len(first) < len(keys)
    times = np.diff(np.append(first, len(keys))).astype("<u4") if tied else np.zeros(0, "<u4")
    keys = keys[first] if tied else keys
    ends = np.concatenate([[0], np.searchsorted(keys, cuts, "left"), [len(keys)]])

    def binary(data, width):
        offsets = (ends * width).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    return binary(keys, 8), binary(times, 4 if tied else 0)


def _range_blobs(cells: list, cuts: list, fitted: dict, subsets: list, features, label, domain, more, combined):
    """One row per (more, cell, range) of a chunk: keys and counts of its positives and negatives."""
    position = {cell: i for i, cell in enumerate(cells)}
    trains = sorted({train for train, _, _ in cells})

    def scored(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        told = [*more, domain]
        code = np.zeros(len(rows), np.int64)
        for name in told:
            found = pc.dictionary_encode(rows.column(name).combine_chunks(), null_encoding="encode")
            code = code * len(found.dictionary) + found.indices.to_numpy()
        distinct, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(len(distinct) + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            yield from group(rows.take(pa.array(order[a:b])))

    def group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = rows.column(domain)[0].as_py()
        columns = [rows.column(f).combine_chunks() for f in features]
        absent = [c.is_null().to_numpy(zero_copy_only=False) if c.null_count else None for c in columns]
        x = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]
        y = rows.column(label).combine_chunks().fill_null(-1).to_numpy()

        def keys_of(train, holdout, at=None):
            params = fitted.get((train, holdout))
            if params is None:
                return None
            if at is None:
                return _subset_keys(x, absent, params, subsets)
            part = [None if m is None else m[at] for m in absent]
            return _subset_keys([v[at] for v in x], part, params, subsets)

        def held_out(train, fold):
            """Keys and labels of the rows scored without their own fold."""
            folds = rows.column(fold).combine_chunks().fill_null(FULL).to_numpy()
            for h in np.unique(folds[folds != FULL]):
                at = np.flatnonzero(folds == h)
                yield keys_of(train, int(h), at), y[at]

        out = []
        for train in trains:
            tests = [(test, fold) for test, fold in ((own, "fold"), (combined, "fold_all")) if (train, test, 0) in position]
            whole = keys_of(train, FULL) if any(test != train for test, _ in tests) else None
            for test, fold in tests:
                parts = list(held_out(train, fold)) if train == test else [(whole, y)]
                parts = [p for p in parts if p[0] is not None]
                for s in range(len(subsets)):
                    have = [(k[s], t) for k, t in parts if k[s] is not None]
                    if not have:
                        continue
                    cell = position[train, test, s]
                    keys = np.concatenate([k for k, _ in have])
                    labels = np.concatenate([t for _, t in have])
                    blobs = [*_blobs(keys[labels == 1], cuts[cell]), *_blobs(keys[labels == 0], cuts[cell])]
                    n = len(cuts[cell]) + 1
                    out.append([pa.repeat(pa.scalar(cell, pa.int32()), n), pa.array(np.arange(n, dtype=np.int32)), *blobs])
        if not out:
            return
        columns = [pa.concat_arrays(c) for c in zip(*out)]
        kept = pc.or_(*[pc.greater(pc.binary_length(columns[i]), 0) for i in (2, 4)])
        names = [*more, "cell", "range", "p", "p_times", "n", "n_times"]
        told = [pa.repeat(rows.column(name)[0], len(kept)) for name in more]
        yield pa.RecordBatch.from_arrays([*told, *columns], names=names).filter(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield from scored(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from scored(pa.Table.from_batches(held))

    return run


def _joined(keys: pa.ChunkedArray, times: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all chunks and the number of rows at or before each, from 0."""

    def data(column, kind):
        parts, sizes = [], []
        for chunk in column.cast(pa.binary()).chunks:
            if not len(chunk):
                continue
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            width = np.dtype(kind).itemsize
            sizes.append(np.diff(offsets) // width)
            if offsets[-1] > offsets[0]:
                parts.append(np.frombuffer(chunk.buffers()[2], kind, (offsets[-1] - offsets[0]) // width, int(offsets[0])))
        return np.concatenate([np.zeros(0, kind), *parts]), np.concatenate([np.zeros(0, np.int32), *sizes])

    values, sizes = data(keys, "<i8")
    counts, counted = data(times, "<u4")
    if not len(counts):
        return np.sort(values), np.arange(len(values) + 1)
    weights = np.ones(len(values), np.int64)
    weights[np.repeat(counted > 0, sizes)] = counts
    order = np.argsort(values)
    return values[order], np.concatenate([[0], np.cumsum(weights[order])])


def range_sums(p: pa.ChunkedArray, p_times: pa.ChunkedArray, n: pa.ChunkedArray, n_times: pa.ChunkedArray):
    """Positives, negatives, U, and positives and negatives predicted 1, of one range."""
    (pos, p_upto), (neg, n_upto) = _joined(p, p_times), _joined(n, n_times)
    weight = np.diff(p_upto)
    twice = n_upto[np.searchsorted(neg, pos, "left")] + n_upto[np.searchsorted(neg, pos, "right")]
    yes = [int(upto[-1] - upto[np.searchsorted(keys, 0, "left")]) for keys, upto in ((pos, p_upto), (neg, n_upto))]
    return int(p_upto[-1]), int(n_upto[-1]), int((weight * twice).sum()) / 2, *yes


def _add_range(names: list[str]):
    def add(table: pa.Table) -> pa.Table:
        sums = range_sums(*[table.column(c) for c in ("p", "p_times", "n", "n_times")])
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        told = [table.column(c).slice(0, 1) for c in names]
        return pa.table([*told, *[pa.array([v], k) for v, k in zip(sums, kinds)]], names=[*names, "p", "n", "u", "tp", "fp"])

    return add


def _range_cuts(rows: DataFrame, params: DataFrame, cells: list, subsets: dict, features, ranges: int, total: int) -> list:
    """Order keys that cut the scores of each cell into about equal ranges; those of its training set serve."""
    if ranges < 2:
        return [np.zeros(0, np.int64)] * len(cells)
    drawn = rows.select(*features).sample(min(1.0, DRAWN_ROWS / total), 42)
    whole = F.broadcast(params.filter(F.col("holdout") == FULL))
    scored = subset_scores(drawn.crossJoin(whole), subsets, features)
    probs = [float(v) for v in np.linspace(0, 1, ranges + 1)[1:-1]]
    # one row per training set and subset
    found = {
        (r["train"], r["subset"]): order_keys(np.unique(np.array(r["q"] or [], float)))
        for r in scored.groupBy("train", "subset").agg(F.percentile_approx("subset_score", probs, 4 * ranges).alias("q")).collect()
    }
    names = list(subsets)
    return [np.unique(found.get((train, names[s]), np.zeros(0, np.int64))) for train, _, s in cells]


def matrix_results(
    df: DataFrame, features, subsets: dict, label: str, group: str, domain: str, domains, more=(), k=5, seed=42,
    combined: str = COMBINED, range_rows: int = RANGE_ROWS, pairs=None,
) -> DataFrame:
    """AUC, class sizes and confusion counts per (more, train, test, subset).

    The scores are those of ``equal_cell_scores`` and ``subset_scores``; a score of 0 or more
    predicts class 1.  Columns: n_pos, n_neg, auc, tp, fp, tn, fn.  ``pairs`` names the (train, test)
    that are wanted, all if None.
    """
    spark = df.sparkSession
    ship(spark)
    features, more = list(features), list(more)
    folded = with_cell_folds(df.filter(F.col(domain).isin(*domains)), label, group, domain, k, seed)
    x = [F.col(f).cast("double").alias(f) for f in features]
    folds = [F.col(f).cast("int").alias(f) for f in ("fold", "fold_all")]
    rows = settle(folded.select(*more, domain, *folds, F.col(label).cast("int").alias(label), *x))
    params = settle(fit_moments(rows, features, label, domain, k))
    # one row per training set and fold
    fitted = {(r["train"], r["holdout"]): (r["mean"], r["std"], r["sign"]) for r in params.collect()}
    sets = [*domains, combined]
    wanted = [(train, test) for train in sets for test in sets if pairs is None or (train, test) in pairs]
    cells = [(train, test, s) for train, test in wanted for s in range(len(subsets))]
    total = rows.count()
    cuts = _range_cuts(rows, params, cells, subsets, features, -(-total // range_rows), total)
    at = [[features.index(f) for f in fs] for fs in subsets.values()]
    told = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(more)])
    blobs = rows.mapInArrow(
        _range_blobs(cells, cuts, fitted, at, features, label, domain, more, combined),
        f"{told}cell int, range int, p binary, p_times binary, n binary, n_times binary",
    )
    keys = [*more, "cell"]
    sums = blobs.groupBy(*keys, "range").applyInArrow(
        _add_range([*keys, "range"]), f"{told}cell int, range int, p bigint, n bigint, u double, tp bigint, fp bigint"
    )
    # a few ranges per cell
    below = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = sums.withColumn("_before", F.coalesce(F.sum("n").over(below), F.lit(0))).groupBy(*keys).agg(
        F.sum("p").alias("n_pos"),
        F.sum("n").alias("n_neg"),
        F.sum(F.col("u") + F.col("p").cast("double") * F.col("_before")).alias("u"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
    )
    names = list(subsets)
    named = [F.struct(F.lit(a).alias("train"), F.lit(b).alias("test"), F.lit(names[s]).alias("subset")) for a, b, s in cells]
    return each.withColumn("_c", F.get(F.array(*named), F.col("cell"))).select(
        *more, "_c.*", "n_pos", "n_neg", auc_from().alias("auc"), "tp", "fp",
        (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"),
    )


def matrix_with_overlap(
    df: DataFrame, features, label: str, group: str, domain: str, domains, k=5, seed=42,
    combined: str = COMBINED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The ``transfer_matrix`` of ``cell_scores`` without a row per score."""
    found = matrix_results(
        df, features, {"all": list(features)}, label, group, domain, domains, (), k, seed, combined, range_rows
    )
    sizes = df.filter(F.col(domain).isin(*domains)).groupBy(domain).agg(F.count(F.lit(1)).alias("n"))
    # off the diagonal a test set meets the training set in the rows of the one domain among the two
    overlap = F.lit(0).cast("bigint")
    for r in sizes.collect():  # one row per domain
        for train, test in ((r[0], combined), (combined, r[0])):
            overlap = F.when((F.col("train") == train) & (F.col("test") == test), r["n"]).otherwise(overlap)
    return found.select("train", "test", "n_pos", "n_neg", "auc", overlap.alias("overlap_rows"))
