"""Exact top-k by inner product as a Voronoi join.

Vectors are lifted by one coordinate so that all have the length of the longest one; then
the largest inner product is the smallest distance, and the triangle inequality holds.
Queries and data are grouped by their nearest pivot.  From the summaries of the groups
(radius, and the k smallest distances to the pivot) follows for every query group a distance
within which all its answers lie, and for every pair of groups how far from its pivot a
data vector must be to matter.  Only those are replicated; groups are solved in
blocks of bounded size, and blocks keep their k best per query.

Pivots, summaries and thresholds are PIVOTS x PIVOTS numbers at most.  Bounds are taken with a
margin over rounding and scores are exact integers, so pruning never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gsx.session import settle, ship

PIVOTS = 64
#: Data rows and query rows that meet in one task.
DATA_BLOCK, QUERY_BLOCK = 16_384, 1_024
SCALE = 256


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(rid, vec_id, v): floor(256 x) per component; rows that hold no finite vector are left out."""
    x = F.col(embedding)
    return (
        vectors.filter(x.isNotNull())
        .select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(vec_id).cast("long").alias("vec_id"),
            F.transform(x, lambda c: c.cast("double")).alias("x"),
        )
        .filter(
            F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        )
        .select("rid", "vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integer lists as one matrix; missing components are 0."""
    out = np.zeros((len(column), width), np.int64)
    lengths = np.array(column.value_lengths().to_pylist(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, np.arange(len(flat)) - starts] = flat
    return out


def _distances(v: np.ndarray, pivots: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Distances of lifted vectors to lifted pivots."""
    x = v.astype(np.float64)
    square = np.einsum("ij,ij->i", x, x)
    lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - square, 0))
    lifted = np.column_stack([x, lift])
    d = (
        np.einsum("ij,ij->i", lifted, lifted)[:, None]
        + np.einsum("ij,ij->i", pivots, pivots)[None, :]
        - 2 * lifted @ pivots.T
    )
    return np.sqrt(np.maximum(d, 0))


def _assign(pivots: np.ndarray, width: int, longest: float, query: bool):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(matrix(batch.column(2), width), pivots, longest, query)
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                names=[*batch.schema.names, "cell", "far"],
            )

    return assigned


def _thresholds(data: list, queries: list, pivots: np.ndarray, k: int) -> dict[tuple[int, int], float]:
    """For (query cell, data cell): the least distance to its pivot at which data matters."""
    between = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(-1))
    out = {}
    for q in queries:
        i, radius = q["cell"], q["far"]
        # one candidate more than k: the query itself may be among the nearest
        upper = sorted(radius + between[i, r["cell"]] + s for r in data for s in r["near"])
        reach = upper[k] if len(upper) > k else np.inf
        for r in data:
            j = r["cell"]
            least = between[i, j] - radius - reach
            slack = 1e-6 * (1 + between[i, j] + radius + r["far"])
            if r["far"] + slack >= least:
                out[i, j] = float(max(least - slack, -1.0))
    return out


def _merged(asks: dict, held: dict, limits: dict, points: np.ndarray) -> list[list[int]]:
    """Query cells put together while they need nearly the same data and fit one block.

    Every group that is saved is one copy of its data less to send.
    """
    needs = {i: {j for (a, j) in limits if a == i} for i in asks}
    size = lambda cells: sum(held[j] for j in cells)
    groups: list[list[int]] = []
    open_, left = None, {i for i in asks if needs[i]}
    while left:
        if open_ is None:
            open_ = [max(left, key=lambda i: (asks[i], -i))]
            left.discard(open_[0])
        need = set().union(*(needs[i] for i in open_))
        room = QUERY_BLOCK - sum(asks[i] for i in open_)
        close = sorted(left, key=lambda i: (float(((points[i] - points[open_[0]]) ** 2).sum()), i))
        more = next(
            (i for i in close if asks[i] <= room
             and size(need | needs[i]) <= 1.25 * max(size(needs[i]), size(need))), None
        )
        if more is None:
            groups.append(open_)
            open_ = None
        else:
            open_.append(more)
            left.discard(more)
    return groups + ([open_] if open_ else [])


def _solve(k: int, width: int):
    def solved(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        names = ["qrid", "query_id", "vec_id", "score"]
        if not len(queries) or not len(data):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        q = matrix(pa.array(queries["v"]), width)
        x = matrix(pa.array(data["v"]), width)
        # products below 2^53 are exact in floating point and much faster there
        small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2.0**53
        kind = np.float64 if small else np.int64
        ids = data["vec_id"].to_numpy()
        qrid, rid = queries["rid"].to_numpy(), data["rid"].to_numpy()
        x = x.T.astype(kind)
        parts = []
        for low in range(0, len(q), 64):
            scores = (q[low : low + 64].astype(kind) @ x).astype(np.int64)
            for i in range(len(scores)):
                other = np.flatnonzero(rid != qrid[low + i])
                if len(other) > k:
                    cut = np.partition(scores[i][other], len(other) - k)[len(other) - k]
                    other = other[scores[i][other] >= cut]
                best = other[np.lexsort((ids[other], -scores[i][other]))[:k]]
                parts.append((np.full(len(best), low + i), ids[best], scores[i][best]))
        at, found, score = (np.concatenate(p) for p in zip(*parts))
        query_id = queries["vec_id"].to_numpy()
        return pd.DataFrame(
            {"qrid": qrid[at], "query_id": query_id[at], "vec_id": found, "score": score}
        )

    return solved


def top_k(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """The k best rows for every query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``vec_id``.  The score is the inner product of the
    quantized vectors; ties go to the smaller id; a query never meets its own row, but does
    meet other rows of the same id.  Vectors that are NULL or hold a NULL, NaN or infinity take
    no part, nor do rows without an id; shorter vectors count as followed by zeros.  Fewer
    than k other rows give fewer results; an empty table gives none.
    """
    ship(vectors.sparkSession)
    rows = settle(quantized(vectors, vec_id, embedding).filter(F.col("vec_id").isNotNull()))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    width, longest = rows.agg(F.max(F.size("v")), F.max(square)).first()
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not width:
        return vectors.sparkSession.createDataFrame([], empty)
    longest = float(np.sqrt(longest) * (1 + 1e-9))
    # pivots: the rows of the smallest hashes, which no bound depends on
    chosen = rows.orderBy(F.xxhash64("rid"), "rid").limit(pivots).select("v").collect()
    points = matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.int64())), width).astype(float)
    lift = np.sqrt(np.maximum(longest**2 - (points**2).sum(1), 0))
    points = np.column_stack([points, lift])

    schema = "rid bigint, vec_id bigint, v array<bigint>, cell int, far double"
    data = settle(rows.mapInArrow(_assign(points, width, longest, False), schema))
    asked = settle(rows.filter(is_query).mapInArrow(_assign(points, width, longest, True), schema))
    near = Window.partitionBy("cell", "salt").orderBy("far")
    # the k + 1 nearest of each cell, first of each of 64 parts of it
    nearest = (
        data.select("cell", "far", F.pmod(F.xxhash64("rid"), F.lit(64)).alias("salt"))
        .withColumn("n", F.row_number().over(near))
        .filter(F.col("n") <= k + 1)
        .groupBy("cell")
        .agg(F.slice(F.sort_array(F.collect_list("far")), 1, k + 1).alias("near"))
    )
    sizes = data.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n"))
    summary = sizes.join(nearest, "cell").collect()
    groups = asked.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    limits = _thresholds(summary, groups, points, k)
    if not limits:
        return vectors.sparkSession.createDataFrame([], empty)

    # a query group meets its data in blocks: at most PIVOTS x PIVOTS rows of thresholds
    held = {r["cell"]: r["n"] for r in summary}
    asks = {r["cell"]: r["n"] for r in groups}
    table, members = [], []
    for cells in _merged(asks, held, limits, points):
        least: dict[int, float] = {}
        for (i, j), at in limits.items():
            if i in cells:
                least[j] = min(at, least.get(j, np.inf))
        parts = -(-sum(held[j] for j in least) // DATA_BLOCK)
        blocks = -(-sum(asks[i] for i in cells) // QUERY_BLOCK)
        table += [(cells[0], j, at, parts, blocks) for j, at in least.items()]
        members += [(i, cells[0], parts, blocks) for i in cells]
    spark = vectors.sparkSession
    bounds = F.broadcast(
        spark.createDataFrame(table, "grp int, cell int, least double, parts int, blocks int")
    )
    per_group = F.broadcast(spark.createDataFrame(members, "cell int, grp int, parts int, blocks int"))
    salt = F.xxhash64(F.lit(1), "rid")
    sent = (
        data.join(bounds, "cell")
        .filter("far >= least")
        .withColumn("part", F.pmod(salt, F.col("parts")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", "part", "block", "rid", "vec_id", "v")
    )
    asking = (
        asked.join(per_group, "cell")
        .withColumn("block", F.pmod(salt, F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("grp", "part", "block", "rid", "vec_id", "v")
    )
    keys = ["grp", "part", "block"]
    found = (
        asking.groupBy(*keys)
        .cogroup(sent.groupBy(*keys))
        .applyInPandas(
            _solve(k, width), "qrid bigint, query_id bigint, vec_id bigint, score bigint"
        )
    )
    best = Window.partitionBy("qrid").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
