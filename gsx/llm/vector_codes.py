"""Product codes of vectors with exact integer k-means.

Components become integers, vectors are cut into equal parts, and every part position learns a
codebook.  Distances must be exact, so dot products are taken from float64 matrix products of
limbs: integers are split until no product of two limbs, summed over a part, reaches 2 ** 53,
and the partial products are put together in 64-bit integers.  The first smallest distance
wins.  A round sends sums per codebook entry, never vectors; the codebooks (parts x entries x
width integers) are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.llm.texts import unused_name
from gsx.operators.ordered import lookup_join
from gsx.session import settle, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of an integer that float64 holds exactly.
EXACT_BITS = 53
#: Rows multiplied at once.
ROWS = 8192
#: Shares of the partial sums of an entry that are added up before the last sum.
SHARES = 64


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` holds the codebook of part ``p``, one row per entry."""

    entries: np.ndarray

    def text(self) -> str:
        """All components in decimal by part, entry and position, comma-joined."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays whose sum, the k-th times 2 ** (bits * k), is ``values``."""
    out = []
    while True:
        low = values & ((1 << bits) - 1)
        rest = values >> bits
        if ((rest == 0) | (rest == -1)).all():
            # the last limb keeps the sign
            out.append(values.astype(np.float64))
            return out
        out.append(low.astype(np.float64))
        values = rest


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c.T`` of int64 matrices, exact modulo 2 ** 64, by float64 products of limbs."""
    width = max(x.shape[1], 1)
    bits = (EXACT_BITS - int(width - 1).bit_length()) // 2 - 1
    total = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``c`` (the first of equals) and its squared distance."""
    far = (x * x).sum(axis=1)[:, None] - 2 * exact_products(x, c) + (c * c).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors of a list column as (rows, parts, width)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, width)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sums(books: np.ndarray):
    """Sums and counts of the vectors of every entry, one row per entry and task."""
    parts, entries, width = books.shape

    def sums(batches):
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in _batches(batches):
            x = _parts(batch.column(0), parts, width)
            for p in range(parts):
                code, _ = nearest(x[:, p], books[p])
                count[p] += np.bincount(code, minlength=entries)
                for j in range(width):
                    # ROWS components below 2 ** 31 add up to less than 2 ** 53
                    total[p, :, j] += np.bincount(code, x[:, p, j], entries).astype(np.int64)
        used = np.argwhere(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used[:, 0], pa.int32()),
                    pa.array(used[:, 1], pa.int32()),
                    pa.array(count[tuple(used.T)]),
                    pa.array(list(total[tuple(used.T)]), pa.list_(pa.int64())),
                ],
                names=["part", "entry", "n", "s"],
            )

    return sums


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def codes(batches):
        for batch in _batches(batches):
            x = _parts(batch.column(0), parts, width)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            index = np.stack([c for c, _ in found], axis=1)
            text = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(text, pa.string()), pa.array(error, pa.int64())],
                names=[*batch.schema.names[1:], "code", "error"],
            )

    return codes


def integer_vectors(vectors: DataFrame, vector: str, scale: int, parts: int, more) -> DataFrame:
    """(more..., v): floor(scale * component), zeros added up to a common multiple of ``parts``.

    Rows whose vector is NULL or holds NULL or a non-finite component are left out.  A component so
    large that a squared distance leaves 64 bits raises.
    """
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    kept = vectors.filter(x.isNotNull() & ~bad)
    size = F.size(vector)
    most = kept.agg(F.max(size), F.max(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))))).first()
    width = -(-(most[0] or 0) // parts) * parts
    if width and ((most[1] or 0.0) * scale + 1) ** 2 * 4 * width >= 2.0**63:
        raise ValueError("a component is too large for exact 64-bit distances")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    lifted = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - size))
    return kept.select(*more, lifted.alias("v"))


def learn_codebooks(rows: DataFrame, parts=PARTS, entries=ENTRIES, rounds=ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` of assignment and floored means; None without rows.

    ``rows`` has ``id`` and ``v``.  The first codebooks are the parts of the ``entries`` smallest
    ids (NULL last, repeated ids by vector); an entry without vectors stays.
    """
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    shape = len(first), parts, len(first[0][0]) // parts
    books = np.array([r[0] for r in first], np.int64).reshape(shape).transpose(1, 0, 2)
    for _ in range(rounds):
        books = np.ascontiguousarray(books)
        task = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n bigint, s array<bigint>")
        flat = task.select(
            "part", "entry", "n", F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("share"),
            F.posexplode("s").alias("at", "s"),
        )
        # one sum has a few rows per task, so it is added up in shares first
        some = flat.groupBy("part", "entry", "at", "share").agg(
            F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
        )
        means = some.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = books.copy()
        for r in means.collect():  # parts x entries x width rows
            books[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return Codebooks(np.ascontiguousarray(books))


def vector_codes(
    vectors: DataFrame, row_id: str, vector: str, *more, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """((row_id, more..., code, error), codebooks): every vector by its nearest entries.

    ``code`` has two hexadecimal digits per part, ``error`` is the squared distance summed over the
    parts; at most 256 entries.  Vectors that are NULL or hold NULL, NaN or infinite components are
    left out.  Shorter vectors are lifted with zeros; vectors without components have all
    distances 0.  Rows may repeat, ids may be NULL; other columns are ignored.  An empty table gives
    no rows and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    ship(vectors.sparkSession)
    names = [f"c{i}" for i in range(len(more))]
    kept = [F.col(c).alias(n) for c, n in zip(more, names)]
    rows = settle(integer_vectors(vectors, vector, scale, parts, [F.col(row_id).alias("id"), *kept]))
    books = learn_codebooks(rows, parts, entries, rounds)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{n} {types[n]}" for n in ["id", *names]) + ", code string, error bigint"
    if books is None:
        coded = rows.select("id", *names, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        coded = rows.select("v", "id", *names).mapInArrow(_codes(books.entries), schema)
    back = dict(zip(["id", *names], [row_id, *more]))
    return coded.withColumnsRenamed(back), books


def with_group_error(coded: DataFrame, group: str, error: str = "error", name: str = "group_error") -> DataFrame:
    """``coded`` with the error summed over rows of equal ``group``; NULL groups count as equal."""
    key = unused_name("group", coded.columns)
    marked = coded.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    sums = marked.groupBy(key).agg(F.sum(error).alias(name))
    return lookup_join(marked, sums, key).drop(key)
