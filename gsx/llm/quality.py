"""Quality of documents from random-indexing word vectors and a small calibrated network.

Every token falls into one of SLOTS hash slots.  A slot has a sparse random index vector;
its word vector is the sum of the index vectors of all neighbours of its tokens in the
whole corpus.  Tasks sum in integers, so the table does not depend on how rows are dealt.
A document is pooled from its word vectors; a two-layer network, fitted on a bounded
sample of labelled documents, scores the pools, and a temperature fitted on a part of
the sample that the network did not see calibrates the scores.

The slot table has SLOTS x DIM numbers whatever the corpus holds, and so has the
sample, so both may pass through the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.llm.texts import char_pieces
from gsx.llm.tokens import forget
from gsx.llm.workers import released
from gsx.session import settle, ship

SLOTS = 1 << 15
DIM = 64
#: Nonzero entries of an index vector.
ENTRIES = 2
#: Labelled documents that the network is fitted on, the first ones in hash order.
SAMPLE = 20_000
HIDDEN = 32
STEPS = 1500
SEED = 7

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_PIECE = 1 << 18
_FLUSH = 1 << 20
_ROWS = 512
_CACHE = 60_000


class _Slots(dict):
    """Slot of a token, remembered for the tokens met lately."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        slot = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % SLOTS
        return slot


def _slot_pieces(text: str, slots: _Slots) -> Iterator[np.ndarray]:
    for piece in char_pieces(text, _PIECE):
        tokens = _TOKEN.findall(piece)
        yield np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries per slot."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (SLOTS, ENTRIES)), rng.choice([-1.0, 1.0], (SLOTS, ENTRIES))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over one partition, in blocks of slots."""
    forget()
    at, sign = index_vectors()
    table = np.zeros(SLOTS * DIM)
    slots, held, size = _Slots(), [], 0
    gap = np.array([-1])

    def flush() -> None:
        run = np.concatenate(held)
        left, right = run[:-1], run[1:]
        both = (left >= 0) & (right >= 0)
        for centre, other in ((left[both], right[both]), (right[both], left[both])):
            for e in range(ENTRIES):
                table[:] += np.bincount(
                    centre * DIM + at[other, e], weights=sign[other, e], minlength=SLOTS * DIM
                )

    for batch in batches:
        for text in batch.column(0):
            for piece in _slot_pieces(text.as_py() or "", slots):
                held.append(piece)
                size += len(piece)
                if size >= _FLUSH:
                    flush()
                    held, size = [piece[-1:]], 0
            held.append(gap)
    if size:
        flush()
    blocks = table.astype(np.int64).reshape(-1, _ROWS * DIM)
    used = [k for k in range(len(blocks)) if blocks[k].any()]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array([zlib.compress(blocks[k].astype("<i4").tobytes(), 1) for k in used], pa.binary()),
        ],
        names=["block", "sums"],
    )


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(zlib.decompress(sums.as_py()), "<i4")
            total[block] = total.get(block, 0) + part.astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(total), pa.int32()),
            pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary()),
        ],
        names=["block", "sums"],
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x DIM unit vectors (zero for unused slots) from all of ``docs``."""
    parts = docs.select(F.col(text).alias("text")).mapInArrow(released(_contexts), "block int, sums binary")
    added = parts.repartition("block").mapInArrow(released(_add_blocks), "block int, sums binary")
    table = np.zeros((SLOTS // _ROWS, _ROWS * DIM))
    for row in added.collect():
        table[row["block"]] = np.frombuffer(row["sums"], "<i8")
    table = table.reshape(SLOTS, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norm, out=np.zeros_like(table), where=norm > 0).astype(np.float32)


def pool(text: str | None, vectors: np.ndarray, slots: _Slots) -> np.ndarray:
    """Mean and mean square of the word vectors, length of the mean, likeness of neighbours."""
    first, second = np.zeros(DIM), np.zeros(DIM)
    like, n, last = 0.0, 0, None
    for piece in _slot_pieces(text or "", slots):
        if not len(piece):
            continue
        v = vectors[piece]
        first += v.sum(0, dtype=np.float64)
        second += np.einsum("ij,ij->j", v, v, dtype=np.float64)
        like += float(np.einsum("ij,ij->", v[1:], v[:-1], dtype=np.float64))
        if last is not None:
            like += float(last @ v[0])
        last, n = v[-1], n + len(piece)
    if not n:
        return np.zeros(2 * DIM + 2, np.float32)
    first /= n
    return np.concatenate(
        [first, second / n, [np.linalg.norm(first), like / max(n - 1, 1)]]
    ).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised pools; ``base`` answers where nothing could be fitted."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _constant(share: float) -> Network:
    width = 2 * DIM + 2
    odds = np.log(share / (1 - share))
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), odds)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.003) -> Network:
    """Adam on the log loss, STEPS steps at least; a fifth of the rows only sets the temperature.

    With no rows, or rows of one class only, every score is the smoothed share of class 1.
    """
    if len(y) < 10 or y.min() == y.max():
        return _constant((y.sum() + 0.5) / (len(y) + 1))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z, t = (x[used] - mean) / scale, y[used].astype(float)
    params = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batches = max(1, len(t) // batch)
    for _ in range(max(epochs, -(-STEPS // batches))):
        for rows in np.array_split(rng.permutation(len(t)), batches):
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -60, 60)))
            d = (p - t[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back, back.sum(0), hidden.T @ d, d.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                g = g + 1e-4 * params[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (
                    np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8
                )
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(held):
        logits, target = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        losses = [np.mean(np.logaddexp(0, np.where(target == 1, -logits, logits) / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
    return net


def _pooler(vectors) -> Callable:
    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            pools = [pool(t.as_py(), vectors.value, slots).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(pools, pa.binary())], names=["label", "pool"]
            )

    return pooled


def labelled(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from, one per id."""
    part = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))
    return (
        labels.filter((part != 1) & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.min(label).cast("int").alias("label"))
    )


class Classifier:
    """Word vectors of a corpus and the network fitted on its labelled documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality"):
        spark = docs.sparkSession
        ship(spark)
        self.vectors = spark.sparkContext.broadcast(word_vectors(docs, text))
        chosen = settle(
            labelled(labels, doc_id, label).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
        )
        rows = (
            docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
            .join(F.broadcast(chosen), "_id")
            .select("label", "text")
            .mapInArrow(released(_pooler(self.vectors)), "label int, pool binary")
            .collect()
        )
        rows = sorted((r["pool"], r["label"]) for r in rows)
        x = np.array([np.frombuffer(p, np.float32) for p, _ in rows], np.float64).reshape(-1, 2 * DIM + 2)
        self.network = fit(x, np.array([y for _, y in rows], np.int64))

    def _scored(self, texts: pa.Array, slots: _Slots) -> np.ndarray:
        pools = [pool(t.as_py(), self.vectors.value, slots) for t in texts]
        return self.network.scores(np.array(pools, np.float64).reshape(-1, 2 * DIM + 2))

    def __getstate__(self):
        return {"vectors": self.vectors, "network": self.network}

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, score) per row; NULL and empty texts are scored like any other."""

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = _Slots()
            for batch in batches:
                found = self._scored(batch.column(1), slots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(released(scores), f"doc_id {kind}, score double")

    def keep(self, docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
        """Rows of ``docs`` whose score is at least ``least``, all columns, without a shuffle."""
        names = docs.columns
        at = names.index(text)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = _Slots()
            for batch in batches:
                yield batch.filter(pa.array(self._scored(batch.column(at), slots) >= least))

        return docs.mapInArrow(released(kept), docs.schema)


def quality_scores(
    docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality"
) -> DataFrame:
    """One row per input row: doc_id, held_out, score in 0..1, predicted (score >= 0.5).

    ``held_out`` marks ids whose crc32 leaves 1 modulo 3: their labels are never read.  Only
    the text is scored.  Labels other than 0 and 1 are ignored, repeated labels count once
    with the smaller value; a NULL id is not held out.  Empty tables give no rows; without
    usable labels every score is one half or the share of the only class.
    """
    model = Classifier(docs, labels, doc_id, text, label)
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    return model.score(docs, doc_id, text).select(
        "doc_id",
        F.coalesce(part == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
