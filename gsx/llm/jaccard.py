"""Near copies by Jaccard similarity of word shingles: SimHash and MinHash candidates, then the exact share.

Candidates are the texts that ``simhash`` links, fingerprints by pigeonhole blocks.  Those of 64
bits cannot find every similarity of 0.8 (about ten bits differ, often fifteen, and blocks for that many
are three bits wide), so BANDS bands of ROWS MinHashes each give more; a pair at the limit shares one with
probability 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.9999.  Texts that a chain of links connects are
compared with each other, all pairs, on their whole shingle sets; a set of texts too large for
one task is cut into chunks that meet pairwise.  Only a spanning forest leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.llm.components import components
from gsx.llm.exact_dedup import text_digest
from gsx.llm.row_numbers import NumberedRows
from gsx.llm.simhash import fingerprint, keep_first, links
from gsx.llm.texts import word_lists
from gsx.llm.tokens import forget
from gsx.llm.workers import released
from gsx.operators.ordered import lookup_join
from gsx.session import settle, ship

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
#: Texts and bytes of a chunk; one task compares at most two chunks at once.
CHUNK, CHUNK_BYTES = 256, 4 << 20
#: Shingles that are hashed at once.
RUN = 2048

_RNG = np.random.default_rng(5)
_FACTOR = _RNG.integers(1, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1, 2**63, BANDS * ROWS).astype(np.uint64)


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words if fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found, tail = [], []
    for words in word_lists(data.lower()):
        words = tail + words
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
        if len(words) < size:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1]) for a, b in zip(starts, ends[size - 1 :])]
        found.append(np.array(hashes, np.uint64))
    if not found:
        found = [np.array([digest(b" ".join(tail))] if tail else [], np.uint64)]
    return np.unique(np.concatenate(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    import xxhash

    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), RUN):
        low = np.minimum(low, (hashes[at : at + RUN, None] * _FACTOR + _SHIFT).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), k) for k in range(0, len(low), ROWS)]
    return np.array(keys, np.uint64).view(np.int64)


def _signed(size: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, keys, fps = [], [], []
            for item in batch.column(1):
                data = item.as_py()
                sizes.append(len(data))
                keys.append(band_keys(shingles(data, size)))
                fps.append(fingerprint(data))
            ends = pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                ],
                names=["node", "bytes", "keys", "fp"],
            )

    return signed


def forest(sets: list[np.ndarray], similar: float) -> list[int]:
    """Index of the root of each set; sets link at a Jaccard similarity of ``similar`` or more."""
    sizes = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    full = np.flatnonzero(sizes)
    empty = np.flatnonzero(sizes == 0)
    root[empty] = empty[:1]
    if not len(full):
        return root.tolist()
    ids = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes[full])])
    mark = np.zeros(ids.max() + 1, bool)
    for k, i in enumerate(full[:-1]):
        later = full[k + 1 :]
        if (root[later] == root[i]).all():
            continue
        own = ids[starts[k] : starts[k + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[ids[starts[k + 1] :]].astype(np.int64), starts[k + 1 : -1] - starts[k + 1])
        mark[own] = False
        near = later[both / (sizes[i] + sizes[later] - both) >= similar]
        joined = np.unique(root[np.append(near, i)])
        root[np.isin(root, joined)] = joined[0]
    return root.tolist()


def _verified(size: int, similar: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4))
        )
        for _, group in groupby(rows, lambda r: r[:3]):
            names, sets = [], []
            for *_, name, raw in group:
                names.append(name)
                sets.append(shingles(raw.as_py(), size))
            pairs = [(names[i], names[r]) for i, r in enumerate(forest(sets, similar)) if i != r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["a", "b"]
            )

    return verified


def fingerprint_links(signed: DataFrame) -> DataFrame:
    """(node, low): each node, and the smallest one whose SimHash fingerprint ``fp`` links with its own reach."""
    signed = signed.select("node", "fp")
    chains = components(links(signed.select("fp").distinct()), "a", "b").select(F.col("node").alias("fp"), "root")
    named = lookup_join(signed, chains, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    named = settle(named)
    lows = named.groupBy("root").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    return lookup_join(named, lows.filter("low < high").select("root", "low"), "root").select("node", "low")


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similar: float = SIMILAR,
    more: tuple = (),
) -> DataFrame:
    """One row per input row: doc_id, more..., text_sha256, root.

    Texts link when the sets of their runs of ``shingle`` lower-case words (A-Z) have a Jaccard
    similarity of ``similar`` or more; ``root`` is the smallest digest reachable.  A text
    of fewer words has one run, all its words; texts without words link, NULL being empty.
    Candidates share a band or have linked fingerprints (``simhash``).
    BANDS and ROWS are chosen for 0.8; a smaller ``similar`` loses more pairs.  Repeated rows
    are rows of one group; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    sha = text_digest(F.col(text)).alias("text_sha256")
    ids = docs.select(F.col(doc_id).alias("doc_id"), *more, sha)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    texts = docs.select(F.xxhash64(sha).alias("node"), sha, raw)
    signed = settle(
        texts.select("node", "raw").mapInArrow(released(_signed(shingle)), "node bigint, bytes bigint, keys array<bigint>, fp bigint")
    )
    keyed = signed.select("node", F.explode("keys").alias("key"))
    lows = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = lookup_join(keyed, lows.filter("low < high").select("key", "low"), "key").select("node", "low")
    chains = settle(components(shared.union(fingerprint_links(signed)), "node", "low"))
    sizes = chains.join(signed.groupBy("node").agg(F.max("bytes").alias("bytes")), "node").groupBy("root").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks")
    )
    held = lookup_join(texts, chains.join(sizes, "root").select("node", "root", "chunks"), "node")
    own = F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("own"))
    # chunk c meets every other chunk; a single one meets itself
    meets = F.when(F.col("chunks") > 1, others).otherwise(F.array(F.lit(0)))
    dealt = (
        held.dropDuplicates(["text_sha256"])
        .withColumn("own", own)
        .withColumn("other", F.explode(meets))
        .select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "text_sha256", "raw")
    )
    sorted_ = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "text_sha256")
    roots = components(sorted_.mapInArrow(released(_verified(shingle, similar)), "a string, b string"), "a", "b")
    named = lookup_join(ids, roots.withColumnRenamed("node", "text_sha256"), "text_sha256", "left")
    kept = [c for c in ids.columns if c != "text_sha256"]
    return settle(named.select(*kept, "text_sha256", F.coalesce("root", "text_sha256").alias("root")))


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR
) -> DataFrame:
    """``docs`` with one row, of the smallest id, of each group of near copies.

    Ties are broken as in ``simhash.drop_near_copies``.
    """
    table = NumberedRows(docs)
    number = F.col(table.name).alias("rid")
    return keep_first(table, near_groups(table.rows, doc_id, text, shingle, similar, (number,)))
