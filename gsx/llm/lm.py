"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

N-grams are pairs of token ids of a public vocabulary, so a pair is one exact integer.
Documents are gathered into chunks of about CHUNK tokens and tokenized once; GROUP chunks form a
group.  A chunk explodes into its distinct pairs with their counts.  Those of a group are added up
in PARTS hash parts, which leaves one row per group and distinct pair.  The count table sums these
rows by pair, hash-partitioned, and is joined with them; every group's part then answers its chunks,
and the answers are joined with the chunk's documents, whose log scores are summed per document.

A chunk asks for a pair once, however many of its documents hold it, and a group once for all its
chunks, so a pair of a third of all documents is one row per group in the join.  CHUNK, GROUP and
PARTS bound what a task holds, and rows grow with the number of tokens.  Counts of single tokens have a
size that does not grow with the corpus and are sent to all tasks.

A document's own occurrences are taken off all counts, so its pairs can be unseen and back off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.llm.tokens import word_tokens
from gsx.session import settle, ship

#: Token ids are below this.
VOCABULARY = 1 << 16
#: Token that ends every document.
END = 2
#: What stands before the first token of a document; no token has this id.
BEGIN = VOCABULARY - 1
BACKOFF = 0.4
#: What a token unseen elsewhere counts as.
UNSEEN = 0.5
#: Tokens of a chunk; a longer document is a chunk of its own.
CHUNK = 2_000_000
#: Chunks of a group and parts of its pairs: a task adds up GROUP / PARTS chunks of pairs.
GROUP, PARTS = 64, 32


def _pack(column: np.ndarray, kind: str) -> bytes:
    """Integers as compressed bytes, like places of the numbers together."""
    import zstandard

    raw = np.ascontiguousarray(column.astype(kind).view(np.uint8).reshape(len(column), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _chunks(path: str):
    """Tokenized documents, several to a row."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        end = np.array([END], "<u4").tobytes()
        ids, lengths, held, size, chunk, schema = [], [], [], 0, None, None

        def flush() -> pa.RecordBatch:
            columns = [
                pa.array([chunk], pa.int64()),
                pa.array([ids], pa.list_(schema)),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([_pack(np.concatenate(held), "<u2")], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "lengths", "tokens"])

        for batch in batches:
            schema = batch.schema.field("doc_id").type
            found = words.each(raw.as_py() for raw in batch.column(2))
            for rid, doc_id, pieces in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), found
            ):
                wide = np.frombuffer(b"".join(pieces) + end, "<u4")
                if wide.max() >= BEGIN:
                    raise ValueError(f"token id {wide.max()}: ids must be below {BEGIN}")
                text = wide.astype("<u2")
                chunk = rid if chunk is None else chunk
                ids.append(doc_id)
                lengths.append(len(text))
                held.append(text)
                size += len(text)
                if size >= CHUNK:
                    yield flush()
                    ids, lengths, held, size, chunk = [], [], [], 0, None
        if held:
            yield flush()

    return chunked


def _before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What stands before every token of its document."""
    before = np.append(BEGIN, tokens[:-1])
    before[np.cumsum(lengths) - lengths] = BEGIN
    return before


def _dealt(pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the sorted distinct ``pairs`` that go to each hash part."""
    mixed = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    part = (mixed % np.uint64(PARTS)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        yield int(part[rows[0]]), rows


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for tokens in batch.column(0):
            total += np.bincount(_unpack(tokens.as_py(), "<u2"), minlength=VOCABULARY)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of every chunk with their counts, by hash part."""
    for batch in batches:
        for chunk, group, lengths, tokens in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            ids = _unpack(tokens, "<u2").astype(np.int64)
            pairs, counts = np.unique(_before(ids, np.array(lengths)) * VOCABULARY + ids, return_counts=True)
            rows = [
                (p, _pack(np.diff(pairs[at], prepend=0), "<i8"), _pack(counts[at], "<i4"))
                for p, at in _dealt(pairs)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * len(rows), pa.int64()),
                    pa.array([group] * len(rows), pa.int64()),
                    *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))],
                ],
                names=["chunk", "grp", "part", "pairs", "counts"],
            )


def _group_counts(asked: pd.DataFrame) -> pd.DataFrame:
    """Counts of the distinct pairs that the chunks of a group have in one part."""
    pairs = np.concatenate([np.cumsum(_unpack(p, "<i8")) for p in asked["pairs"]])
    counts = np.concatenate([_unpack(c, "<i4") for c in asked["counts"]])
    known, at = np.unique(pairs, return_inverse=True)
    n = np.bincount(at, weights=counts).astype(np.int64)
    return pd.DataFrame({"grp": asked["grp"].iloc[0], "part": asked["part"].iloc[0], "pair": known, "n": n})


def _answer(asked: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """Totals of the pairs of every chunk of a group in one part."""
    order = np.argsort(totals["pair"].to_numpy())
    known, total = totals["pair"].to_numpy()[order], totals["total"].to_numpy()[order]
    found = [
        _pack(total[np.searchsorted(known, np.cumsum(_unpack(p, "<i8")))], "<i8") for p in asked["pairs"]
    ]
    return pd.DataFrame({"chunk": asked["chunk"], "part": asked["part"], "totals": found})


def _score(single: np.ndarray):
    """Scores of the documents of a chunk from the answers to it."""
    corpus = int(single.sum())
    # as many documents begin as end
    first_of = single.copy()
    first_of[BEGIN] = single[END]

    def scored(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        lengths = np.array(chunk["lengths"].iloc[0], np.int64)
        ids = _unpack(chunk["tokens"].iloc[0], "<u2").astype(np.int64)
        before = _before(ids, lengths)
        pairs = before * VOCABULARY + ids
        known = np.unique(pairs)
        total = np.zeros(len(known), np.int64)
        packed = dict(zip(answers["part"], answers["totals"]))
        for part, at in _dealt(known):
            total[at] = _unpack(packed[part], "<i8")
        doc = np.repeat(np.arange(len(lengths)), lengths)
        # pairs, contexts and tokens of each document with their own counts
        own, n = np.unique(doc * VOCABULARY**2 + pairs, return_counts=True)
        led, led_n = np.unique(doc * VOCABULARY + before, return_counts=True)
        here, here_n = np.unique(doc * VOCABULARY + ids, return_counts=True)
        of, pair = own // VOCABULARY**2, own % VOCABULARY**2
        first, second = pair // VOCABULARY, pair % VOCABULARY
        context = first_of[first] - led_n[np.searchsorted(led, of * VOCABULARY + first)]
        word = single[second] - here_n[np.searchsorted(here, of * VOCABULARY + second)]
        rest = total[np.searchsorted(known, pair)] - n
        seen = rest > 0
        size = (corpus - lengths)[of]
        value = np.where(
            seen,
            np.log(np.maximum(rest, 1)) - np.log(np.maximum(context, 1)),
            np.log(BACKOFF) + np.log(np.maximum(word, UNSEEN)) - np.log(np.maximum(size, 1)),
        )
        score = np.bincount(of, weights=n * value, minlength=len(lengths))
        return pd.DataFrame(
            {
                "doc_id": chunk["doc_ids"].iloc[0],
                "n_tokens": lengths,
                "n_backoff": np.bincount(of, weights=n * ~seen, minlength=len(lengths)).astype(np.int64),
                "log_score": score,
                "mean_score": score / lengths,
            }
        )

    return scored


def backoff_scores(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_backoff, log_score, mean_score.

    A document is its tokens and an end token.  Every one of these is scored after what stands before
    it, the first after the beginning of a document, as c(pair) / c(before) and, where no other
    document has the pair, as 0.4 c(token) / N.  Counts leave the document's own
    out.  A token no other document has counts one half.

    NULL and empty text have the end token only; rows that repeat an id are documents of
    their own and support one another; a NULL id is kept; other columns are ignored; an
    empty table gives no rows.  A document is held whole by one task.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunks = settle(
        rows.mapInArrow(
            _chunks(path), f"chunk bigint, doc_ids array<{kind}>, lengths array<bigint>, tokens binary"
        )
    )
    single = np.zeros(VOCABULARY, np.int64)
    found = chunks.select("tokens").mapInArrow(_token_counts, "token bigint, n bigint")
    for row in found.groupBy("token").agg(F.sum("n").alias("n")).collect():
        single[row["token"]] = row["n"]
    groups = max(1, -(-chunks.count() // GROUP))
    group = F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("grp")
    asked = settle(
        chunks.select("chunk", group, "lengths", "tokens").mapInArrow(
            _ask, "chunk bigint, grp bigint, part bigint, pairs binary, counts binary"
        )
    )
    grams = settle(
        asked.groupBy("grp", "part").applyInPandas(
            _group_counts, "grp bigint, part bigint, pair bigint, n bigint"
        )
    )
    counts = grams.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = grams.join(counts, "pair").select("grp", "part", "pair", "total")
    answers = (
        asked.select("chunk", "grp", "part", "pairs")
        .groupBy("grp", "part")
        .cogroup(totals.groupBy("grp", "part"))
        .applyInPandas(_answer, "chunk bigint, part bigint, totals binary")
    )
    return (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(
            _score(single),
            f"doc_id {kind}, n_tokens bigint, n_backoff bigint, log_score double, mean_score double",
        )
    )
