"""Runs: stretches of words that repeat with a small period, by internal pattern matching.

The words of many texts are put into one sequence, texts parted by words that occur once.  A
run of period q with 2 ** k <= q < 2 ** (k + 1) and four periods holds a block of 2 ** k
words that starts at a multiple of 2 ** k within its first 2 ** k words, and the
block occurs again q words on.  Range successor queries of a wavelet tree over the suffix array
ask for the occurrences of each block that start 2 ** k to 2 ** (k + 1) - 1 words after it.
Three or more form a progression whose step is the block's own period; the block and the progression
then lie in two stretches of that period, and only the distance of their ends can be a new
period.  Longest common extensions over the names of the prefix doubling give each candidate its whole
stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.session import ship

#: A run has at least this many words and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that are searched at once; a longer text is searched alone and whole.
WORDS = 1 << 17


class Suffixes:
    """Suffix array of an integer sequence with the names of its factors of 2 ** k symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        name = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names, self.n, width = [name.astype(np.int32)], n, 1
        while name.max(initial=-1) + 1 < n:
            # a factor that leaves the sequence sorts before its extensions
            key = name * (n + 1)
            key[: n - width] += name[width:] + 1
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            name = np.empty(n, np.int64)
            name[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            self.names.append(name.astype(np.int32))
            width *= 2
        self.array = np.argsort(name, kind="stable")

    def ranges(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Limits in the suffix array of the factors of 2 ** level symbols at ``at``."""
        if level >= len(self.names):
            place = self.names[-1][at].astype(np.int64)
            return place, place + 1
        sorted_ = self.names[level][self.array]
        name = self.names[level][at]
        return np.searchsorted(sorted_, name, "left"), np.searchsorted(sorted_, name, "right")

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from ``a`` and ``b`` on, ``a`` < ``b``."""
        a, b, size = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width = 1 << level
            fits = np.flatnonzero(b + width <= self.n)
            name = self.names[level]
            go = fits[name[a[fits]] == name[b[fits]]]
            a[go] += width
            b[go] += width
            size[go] += width
        return size

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols before ``a`` and ``b``, ``a`` < ``b``."""
        a, b, size = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width = 1 << level
            fits = np.flatnonzero(a >= width)
            name = self.names[level]
            go = fits[name[a[fits] - width] == name[b[fits] - width]]
            a[go] -= width
            b[go] -= width
            size[go] += width
        return size


class WaveletTree:
    """Bits of a sequence of numbers, highest first, each level ordered by the bits above."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest number not below ``least`` among positions low .. high - 1; -1 if none."""
        rank = self._below(low, high, least)
        out = np.full(len(low), -1, np.int64)
        has = np.flatnonzero(rank < high - low)
        out[has] = self._nth(low[has], high[has], rank[has])
        return out

    def _below(self, low, high, least):
        low, high = low.copy(), high.copy()
        over = least >= 1 << self.bits
        count = np.where(over, high - low, 0)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (least >> (self.bits - 1 - level)) & 1 == 1
            l1, h1 = ones[low], ones[high]
            count += np.where(one & ~over, (high - h1) - (low - l1), 0)
            low = np.where(one, zeros + l1, low - l1)
            high = np.where(one, zeros + h1, high - h1)
        return count

    def _nth(self, low, high, rank):
        low, high, rank = low.copy(), high.copy(), rank.copy()
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            l1, h1 = ones[low], ones[high]
            small = (high - h1) - (low - l1)
            one = rank >= small
            rank = np.where(one, rank - small, rank)
            value = value * 2 + one
            low = np.where(one, zeros + l1, low - l1)
            high = np.where(one, zeros + h1, high - h1)
        return value


def next_distance(symbols: np.ndarray) -> np.ndarray:
    """Distance to the next equal symbol; the length of the sequence where there is none."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    same = symbols[order[1:]] == symbols[order[:-1]]
    out = np.full(n, n, np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def open_blocks(distance: np.ndarray, level: int) -> np.ndarray:
    """Starts of the blocks of ``level`` that may lie at the start of a run of that level.

    Every word of the block and of the block after it recurs within less than twice its width.
    """
    n, width = len(distance), 1 << level
    far = np.concatenate([[0], np.cumsum(distance >= 2 * width)])
    start = np.arange(0, n - 2 * width + 1, width)
    return start[far[start + 2 * width] == far[start]]


def all_open_blocks(symbols: np.ndarray) -> dict[int, np.ndarray]:
    """Starts of the open blocks of every level that has any."""
    distance = next_distance(symbols)
    levels = range(max(len(symbols) // 2, 1).bit_length())
    return {k: at for k in levels if len(at := open_blocks(distance, k))}


def runs(symbols: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(start, length, period) of every run, by start and then period.

    A run has at least ``min_words`` symbols and ``min_periods`` (4 or more) of its smallest period,
    and no neighbour extends it.
    """
    if min_periods < 4:
        raise ValueError("blocks are guaranteed from four periods on")
    blocks = all_open_blocks(symbols)
    if not blocks:
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(symbols)
    tree = WaveletTree(suffixes.array)
    found = [_candidates(suffixes, tree, level, at) for level, at in blocks.items()]
    at, period = (np.concatenate(c) for c in zip(*found))
    start = at - suffixes.backward(at, at + period)
    end = at + period + suffixes.forward(at, at + period)
    length = end - start
    good = length >= np.maximum(min_words, min_periods * period)
    rows = np.stack([start[good], length[good], period[good]], axis=1)
    rows = rows[np.lexsort(rows.T[[2, 1, 0]])]
    if len(rows):
        # of equal stretches the smallest period
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        rows = rows[np.lexsort(rows.T[[2, 0]])]
    return rows


def _candidates(suffixes: Suffixes, tree: WaveletTree, level: int, at: np.ndarray):
    """(place, period) that the occurrences of the blocks at ``at`` allow."""
    width = 1 << level
    low, high = suffixes.ranges(level, at)
    more = high - low > 1
    at, low, high = at[more], low[more], high[more]
    seen = []
    least = at + width
    alive = np.arange(len(at))
    for _ in range(3):
        hit = np.full(len(at), -1, np.int64)
        hit[alive] = tree.successor(low[alive], high[alive], least[alive])
        hit[hit >= at + 2 * width] = -1
        seen.append(hit)
        alive = np.flatnonzero(hit >= 0)
        least = hit + 1
    first, second, third = seen
    place = [at[first >= 0], at[(second >= 0) & (third < 0)]]
    period = [(first - at)[first >= 0], (second - at)[(second >= 0) & (third < 0)]]
    many = np.flatnonzero(third >= 0)
    if len(many):
        step = second[many] - first[many]
        own = at[many] + suffixes.forward(at[many], at[many] + step)
        other = first[many] + suffixes.forward(first[many], first[many] + step)
        new = np.flatnonzero(other > own)
        place.append(at[many][new])
        period.append((other - own)[new])
    return np.concatenate(place), np.concatenate(period)


def runs_of_texts(texts: list[list[bytes]], **limits) -> list[np.ndarray]:
    """Runs of every list of words; lists are searched together."""
    ids: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    flat = [ids.setdefault(w, len(ids)) for t in texts for w in t]
    starts = np.cumsum([0, *[s + 1 for s in sizes]])
    symbols = np.empty(starts[-1], np.int64)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    symbols[inside] = flat
    # the symbol after a text occurs once
    symbols[~inside] = len(ids) + np.arange(len(texts))
    # a text without an open block has no run
    blocks = all_open_blocks(symbols)
    held = np.searchsorted(starts, np.unique(np.concatenate([*blocks.values(), []])), "right") - 1
    open_ = np.unique(held)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(open_):
        return out
    parts = [symbols[starts[i] : starts[i + 1]] for i in open_]
    found = runs(np.concatenate(parts), **limits)
    begin = np.cumsum([0, *map(len, parts)])
    cut = np.searchsorted(found[:, 0], begin)
    for i, a, b, s in zip(open_, cut[:-1], cut[1:], begin[:-1]):
        out[i] = found[a:b] - [s, 0, 0]
    return out


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(change)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _groups(texts: list[bytes], size: int) -> Iterator[list[list[bytes]]]:
    """Word lists of consecutive texts, about ``size`` words together."""
    group, total = [], 0
    for text in texts:
        words = text.split()
        if group and total + len(words) > size:
            yield group
            group, total = [], 0
        group.append(words)
        total += len(words) + 1
    if group:
        yield group


def _searched(min_words: int, min_periods: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, all_texts = [], []
            for words in _groups(batch.column(0).to_pylist(), WORDS):
                found = runs_of_texts(words, min_words=min_words, min_periods=min_periods)
                all_runs += [[dict(zip(("start", "length", "period"), r)) for r in f.tolist()] for f in found]
                all_texts += [b" ".join(collapsed(w, f)) for w, f in zip(words, found)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(all_runs, _RUNS), pa.array(all_texts, pa.binary())],
                names=[*batch.schema.names[1:], "runs", "collapsed"],
            )

    return searched


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text="text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """(doc_id, runs, collapsed): one row per input row.

    ``runs`` lists start, length (in words) and period of every run by start and then period;
    ``collapsed`` is the text without the words that a run holds after its first period, words
    joined by one space.  ``text`` is a column or its name.  NULL and empty texts have no runs and
    an empty ``collapsed``.  Rows may repeat; other columns are ignored; an empty table gives no rows.
    Texts are searched whole, in memory of about 8 bytes per word and doubling.
    """
    ship(docs.sparkSession)
    c = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.coalesce(c, F.lit("")).cast("binary").alias("raw"), F.col(doc_id).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        _searched(min_words, min_periods),
        f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary",
    )
    return out.select(F.col("id").alias(doc_id), "runs", F.col("collapsed").cast("string").alias("collapsed"))
