"""Decision trees, forests and boosting on quantile bins.

Bin limits come from the training rows of each training set, once.  A level of a tree is one
aggregation of (tree, node, feature, bin) sums and a choice of the best split of every node,
for all trees of a forest at once.  A training set of at most LOCAL_ROWS rows (some 30 MB at six features)
is grown inside a task instead, all sets and ensembles in one job and the trees of a forest dealt over many tasks; bins, sums and
choices are the same, so the trees are too.

``fit_and_score`` scores rows in the tasks that grow the trees, so a model of a small training set never leaves
its task; of larger sets the driver holds the models of one at a time.  ``fit_trees`` returns fitted models
(at most 2 ** depth nodes a tree), held by the driver as in Spark ML.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gsx.functions.hashing import hash_int
from gsx.operators.bootstrap import GOLDEN, MIX_A, MIX_B, WEIGHTS
from gsx.operators.ordered import percentiles
from gsx.schema import to_long
from gsx.session import settle, ship

SEED = 42
BINS = 256
SKETCH_ACCURACY = 10_000
#: Rows of a training set that one task grows trees on, each as many bytes as features and nine more.
LOCAL_ROWS = 1 << 21
#: Tasks over which the trees of a local forest are dealt at most, and those of all sets of one forest.
TREE_TASKS, SLOTS = 32, 128
#: Boosted trees after which the running scores are written.
SCORE_EVERY = 10
MAX_DEPTH = 30
TINY = 1e-12
#: Gains are compared in steps of a millionth, so that equal ones stay equal in any order of sums.
GAIN_STEPS = 1e6


@dataclass(frozen=True)
class TreeSpec:
    """How an ensemble is grown.

    ``kind`` is ``forest`` (Gini, mean of leaf shares) or ``boosting`` (second order, log loss).
    ``draw`` is ``all``, ``bootstrap`` (Poisson weights) or the share of rows that each tree takes.
    ``features`` is the number a node looks at: ``all`` or ``sqrt``.  ``weights`` is ``balanced``
    (n / 2 n_c), ``positive`` (neg / pos for class 1) or ``none``.
    """

    kind: str = "forest"
    trees: int = 1
    depth: int = MAX_DEPTH
    min_split: int = 2
    min_leaf: int = 1
    features: str = "all"
    draw: object = "all"
    weights: str = "balanced"
    rate: float = 0.1
    penalty: float = 1.0
    min_hessian: float = 0.0
    prior: bool = False
    seed: int = SEED

    def tried(self, d: int) -> int:
        return max(1, int(math.sqrt(d))) if self.features == "sqrt" else d


# Published sizes of the reference models.
SPECS = {
    "decision_tree": TreeSpec(depth=15, min_split=5),
    "shallow_tree": TreeSpec(depth=8, min_split=5),
    "random_forest": TreeSpec(trees=150, depth=20, min_split=5, features="sqrt", draw="bootstrap"),
    "forest_500": TreeSpec(trees=500, features="sqrt", draw="bootstrap"),
    "forest_300": TreeSpec(trees=300, depth=15, features="sqrt", draw="bootstrap"),
    "forest_100": TreeSpec(trees=100, depth=10, features="sqrt", draw="bootstrap"),
    "forest_small": TreeSpec(trees=100, depth=3, min_leaf=10, features="sqrt", draw="bootstrap"),
    "boosting": TreeSpec("boosting", 300, 4, draw=0.8, weights="none", rate=0.05, penalty=0.0, prior=True),
    "boosting_150": TreeSpec("boosting", 150, 7, weights="positive", rate=0.05, min_hessian=1.0),
    "boosting_300": TreeSpec("boosting", 300, 5, weights="positive", rate=0.05, min_hessian=1.0),
}


@dataclass
class Tree:
    """Nodes as arrays; ``left`` is -1 in a leaf, the right child follows the left one."""

    feature: list = field(default_factory=lambda: [0])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    key: list = field(default_factory=lambda: [0])
    #: Gain of all splits of every feature that has one.
    gains: dict = field(default_factory=dict)

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        at = len(self.left)
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, at
        for side in (1, 2):
            self.feature.append(0)
            self.bin.append(0)
            self.left.append(-1)
            self.value.append(0.0)
            self.key.append(_mixed(2 * self.key[node] + side))
        return at, at + 1

    def split_all(self, nodes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Children of many nodes, each split at (feature, bin); keys and values are the caller's."""
        at = len(self.left)
        for node, (feature, bin_), left in zip(nodes.tolist(), cuts.tolist(), range(at, at + 2 * len(nodes), 2)):
            self.feature[node], self.bin[node], self.left[node] = feature, bin_, left
        more = 2 * len(nodes)
        self.feature += [0] * more
        self.bin += [0] * more
        self.left += [-1] * more
        return np.arange(at, at + more)


@dataclass
class Ensemble:
    """A fitted model: limits of the bins, medians of the training rows, trees."""

    spec: TreeSpec
    features: tuple
    edges: list
    medians: list
    trees: list
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned_values(x, self.edges, self.medians)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of raw values."""
        total = tree_sum(self.bins(x), self.trees)
        return total / max(len(self.trees), 1) if self.spec.kind == "forest" else boosted(total, self.base)


def _mixed(x: int) -> int:
    """One SplitMix64 step, as a number below 2 ** 62."""
    x = (x + GOLDEN) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * MIX_A) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * MIX_B) & (2**64 - 1)
    return (x ^ (x >> 31)) >> 2


def allowed_features(key: int, d: int, tried: int) -> list[int]:
    """The features that the node of this key looks at."""
    if tried >= d:
        return list(range(d))
    order = sorted(range(d), key=lambda f: _mixed(key + f * 0x10001 + 1))
    return sorted(order[:tried])


def _mixed_all(x: np.ndarray) -> np.ndarray:
    """``_mixed`` of every number of an array."""
    x = x.astype(np.uint64) + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(2)


def allowed_all(keys: np.ndarray, d: int, tried: int) -> np.ndarray:
    """``allowed_features`` of many nodes as flags (node, feature)."""
    looks = np.ones((len(keys), d), bool)
    if tried < d:
        order = np.argsort(
            _mixed_all(keys.astype(np.uint64)[:, None] + np.arange(d, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(1)),
            axis=1, kind="stable",
        )
        np.put_along_axis(looks, order[:, tried:], False, axis=1)
    return looks


def drawn(h: np.ndarray, tree: int, spec: TreeSpec) -> np.ndarray:
    """How often each row is drawn for a tree, from the hash of the row."""
    if spec.draw == "all":
        return np.ones(len(h))
    x = h.astype(np.uint64) + np.uint64(((spec.seed + tree + 1) * GOLDEN) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    word = (x >> np.uint64(48)).astype(np.int64)
    if spec.draw == "bootstrap":
        return WEIGHTS[word].astype(float)
    return (word < spec.draw * 2**16).astype(float)


def binned_values(x: np.ndarray, edges, medians) -> np.ndarray:
    """Bin numbers of raw values; a missing value is the median of the training rows."""
    out = np.empty(x.shape, np.uint8)
    for f, (limits, median) in enumerate(zip(edges, medians)):
        column = np.where(np.isnan(x[:, f]), median, x[:, f])
        out[:, f] = np.searchsorted(limits, column, "left")
    return out


def route(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """Leaf of every row."""
    feature, cut, left = np.asarray(tree.feature), np.asarray(tree.bin), np.asarray(tree.left)
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        inner = rows[left[node[rows]] >= 0]
        if not len(inner):
            return node
        at = node[inner]
        node[inner] = left[at] + (bins[inner, feature[at]] > cut[at])
        rows = inner


def tree_sum(bins: np.ndarray, trees) -> np.ndarray:
    """Sum of the leaf values of every row."""
    total = np.zeros(len(bins))
    for tree in trees:
        total += np.asarray(tree.value)[route(bins, tree)]
    return total


def boosted(total: np.ndarray, base: float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(base + total)))


def class_weight(spec: TreeSpec, n_pos: float, n_neg: float) -> tuple[float, float]:
    """Weights of class 0 and class 1."""
    n = n_pos + n_neg
    if spec.weights == "balanced":
        return n / (2.0 * max(n_neg, 1)), n / (2.0 * max(n_pos, 1))
    return 1.0, n_neg / (n_pos + 1e-6) if spec.weights == "positive" else 1.0


def _base(spec: TreeSpec, n_pos: float, n_neg: float) -> float:
    return math.log(n_pos / n_neg) if spec.prior and n_pos and n_neg else 0.0


def row_sums(spec: TreeSpec, y, w, score):
    """The two sums a row brings: class weights (Gini) or gradient and Hessian (boosting)."""
    if spec.kind == "forest":
        return w * (1 - y), w * y
    p = 1.0 / (1.0 + np.exp(-score))
    return w * (p - y), w * p * (1 - p)


def purity(spec: TreeSpec, a, b):
    """What a split increases: sum of squares by weight, or G² / (H + penalty)."""
    if spec.kind == "forest":
        return (a * a + b * b) / np.maximum(a + b, TINY)
    return a * a / np.maximum(b + spec.penalty, TINY)


def leaf_value(spec: TreeSpec, a: float, b: float) -> float:
    if spec.kind == "forest":
        return b / (a + b) if a + b > 0 else 0.5
    return -spec.rate * a / (b + spec.penalty) if b + spec.penalty > TINY else 0.0


# --- growth inside a task ----------------------------------------------------------------------


def _segments(slot: np.ndarray, n: int, *values):
    return [np.bincount(slot, v, n) for v in values]


def leaf_values(spec: TreeSpec, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``leaf_value`` of many nodes."""
    down = a + b if spec.kind == "forest" else b + spec.penalty
    up, none = (b, 0.5) if spec.kind == "forest" else (-spec.rate * a, 0.0)
    known = down > (0 if spec.kind == "forest" else TINY)
    return np.where(known, up / np.where(known, down, 1.0), none)


def _gains(spec: TreeSpec, left, total, whole) -> np.ndarray:
    """Gain of every cut in steps, -1 where it is not allowed; ``left`` and ``total`` are a, b and count."""
    (la, lb, lc), (ta, tb, tc) = left, total
    ra, rb, rc = ta - la, tb - lb, tc - lc
    good = (lc >= spec.min_leaf) & (rc >= max(spec.min_leaf, 1))
    if spec.kind == "boosting":
        good &= (lb >= spec.min_hessian) & (rb >= spec.min_hessian)
    gain = purity(spec, la, lb) + purity(spec, ra, rb) - whole
    return np.where(good, np.rint(gain * GAIN_STEPS), -1)


def _cuts_by_bin(slot, bin_, a, b, spec: TreeSpec, total, whole):
    """(gain, bin) of the best cut of every node, from one sum per node and bin."""
    n = len(whole)
    key = slot * BINS + bin_
    left = [np.cumsum(np.bincount(key, v, n * BINS).reshape(n, BINS), axis=1) for v in (a, b, None)]
    gain = _gains(spec, left, [t[:, None] for t in total], whole[:, None])
    # a bin without rows gives the cut of the bin before it, which is the first of the two
    at = gain.argmax(axis=1)
    return gain[np.arange(n), at], at


def _cuts_by_rows(slot, bin_, a, b, spec: TreeSpec, total, whole):
    """The same from sorted rows, for nodes that have fewer rows than bins."""
    n = len(whole)
    order = np.argsort(bin_, kind="stable")
    order = order[np.argsort(slot[order].astype(np.uint16) if n <= 1 << 16 else slot[order], kind="stable")]
    slot, bin_ = slot[order], bin_[order]
    start = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (bin_[1:] != bin_[:-1])))
    owner = slot[start]
    sums = [np.add.reduceat(v[order], start) for v in (a, b)] + [np.diff(np.append(start, len(slot)))]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sizes = np.diff(np.append(first, len(owner)))
    left = []
    for v in sums:
        upto = np.cumsum(v)
        left.append(upto - np.repeat(upto[first] - v[first], sizes))
    gain = _gains(spec, left, [t[owner] for t in total], whole[owner])
    top = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == np.repeat(top, sizes))
    node, place = np.unique(owner[hit], return_index=True)
    best, at = np.full(n, -1.0), np.zeros(n, np.int64)
    best[node], at[node] = gain[hit[place]], bin_[start[hit[place]]]
    return best, at


def grow(bins: np.ndarray, a: np.ndarray, b: np.ndarray, spec: TreeSpec, number: int) -> Tree:
    """One tree from the drawn rows: bins and the two sums of each."""
    tree, d = Tree(), bins.shape[1]
    tree.key[0] = _mixed(spec.seed * 100_003 + number)
    tried = spec.tried(d)
    open_, slot = np.zeros(1, np.int64), np.zeros(len(bins), np.int64)
    keys = np.array(tree.key, np.uint64)
    value = [np.zeros(1)]
    gains = np.zeros(d)
    for depth in range(spec.depth + 1):
        n = len(open_)
        total = ta, tb, tc = _segments(slot, n, a, b, None)
        value[-1] = leaf_values(spec, ta, tb)
        may = tc >= max(spec.min_split, 2 * spec.min_leaf)
        if spec.kind == "forest":
            may &= (ta > 0) & (tb > 0)
        if depth == spec.depth or not may.any():
            break
        looks = allowed_all(keys, d, tried) & may[:, None]
        best, where = np.zeros(n), np.full((n, 2), -1)
        whole = purity(spec, ta, tb)
        for f in np.flatnonzero(looks.any(axis=0)):
            if looks[:, f].all():
                s, x, u, v = slot, bins[:, f], a, b
            else:
                mine = np.flatnonzero(looks[slot, f])
                s, x, u, v = slot[mine], bins[mine, f], a[mine], b[mine]
            cuts = _cuts_by_bin if n * BINS <= 2 * len(s) else _cuts_by_rows
            gain, at = cuts(s, x, u, v, spec, total, whole)
            # of equal gains the earlier feature and the lower bin stay
            better = looks[:, f] & (gain > best)
            best[better] = gain[better]
            where[better] = np.stack([np.full(n, f), at], axis=1)[better]
        split = np.flatnonzero(where[:, 0] >= 0)
        if not len(split):
            break
        gains += np.bincount(where[split, 0], best[split], d) / GAIN_STEPS
        children = tree.split_all(open_[split], where[split])
        child = np.full(n, -1)
        child[split] = 2 * np.arange(len(split))
        stay = np.flatnonzero(child[slot] >= 0)
        slot, bins, a, b = slot[stay], bins[stay], a[stay], b[stay]
        slot = child[slot] + (bins[np.arange(len(slot)), where[slot, 0]] > where[slot, 1])
        parents = np.repeat(keys[split], 2) * np.uint64(2)
        keys = _mixed_all(parents + np.tile(np.array([1, 2], np.uint64), len(split)))
        open_ = children
        value.append(None)
    tree.value = np.concatenate(value).tolist()
    tree.gains = {int(f): float(gains[f]) for f in np.flatnonzero(gains)}
    return tree


def grow_local(bins, y, h, spec: TreeSpec, numbers, counts) -> Iterator[Tree]:
    """Trees of these numbers (a forest), or all of them in turn (boosting), in typed arrays."""
    w0, w1 = class_weight(spec, *counts)
    w = np.where(y == 1, w1, w0)
    score = np.full(len(y), _base(spec, *counts))
    for number in numbers:
        times = drawn(h, number, spec)
        a, b = row_sums(spec, y, w * times, score)
        held = times > 0
        tree = grow(bins[held], a[held], b[held], spec, number)
        if spec.kind == "boosting":
            score += np.asarray(tree.value)[route(bins, tree)]
        yield compact(tree.feature, tree.bin, tree.left, tree.value, tree.gains)


# --- inputs ---------------------------------------------------------------------------------


def bin_limits(train: DataFrame, features, part: str) -> dict:
    """{part: (limits per feature, medians)} of the training rows of every part."""
    x = [F.col(f).cast("double") for f in features]
    long = to_long(train, [part], features)
    med = {(r[part], r["feature"]): r["q0"] for r in percentiles(long, [part, "feature"], "value", (0.5,)).collect()}
    probs = [k / BINS for k in range(1, BINS)]
    rows = train.groupBy(part).agg(*[F.percentile_approx(v, probs, SKETCH_ACCURACY).alias(f"q{i}") for i, v in enumerate(x)])
    return {
        r[part]: (
            [np.unique(np.array(r[f"q{i}"] or [], float)) for i in range(len(features))],
            [float(med.get((r[part], f)) or 0.0) for f in features],
        )
        for r in rows.collect()  # BINS numbers per feature and part
    }


def _values(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d)


def _raw(df: DataFrame, features):
    """NaN stands for a missing value inside tasks."""
    nan = F.lit(float("nan"))
    return F.array(*[F.coalesce(F.col(f).cast("double"), nan) for f in features])


def binned(train: DataFrame, features, label, row_id, part: str, limits: dict, seed=SEED) -> DataFrame:
    """(part, y, h, bins): one row per training row, settled."""
    d = len(features)
    rows = train.filter(F.col(label).isin(0, 1)).select(
        _raw(train, features).alias("x"), F.col(part).cast("string").alias("part"),
        F.col(label).cast("int").alias("y"), hash_int(seed, row_id).alias("h"),
    )
    named = {str(k): v for k, v in limits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, parts = _values(batch.column(0), d), np.array(batch.column(1).to_pylist())
            out = np.zeros(x.shape, np.uint8)
            for p in np.unique(parts):
                out[parts == p] = binned_values(x[parts == p], *named[p])
            data = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], data], names=["part", "y", "h", "bins"])

    return settle(rows.mapInArrow(run, "part string, y int, h bigint, bins binary"))


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), d)


TREE_SCHEMA = "slot int, number int, feature binary, bin binary, `left` binary, value binary, gains map<int,double>"


def compact(feature, bin_, left, value, gains) -> Tree:
    """A grown tree in typed arrays, from arrays or their bytes."""
    def held(code, v):
        out = array(code)
        out.frombytes(v) if isinstance(v, (bytes, bytearray)) else out.extend(v)
        return out

    return Tree(held("h", feature), held("B", bin_), held("i", left), held("d", value), [], dict(gains))


def _blocks(rows: DataFrame, d: int) -> DataFrame:
    """(part, h, y, bins): the rows of a part in blocks of bytes, settled; d + 9 bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy()
            y, h = batch.column("y").to_numpy().astype(np.uint8), batch.column("h").to_numpy()
            bins = _matrix(batch.column("bins").to_pylist(), d)
            names, out = parts.dictionary.to_pylist(), []
            for k in np.unique(code):
                mine = code == k
                out.append((names[k], h[mine].tobytes(), y[mine].tobytes(), bins[mine].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), *[pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3)]],
                names=["part", "h", "y", "bins"],
            )

    return settle(rows.select("part", "y", "h", "bins").mapInArrow(run, "part string, h binary, y binary, bins binary"))


def _slots(names, specs: dict) -> list[tuple]:
    """(part, spec, task, tasks): a slot is one training set, one spec and some of its tree numbers."""
    forest_tasks = max(1, min(TREE_TASKS, -(-SLOTS // max(len(names), 1))))
    slots = []
    for part in names:
        for name, spec in specs.items():
            tasks = min(forest_tasks, spec.trees) if spec.kind == "forest" else 1
            slots += [(part, name, task, tasks) for task in range(tasks)]
    return slots


def _dealt(blocks: DataFrame, slots: list[tuple]) -> DataFrame:
    """Blocks of a part at each of its slots; a slot lies in a partition with few others."""
    table = blocks.sparkSession.createDataFrame([(i, s[0]) for i, s in enumerate(slots)], "slot int, part string")
    return blocks.join(F.broadcast(table), "part").repartitionByRange(len(slots), "slot")


def _slot_trees(slot: tuple, h, y, bins, d: int, specs: dict, counts: dict) -> Iterator[tuple[int, Tree]]:
    """Number and tree of one slot after the other, from the blocks of its training rows."""
    part, name, task, tasks = slot
    h, y = np.frombuffer(b"".join(h), np.int64), np.frombuffer(b"".join(y), np.uint8)
    bins = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, d)
    # the sort makes the trees independent of the order of rows
    order = np.lexsort((y, *bins.T[::-1], h))
    numbers = range(task, specs[name].trees, tasks)
    yield from zip(numbers, grow_local(bins[order], y[order].astype(np.int64), h[order], specs[name], numbers, counts[part]))


def _fit_local(rows: DataFrame, names, d: int, specs: dict, counts: dict) -> dict:
    """{(part, name): trees} for small training sets; all specs grow at once."""
    slots = _slots(names, specs)
    dealt = _dealt(_blocks(rows, d), slots)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            [
                (key[0], k, *[v.tobytes() for v in (t.feature, t.bin, t.left, t.value)], t.gains)
                for k, t in _slot_trees(slots[key[0]], pdf["h"], pdf["y"], pdf["bins"], d, specs, counts)
            ],
            columns=["slot", "number", "feature", "bin", "left", "value", "gains"],
        )

    found: dict = {}
    for r in dealt.groupBy("slot").applyInPandas(run, TREE_SCHEMA).collect():
        part, name = slots[r["slot"]][:2]
        found.setdefault((part, name), {})[r["number"]] = compact(
            r["feature"], r["bin"], r["left"], r["value"], r["gains"]
        )
    return {p: [t[k] for k in sorted(t)] for p, t in found.items()}


def _asked_blocks(asked: DataFrame, features, cell: str, row: str, limits: dict, names) -> DataFrame:
    """(block, part, ids, bins): rows to be scored by the model of their cell, in blocks of bytes, settled."""
    d = len(features)
    rows = asked.select(_raw(asked, features).alias("x"), F.col(cell).cast("string").alias("part"), row)
    rows = rows.filter(F.col("part").isin(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _values(batch.column(0), d), batch.column(2).to_numpy()
            parts = batch.column(1).dictionary_encode()
            code, out = parts.indices.to_numpy(), []
            for k, part in enumerate(parts.dictionary.to_pylist()):
                mine = code == k
                out.append((part, ids[mine].tobytes(), binned_values(x[mine], *limits[part]).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), *[pa.array([r[i] for r in out], pa.binary()) for i in (1, 2)]],
                names=["part", "ids", "bins"],
            )

    blocks = rows.sortWithinPartitions("part").mapInArrow(run, "part string, ids binary, bins binary")
    return settle(blocks.withColumn("block", F.monotonically_increasing_id()))


def _score_local(rows: DataFrame, asked: DataFrame, names, d: int, specs: dict, counts: dict, row: str) -> DataFrame:
    """(row, one column per spec): blocks of asked rows scored by the trees of their part.

    A slot grows its trees and adds them up over the blocks that ask its part; only the sums leave the task.
    """
    slots = _slots(names, specs)
    pieces = list(dict.fromkeys(s[1:3] for s in slots))
    at = {piece: i for i, piece in enumerate(pieces)}
    none = F.lit(b"")
    train = _blocks(rows, d).select("part", F.lit(-1).cast("bigint").alias("block"), "h", "y", "bins")
    both = train.unionByName(asked.select("part", "block", none.alias("h"), none.alias("y"), "bins"))
    # a slot's training rows come first
    dealt = _dealt(both, slots).select("slot", "block", "h", "y", "bins").sortWithinPartitions("slot", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, grown = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                now, block, *data = [batch.column(c)[i].as_py() for c in range(5)]
                if now != slot:
                    slot, held, grown = now, [], None
                if block < 0:
                    held.append(data)
                    continue
                part, name, task, _ = slots[slot]
                if grown is None:
                    grown = [t for _, t in _slot_trees(slots[slot], *zip(*held), d, specs, counts)]
                    held = []
                total = tree_sum(np.frombuffer(data[2], np.uint8).reshape(-1, d), grown)
                if specs[name].kind == "boosting":
                    total = boosted(total, _base(specs[name], *counts[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([at[name, task]], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                    names=["block", "piece", "v"],
                )

    def joined(table: pa.Table) -> pa.Table:
        found = dict(zip(table.column("piece").to_pylist(), table.column("v").to_pylist()))
        columns = {row: pa.array(np.frombuffer(found[-1], np.int64))}
        for name, spec in specs.items():
            sums = [np.frombuffer(found[i]) for i, piece in enumerate(pieces) if piece[0] == name]
            total = sum(sums[1:], sums[0])
            columns[name] = pa.array(total / max(spec.trees, 1) if spec.kind == "forest" else total)
        return pa.table(columns)

    sums = dealt.mapInArrow(run, "block bigint, piece int, v binary")
    sums = sums.unionByName(asked.select("block", F.lit(-1).alias("piece"), F.col("ids").alias("v")))
    return sums.groupBy("block").applyInArrow(joined, ", ".join([f"`{row}` bigint", *[f"`{n}` double" for n in specs]]))


# --- growth level by level --------------------------------------------------------------------


def _level(rows: DataFrame, d: int, spec: TreeSpec, counts, trees: dict, open_: dict, prior: list) -> DataFrame:
    """(tree, node, f, bin, a, b, c): sums of the open nodes, one row per filled bin."""
    w0, w1 = class_weight(spec, *counts)
    tried = spec.tried(d)
    looks = {
        k: {node: allowed_features(trees[k].key[node], d, tried) for node in nodes} for k, nodes in open_.items()
    }

    def run(batches):
        for batch in batches:
            bins = _matrix(batch.column("bins").to_pylist(), d)
            y, h = batch.column("y").to_numpy(), batch.column("h").to_numpy()
            score = batch.column("score").to_numpy(zero_copy_only=False).copy()
            for t in prior:
                score += np.asarray(t.value)[route(bins, t)]
            w = np.where(y == 1, w1, w0)
            for k, nodes in looks.items():
                times = drawn(h, k, spec)
                a, b = row_sums(spec, y, w * times, score)
                at = route(bins, trees[k])
                look = np.zeros((len(trees[k].left), d), bool)
                for node, fs in nodes.items():
                    look[node, fs] = True
                for f in range(d):
                    mine = np.flatnonzero(look[at, f] & (times > 0))
                    if not len(mine):
                        continue
                    key, place = np.unique(at[mine] * BINS + bins[mine, f], return_inverse=True)
                    sums = _segments(place, len(key), a[mine], b[mine], np.ones(len(mine)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(key), k), pa.int32()),
                            pa.array(key // BINS, pa.int32()),
                            pa.array(np.full(len(key), f), pa.int32()),
                            pa.array(key % BINS, pa.int32()),
                            *[pa.array(s) for s in sums],
                        ],
                        names=["tree", "node", "f", "bin", "a", "b", "c"],
                    )

    sums = rows.mapInArrow(run, "tree int, node int, f int, bin int, a double, b double, c double")
    return sums.groupBy("tree", "node", "f", "bin").agg(*[F.sum(v).alias(v) for v in ("a", "b", "c")])


def best_splits(sums: DataFrame, spec: TreeSpec) -> DataFrame:
    """One row per (tree, node): its totals and its best split, NULL where none is allowed."""
    part = Window.partitionBy("tree", "node", "f")
    upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    names = ("a", "b", "c")
    cut = sums.select(
        "tree", "node", "f", "bin",
        *[F.sum(v).over(upto).alias(f"l{v}") for v in names], *[F.sum(v).over(part).alias(f"t{v}") for v in names],
    ).withColumns({f"r{v}": F.col(f"t{v}") - F.col(f"l{v}") for v in names})

    def pure(side):
        a, b = F.col(f"{side}a"), F.col(f"{side}b")
        if spec.kind == "forest":
            return (a * a + b * b) / F.greatest(a + b, F.lit(TINY))
        return a * a / F.greatest(b + spec.penalty, F.lit(TINY))

    good = (F.col("lc") >= spec.min_leaf) & (F.col("rc") >= max(spec.min_leaf, 1)) & (F.col("tc") >= spec.min_split)
    if spec.kind == "boosting":
        good = good & (F.col("lb") >= spec.min_hessian) & (F.col("rb") >= spec.min_hessian)
    gain = F.when(good, pure("l") + pure("r") - pure("t"))
    # of equal gains the earlier feature and the lower bin win
    steps = F.rint(gain * GAIN_STEPS)
    order = F.struct(steps.alias("g"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("b"), "la", "lb", "lc")
    chosen = F.max(F.when(steps > 0, order)).alias("s")
    return cut.groupBy("tree", "node").agg(
        chosen, *[F.max(F.struct(-F.col("f"), -F.col("bin"), f"t{v}"))[f"t{v}"].alias(f"t{v}") for v in names]
    )


def _fit_levels(rows: DataFrame, d: int, spec: TreeSpec, counts) -> list[Tree]:
    """Trees of a large training set: one aggregation per level."""
    base = _base(spec, *counts)
    rows = rows.select("bins", "y", "h").withColumn("score", F.lit(base))
    done: list[Tree] = []
    rounds = [range(spec.trees)] if spec.kind == "forest" else [[k] for k in range(spec.trees)]
    prior: list[Tree] = []
    for numbers in rounds:
        trees = {k: Tree(key=[_mixed(spec.seed * 100_003 + k)]) for k in numbers}
        open_ = {k: [0] for k in numbers}
        for depth in range(spec.depth + 1):
            found = best_splits(_level(rows, d, spec, counts, trees, open_, prior), spec).collect()
            grown: dict = {}
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                tree = trees[r["tree"]]
                tree.value[r["node"]] = leaf_value(spec, r["ta"], r["tb"])
                pure = spec.kind == "forest" and not (r["ta"] > 0 and r["tb"] > 0)
                if depth < spec.depth and r["s"] is not None and not pure:
                    f = -r["s"]["f"]
                    tree.gains[f] = tree.gains.get(f, 0.0) + r["s"]["g"] / GAIN_STEPS
                    grown.setdefault(r["tree"], []).extend(tree.split(r["node"], f, -r["s"]["b"]))
            open_ = grown
            if not grown:
                break
        done += [trees[k] for k in numbers]
        if spec.kind == "boosting":
            prior.append(trees[numbers[0]])
            if len(prior) == SCORE_EVERY:
                rows = settle(_with_scores(rows, d, prior))
                prior = []
    return [compact(t.feature, t.bin, t.left, t.value, t.gains) for t in done]


def _with_scores(rows: DataFrame, d: int, trees: list) -> DataFrame:
    def run(batches):
        for batch in batches:
            bins = _matrix(batch.column("bins").to_pylist(), d)
            score = batch.column("score").to_numpy(zero_copy_only=False).copy()
            for t in trees:
                score += np.asarray(t.value)[route(bins, t)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=batch.schema.names)

    return rows.mapInArrow(run, "bins binary, y int, h bigint, score double")


# --- fit and score ----------------------------------------------------------------------------


def _prepared(train: DataFrame, features, label: str, row_id: str, part: str) -> tuple[DataFrame, dict, dict]:
    """Binned training rows, limits of every part, and class sizes of every part that has both classes."""
    ship(train.sparkSession)
    known = train.filter(F.col(label).isin(0, 1) & F.col(part).isNotNull())
    limits = bin_limits(known, features, part)
    rows = binned(known, features, label, row_id, part, limits)
    counts = {
        r["part"]: (r["p"], r["n"])
        for r in rows.groupBy("part").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).collect()
    }
    return rows, limits, {p: c for p, c in counts.items() if min(c) > 0}


def _large_models(rows: DataFrame, features, name_of: dict, limits: dict, part: str, specs: dict, counts) -> dict:
    """{(part, name): Ensemble} of one training set, grown by levels."""
    mine = rows.filter(F.col("part") == part)
    return {
        (name_of[part], name): Ensemble(
            spec, tuple(features), *limits[name_of[part]], _fit_levels(mine, len(features), spec, counts), _base(spec, *counts)
        )
        for name, spec in specs.items()
    }


def fit_trees(
    train: DataFrame, features, label: str, row_id: str, part: str, specs: dict, local_rows: int = LOCAL_ROWS
) -> dict:
    """{(part, name): Ensemble}: every spec fitted on the training rows of every part.

    Rows without a label of 0 or 1 are left out; a part of one class gets no model.
    """
    rows, limits, counts = _prepared(train, features, label, row_id, part)
    small = [p for p in counts if sum(counts[p]) <= local_rows]
    named = {str(k): k for k in limits}
    grown = _fit_local(rows.filter(F.col("part").isin(*small)), small, len(features), specs, counts) if small else {}
    out = {}
    for (p, name), trees in grown.items():
        out[named[p], name] = Ensemble(
            specs[name], tuple(features), *limits[named[p]], trees, _base(specs[name], *counts[p])
        )
    for p in counts:
        if p not in small:
            out |= _large_models(rows, features, named, limits, p, specs, counts[p])
    return out


def fit_and_score(
    train: DataFrame, asked: DataFrame, features, label: str, row_id: str, part: str, specs: dict, cell: str,
    local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """``asked`` with one column per spec: the probability under the model of the part named by ``cell``.

    The models are those of ``fit_trees``; a row whose cell has none gets NULL.  Trees of a part of at most
    ``local_rows`` training rows stay in the tasks that grow them.
    """
    rows, limits, counts = _prepared(train, features, label, row_id, part)
    row = "_row"
    while row in asked.columns:
        row += "_"
    # written, so that every later read gives a row the same number
    numbered = settle(asked.withColumn(row, F.monotonically_increasing_id()))
    named = {str(k): k for k in limits}
    small = [p for p in counts if sum(counts[p]) <= local_rows]
    scores = []
    if small:
        blocks = _asked_blocks(numbered, features, cell, row, {str(k): v for k, v in limits.items()}, small)
        mine = rows.filter(F.col("part").isin(*small))
        scores.append(_score_local(mine, blocks, small, len(features), specs, counts, row))
    for p in counts:
        if p not in small:
            models = _large_models(rows, features, named, limits, p, specs, counts[p])
            mine = numbered.filter(F.col(cell) == named[p])
            for (_, name), model in models.items():
                mine = score_trees(mine, model, name)
            scores.append(settle(mine.select(row, *specs)))
    if not scores:
        return numbered.select(*asked.columns, *[F.lit(None).cast("double").alias(n) for n in specs])
    return numbered.join(reduce(DataFrame.unionByName, scores), row, "left").select(*asked.columns, *specs)


def score_trees(rows: DataFrame, model: Ensemble, name: str = "score") -> DataFrame:
    """``rows`` with the probability of class 1 under one model."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d = len(model.features)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.stack(x.to_numpy()).reshape(len(x), d).astype(float)))

    return rows.withColumn(name, scored(_raw(rows, model.features)))


def importances(
    train: DataFrame, features, label: str, row_id: str, part: str, spec: TreeSpec, local_rows: int = LOCAL_ROWS
) -> DataFrame:
    """(part, rank, feature, importance): impurity importance of every feature in every part.

    The gains of a tree's splits by feature, as shares of the tree, are averaged over the trees and add up to 1;
    equal ones are ranked by name.  A forest without splits gives zeros, a part of one class no rows.
    """
    found = []
    for (name, _), model in fit_trees(train, features, label, row_id, part, {"m": spec}, local_rows).items():
        total = np.zeros(len(features))
        for tree in model.trees:
            whole = sum(tree.gains.values())
            for f, gain in tree.gains.items():
                total[f] += gain / whole
        shares = (total / (total.sum() or 1.0)).tolist()
        order = sorted(zip(features, shares), key=lambda r: (-r[1], r[0]))
        found += [(name, i + 1, f, v) for i, (f, v) in enumerate(order)]
    kind = train.schema[part].dataType.simpleString()
    return train.sparkSession.createDataFrame(found, f"part {kind}, rank int, feature string, importance double")


def transfer_scores(rows: DataFrame, features, label: str, row_id: str, part: str, names, keep=()) -> DataFrame:
    """(row_id, label, keep..., train, test, model, score): the rows of every part scored by the models of
    every other one.  ``names`` are keys of SPECS, or a dictionary of specs."""
    specs = names if isinstance(names, dict) else {n: SPECS[n] for n in names}
    parts = [F.lit(r[0]) for r in rows.filter(F.col(part).isNotNull()).select(part).distinct().collect()]  # a few
    told = list(dict.fromkeys([row_id, label, *keep]))
    every = F.array(*parts) if parts else F.array().cast(f"array<{rows.schema[part].dataType.simpleString()}>")
    asked = rows.select("*", F.explode(every).alias("train")).filter(F.col("train") != F.col(part))
    asked = asked.select(*told, *[f for f in features if f not in told], "train", F.col(part).alias("test"))
    scored = fit_and_score(rows, asked, features, label, row_id, part, specs, "train")
    long = scored.select(*told, "train", "test", *specs).unpivot([*told, "train", "test"], list(specs), "model", "score")
    return long.filter(F.col("score").isNotNull())


def root_splits(train: DataFrame, features, label: str, row_id: str, part: str, spec: TreeSpec) -> DataFrame:
    """(part, feature, threshold, gain, left_rows, left_value, right_value) of the first tree's root.

    The left side holds values up to the threshold.
    """
    ship(train.sparkSession)
    known = train.filter(F.col(label).isin(0, 1) & F.col(part).isNotNull())
    limits = bin_limits(known, features, part)
    rows = binned(known, features, label, row_id, part, limits)
    counts = rows.groupBy("part").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")
    )
    found = []
    named = {str(k): k for k in limits}
    for c in counts.filter("p > 0 AND n > 0").collect():
        mine = rows.filter(F.col("part") == c["part"]).withColumn("score", F.lit(_base(spec, c["p"], c["n"])))
        level = _level(mine, len(features), spec, (c["p"], c["n"]), {0: Tree()}, {0: [0]}, [])
        for r in best_splits(level, spec).filter("s IS NOT NULL").collect():  # one row: the root
            s = r["s"]
            limit = float(limits[named[c["part"]]][0][-s["f"]][-s["b"]])
            sides = [(s["la"], s["lb"]), (r["ta"] - s["la"], r["tb"] - s["lb"])]
            values = [float(leaf_value(spec, *side)) for side in sides]
            found.append((named[c["part"]], features[-s["f"]], limit, s["g"] / GAIN_STEPS, int(s["lc"]), *values))
    kind = train.schema[part].dataType.simpleString()
    return train.sparkSession.createDataFrame(
        found,
        f"part {kind}, feature string, threshold double, gain double, left_rows bigint, "
        "left_value double, right_value double",
    )
