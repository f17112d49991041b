"""Product codes, periodic runs and the Jaccard join against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from llm_rows import EDGE, LONG, frame

from gsx.llm import jaccard_join, periodic, vector_codes

# --- product codes ---------------------------------------------------------------------------


def test_limbs_and_products_are_exact():
    rng = np.random.default_rng(0)
    for top in (3, 2**13, 2**27, 2**29):
        x = rng.integers(-top, top, (40, 8))
        c = rng.integers(-top, top, (16, 8))
        want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in c] for u in x]
        assert vector_codes.exact_products(x, c).tolist() == want
        for part in vector_codes.limbs(x, 10):
            assert np.abs(part).max() <= 2**10


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [int(np.floor(float(c) * scale)) for c in v]) for i, v in rows]
    width = -(-max(len(v) for _, v in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v))) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[v[p * width : (p + 1) * width] for _, v in order] for p in range(parts)]

    def near(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            mine = [near(v[p], books[p])[0] for v in cut]
            for e in range(len(books[p])):
                own = [v[p] for v, k in zip(cut, mine) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for (i, _), v in zip(kept, cut):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found)))
    return sorted(out, key=str), ",".join(str(c) for b in books for e in b for c in e)


@pytest.mark.parametrize("size,spread", [(16, 1.0), (16, 20_000.0), (10, 3.0)])
def test_vector_codes(spark, size, spread):
    rng = np.random.default_rng(size)
    rows = [(int(i), (rng.normal(size=size) * spread).tolist()) for i in rng.permutation(60)]
    # ties, a repeated row, a repeated id and no id
    rows += [rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1]), (99, rows[6][1])]
    skipped = [(7, None), (8, [None] * size), (9, [float("nan")] * size), (10, [float("inf")] + [0.0] * (size - 1))]
    data = [(i, v, k % 3 if k % 4 else None, "x", 5) for k, (i, v) in enumerate(rows + skipped)]
    df = spark.createDataFrame(data, "vec_id bigint, e array<double>, label int, code string, v int")
    coded, books = vector_codes.vector_codes(df, "vec_id", "e", "label", parts=4, entries=5, rounds=3, scale=16)
    want, text = brute_codes(rows, 4, 5, 3, 16)
    got = coded.collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == want
    assert books.text() == text
    summed = vector_codes.with_group_error(coded.withColumnRenamed("code", "group"), "label", name="total").collect()
    per = Counter()
    for r in got:
        per[r.label] += r.error
    assert all(r.total == per[r.label] for r in summed) and len(summed) == len(got)


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id bigint, e array<float>"
    coded, books = vector_codes.vector_codes(spark.createDataFrame([], schema), "vec_id", "e")
    assert coded.collect() == [] and books is None
    mixed = spark.createDataFrame([(1, []), (2, [1.0, 2.0]), (3, [])], schema)
    coded, _ = vector_codes.vector_codes(mixed, "vec_id", "e", parts=2)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == [(1, "0000", 0), (2, "0101", 0), (3, "0000", 0)]
    none = spark.createDataFrame([(1, []), (2, [])], schema)
    coded, books = vector_codes.vector_codes(none, "vec_id", "e")
    assert [r.error for r in coded.collect()] == [0, 0] and books.text() == ""
    large = spark.createDataFrame([(1, [1e30])], schema)
    with pytest.raises(ValueError):
        vector_codes.vector_codes(large, "vec_id", "e")


# --- periodic runs ----------------------------------------------------------------------------


def brute_runs(w, min_words=6, min_periods=4):
    found = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_words, min_periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5, 20]), rng.randrange(140)
    w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 8:
            a, p = rng.randrange(n), rng.randrange(1, n // 4)
            for i in range(a, min(n, a + rng.randrange(n))):
                w[i] = w[a + (i - a) % p]
    if n and rng.random() < 0.4:
        inner = w[: rng.randrange(1, 8)] * rng.randrange(1, 7) + w[: rng.randrange(4)]
        w = w[:10] + inner * rng.randrange(3, 8) + w[10:30]
    return w


def test_runs_match_brute_force():
    rng = random.Random(7)
    for _ in range(80):
        texts = [planted(rng) for _ in range(12)]
        for w, found in zip(texts, periodic.runs_of_texts(texts)):
            assert [tuple(r) for r in found.tolist()] == brute_runs(w)


def test_wavelet_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(100)
    tree = periodic.WaveletTree(values)
    low, high, least = rng.integers(0, 100, 300), rng.integers(0, 101, 300), rng.integers(0, 140, 300)
    low, high = np.minimum(low, high), np.maximum(low, high)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least)]
    assert tree.successor(low, high, least).tolist() == want


def test_periodic_runs_of_odd_texts(spark, edge, none, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS", 40)
    got = periodic.periodic_runs(edge).collect()
    assert len(got) == len(EDGE)
    texts = Counter((i, b" ".join((t or "").encode().split()).decode()) for i, t, _ in EDGE)
    assert Counter((r.doc_id, r.collapsed) for r in got if not r.runs) <= texts
    assert periodic.periodic_runs(none).collect() == []
    rows = frame(spark, [(1, "a b " * 9 + "c", "x"), (2, "x " * 6, None), (3, LONG + " z" * 7, "y")])
    found = {r.doc_id: r for r in periodic.periodic_runs(rows).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 18, 2)] and found[1].collapsed == "a b c"
    assert [tuple(x) for x in found[2].runs] == [(0, 6, 1)] and found[2].collapsed == "x"
    assert [tuple(x) for x in found[3].runs] == [(60_000, 7, 1)]


# --- Jaccard join ------------------------------------------------------------------------------


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute_components(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        w = lowered(t)
        runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        sets.append(runs or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(
        ((i, len(s), low.get(r) if s else i) for (i, _), s, r in zip(rows, sets, root)), key=str
    )


def check_join(df, rows):
    got = jaccard_join.jaccard_components(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_jaccard_join_of_odd_texts(spark, edge, none):
    check_join(edge, [(i, t) for i, t, _ in EDGE])
    assert jaccard_join.jaccard_components(none).collect() == []


@pytest.mark.parametrize("crowd,seed", [(2, 1), (2, 2), (32, 3)])
def test_jaccard_join_with_crowded_passages(spark, monkeypatch, crowd, seed):
    """Passages that many texts share, near copies of several degrees, texts of passages alone."""
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    rng = random.Random(seed)

    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    passages = [prose(rng.randrange(20, 60)) for _ in range(3)]
    texts = []
    for _ in range(40):
        texts.append(prose(rng.randrange(10, 90)) + rng.choice(passages) + prose(rng.randrange(4)))
    for _ in range(30):
        base = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 4)):
            base[rng.randrange(len(base))] = "changed%d" % rng.randrange(9)
        texts.append(base)
    for _ in range(25):
        texts.append(rng.choice(passages) + rng.choice(passages)[: rng.randrange(8)] + prose(rng.randrange(3)))
    texts += [t[: rng.randrange(1, 12)] for t in texts[:10]] + [texts[0], texts[1]]
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.sample(range(1000), len(texts)), texts)]
    check_join(frame(spark, [(i, t, "s") for i, t in rows]), rows)
