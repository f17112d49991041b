"""Mixing, packing, top-k search and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import EDGE, frame
from oracle import compare, duck
from pyspark.sql import functions as F

from gsx.llm import knn, mixing, packing
from gsx.llm.queries import QUERIES, SQL, tokenizer_path
from gsx.plans.base import Query

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert not compare(spark, duck(SF), SF, Query(QUERIES[name], SQL[name]))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in sizes if s not in stopped)
        over = {s for s in sizes if s not in stopped and free and rest * weight[s] / free > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in stopped else rest * weight[s] / free for s in sizes}
        stopped |= over


def brute_line(rows, targets, quantum):
    """Words taken per (rid, pass): every piece in one list, sorted by finish time and cut."""
    names = sorted(targets, key=lambda s: (s is None, s))
    pieces = []
    for s in names:
        queue, end = sorted((r["place"], r["rid"], r["size"]) for r in rows if r["source"] == s and r["pass"] == 0), 0
        for nth in (0, 1):
            for place, rid, size in queue:
                for k in range(max(1, -(-size // quantum))):
                    words = min(quantum, size - k * quantum)
                    end += words
                    finish = end / targets[s] if targets[s] else -1.0
                    pieces.append((finish, names.index(s), nth, place, rid, k, words))
    left, taken = int(sum(targets.values()) + 1e-6), Counter()
    for _, _, nth, _, rid, _, words in sorted(pieces):
        taken[rid, nth] += min(words, left)
        left -= min(words, left)
    return taken


@pytest.mark.parametrize("quantum", [mixing.QUANTUM, 1_000_000])
def test_mix_on_edge_rows(edge, none, quantum):
    rows = mixing.mix(edge, quantum=quantum).collect()
    sizes = Counter()
    for _, t, s in EDGE:
        sizes[s] += len((t or "").encode().split())
    # white space of other scripts belongs to words
    targets = brute_targets(sizes)
    taken, per_doc = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
        per_doc[r["rid"]] += r["taken"]
        assert per_doc[r["rid"]] <= 2 * r["size"]
    assert len(per_doc) == len(EDGE) and len(rows) == 2 * len(EDGE)
    assert sum(taken.values()) == int(sum(targets.values()) + 1e-6)
    if quantum == mixing.QUANTUM:
        assert all(abs(taken[s] - targets[s]) <= len(sizes) * quantum for s in sizes)
    exact = {r["source"]: r["target"] for r in rows}
    assert Counter({(r["rid"], r["pass"]): r["taken"] for r in rows}) == brute_line(rows, exact, quantum)
    served = sorted((r["served"], r["taken"]) for r in rows if r["taken"])
    assert served[-1][0] == sum(taken.values())
    if quantum > mixing.QUANTUM:
        # no document is cut into pieces, so each is served as a whole
        assert [s for s, _ in served] == list(np.cumsum([t for _, t in served]))
    assert mixing.mix(none).count() == 0 == mixing.taken_documents(none).count()


def test_many_buckets_and_documents_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = frame(spark, [(i, "w " * (1 + i % 13), "hot" if i % 3 else f"s{i % 7}") for i in range(900)])
    first = sorted(map(tuple, mixing.mix(docs).select("doc_id", "pass", "taken", "served").collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10_000)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "pass", "taken", "served").collect()
    assert first == sorted(map(tuple, again), key=str)
    often = Counter((d, p) for d, p, t, _ in first if t and 2 * t >= 1 + d % 13)
    out = mixing.taken_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(d for d, _ in often)


def check_pieces(pieces, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END], "<u4"))
    per_doc, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        per_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] > 0
        assert any(
            len(a) == r["doc_tokens"] and zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            for a in ids[r["doc_id"]]
        )
    assert set(per_doc) == set(ids)
    for i, rows in per_doc.items():
        assert sum(r["length"] for r in rows) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            at = 0
            for r in sorted(rows, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    padding = 0
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding / max(1, sum(r["length"] for r in pieces))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_on_edge_rows(edge, none, capacity):
    pieces = packing.pack(edge, tokenizer_path(), capacity=capacity).collect()
    check_pieces(pieces, [(i, t) for i, t, _ in EDGE], capacity)
    assert packing.pack(none, tokenizer_path(), capacity=capacity).count() == 0


def test_packing_of_documents_has_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(docs, tokenizer_path()).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_pieces(pieces, texts, packing.CAPACITY) < 0.02
    per_doc = Counter(r["doc_id"] for r in pieces if r["length"] < 4096)
    assert sum(n > 1 for n in per_doc.values()) < 0.15 * len(per_doc)


def test_patterns_meet_the_demand():
    rng = np.random.default_rng(2)
    sizes = packing.class_tops()
    for scale in (1, 50, 5000):
        demand = rng.poisson(scale, len(sizes)) * (rng.random(len(sizes)) < 0.7)
        basis, x = packing.solve_patterns(demand, sizes, packing.GRID)
        plan = packing.whole_patterns(demand, basis, x, sizes, packing.GRID)
        assert all(p @ sizes <= packing.GRID for p, _ in plan)
        assert (sum(p * t for p, t in plan) >= demand).all()
        bound = demand @ sizes / packing.GRID
        assert sum(t for _, t in plan) <= 1.05 * bound + 12
    none, x = packing.solve_patterns(np.zeros(len(sizes), int), sizes, packing.GRID)
    assert packing.whole_patterns(np.zeros(len(sizes), int), none, x, sizes, packing.GRID) == []


def test_price_finds_the_best_pattern():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 5, 7])
    for _ in range(30):
        values = rng.random(3)
        best = max(
            a * values[0] + b * values[1] + c * values[2]
            for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23
        )
        value, pattern = packing.price(values, sizes, 23)
        assert abs(value - best) < 1e-9 and abs(pattern @ values - best) < 1e-9 and pattern @ sizes <= 23


def brute_top(vectors, k):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 5 == 0:
            scores = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ok) if b != a]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 40)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (6, 8))
    vectors = [(i, (centres[i % 6] + rng.normal(0, 0.05, 8)).tolist()) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 340)]
    vectors += [(400, None), (401, [None] * 8), (405, [float("nan")] * 8), (406, [float("inf")] * 8), (None, [1.0] * 8)]
    vectors += [(410, [1.0, 2.0]), (411, []), (415, [0.0] * 8), (10, [1.0] * 8)]
    schema = "vec_id bigint, embedding array<float>, score int, cell int, v string"
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vectors], schema)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    for pivots in (4, 64):
        got = knn.top_k(df, F.col("vec_id") % 5 == 0, 5, pivots=pivots).collect()
        assert sorted(map(tuple, got)) == brute_top(exact, 5)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert knn.top_k(df.filter("vec_id = 5"), F.col("vec_id") % 5 == 0).count() == 0
    two = knn.top_k(df.filter("vec_id in (5, 7)"), F.col("vec_id") % 5 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(5, 1, 7)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = out.collect()
        assert rows
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "exact_dedup":
            assert len({r["text"] for r in rows}) == len(rows)
        if name != "mixing":
            assert len(rows) <= before
            before = len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_pieces(pieces, texts, packing.CAPACITY) < 0.05
    assert corpus_pipeline.run(spark, SF).count() > 0
