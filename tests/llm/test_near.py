"""Near copies of the pipeline stage against all pairs."""

import random
import sys
from pathlib import Path

from llm_rows import EDGE, frame

from gsx.llm import jaccard

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402


def brute_shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(len(words) - n + 1, min(len(words), 1)))}


def similar(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return not (a or b) or len(a & b) >= 0.8 * len(a | b)


def brute_roots(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar(texts[i], texts[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.random()}"
    return " ".join(words)


def planted():
    rng = random.Random(3)
    texts = []
    for k in range(30):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
        # 4 edits leave about 0.82, 5 fall below 0.8
        texts += [text, edited(rng, text, 2), edited(rng, text, 4), edited(rng, text, 5)]
    return texts


def test_near_stage_takes_similarity(spark, monkeypatch):
    texts = planted()
    roots = brute_roots(texts)
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert got == sorted(set(roots)) and 30 < len(got) < 60
    monkeypatch.setattr(jaccard, "CHUNK", 1)
    assert sorted(r["doc_id"] for r in jaccard.drop_near_copies(docs).collect()) == got


def test_near_edge_rows(spark, edge, none):
    left = jaccard.drop_near_copies(edge)
    assert left.columns == edge.columns
    texts = [t for _, t, _ in EDGE]
    assert left.count() == len(set(brute_roots(texts)))
    assert jaccard.drop_near_copies(none).count() == 0


def test_fingerprints_link_what_no_band_shares(spark):
    rng = random.Random(11)
    pairs = []
    for k in range(12):
        shared = " ".join(f"w{rng.random()}" for _ in range(40))
        often = f"a{k} b{k} c{k} " * 400
        pairs.append([often + shared + " " + " ".join(f"o{rng.random()}" for _ in range(30)) for _ in range(2)])
    keys = [[set(jaccard.band_keys(jaccard.shingles(t.encode())).tolist()) for t in p] for p in pairs]
    assert any(not a & b for a, b in keys)
    rows = [(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {r["doc_id"]: r["root"] for r in jaccard.near_groups(docs, similar=0.4).collect()}
    assert all(roots[2 * k] == roots[2 * k + 1] for k in range(len(pairs)))
    assert len(set(roots.values())) == len(pairs)
