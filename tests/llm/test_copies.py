"""Exact copies and near copies against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from llm_rows import EDGE, LONG, frame
from pyspark.sql import functions as F

from gsx.llm import exact_dedup, simhash
from gsx.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    n = max(len(words) - 2, 1 if words else 0)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, distance=3):
    low = {}
    todo = set(fps)
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            group |= front
            front = {y for y in todo if any((x ^ y).bit_count() <= distance for x in front)}
            todo -= front
        members = [i for i, f in zip(ids, fps) if f in group and i is not None]
        low.update(dict.fromkeys(group, min(members) if members else None))
    return [low[f] for f in fps]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_copies_on_edge_rows(edge):
    got = rows(exact_dedup.copy_groups(edge))
    groups = {}
    for i, t, _ in EDGE:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(EDGE)
    kept = 0
    for doc_id, keep, size, stays, sha in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
        ids = [i for i in groups[text] if i is not None]
        assert doc_id in groups[text] and size == len(groups[text])
        assert keep == (max(ids) if ids else None)
        kept += stays
        assert not stays or doc_id == keep
    assert kept == len(groups)


def test_texts_that_share_blocks_are_told_apart(spark):
    b = exact_dedup.BLOCK
    texts = ["x" * b, "x" * (b + 1), "x" * (2 * b), "x" * (3 * b), "x" * (3 * b), "x" * (4 * b - 1) + "y",
             "x" * (4 * b), "y" + "x" * (4 * b - 1), "é" * b, "é" * b, "x" * (5 * b)]
    got = exact_dedup.text_names(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    names = {}
    for r in got:
        names.setdefault((r["rounds"], r["name"]), set()).add(texts[r["doc_id"]])
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(set(texts))


def test_split_buckets_give_one_name(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPLIT", 3)
    monkeypatch.setattr(exact_dedup, "BUCKETS", 8)
    docs = frame(spark, [(i, f"text {i % 5}" * 400, "a") for i in range(60)]).repartition(7)
    got = exact_dedup.copy_groups(docs).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(55 + k, 12) for k in range(5)}
    assert sum(r["kept"] for r in got) == 5


def test_drop_copies_keeps_columns_and_one_row_each(edge, none):
    left = exact_dedup.drop_copies(edge)
    assert left.columns == edge.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, _ in EDGE})
    assert exact_dedup.drop_copies(none).count() == 0 == exact_dedup.copy_groups(none).count()


def test_fingerprints_and_components_on_edge_rows(edge):
    got = rows(simhash.near_groups(edge).select("doc_id", "fp", "component_id"))
    fps = [brute_fingerprint(t) for _, t, _ in EDGE]
    low = brute_components(fps, [i for i, _, _ in EDGE])
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    assert got == sorted(((i, f, c) for (i, _, _), f, c in zip(EDGE, signed, low)), key=str)


def test_pieces_do_not_change_a_fingerprint(monkeypatch):
    whole = brute_fingerprint(LONG)
    assert simhash.fingerprint(LONG.encode()) == whole
    monkeypatch.setattr(simhash, "word_lists", lambda d: ([w] for w in d.split()))
    assert simhash.fingerprint(LONG.encode()) == whole


def near(rng, f, bits):
    for b in rng.sample(range(64), bits):
        f ^= 1 << b
    return f


@pytest.mark.parametrize("chunk", [8, 4096])
def test_links_lose_nothing_in_crowded_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [near(rng, fps[0], rng.randint(0, 2)) for _ in range(200)]
    fps += [near(rng, rng.choice(fps[1:20]), 3) for _ in range(60)]
    chain = fps[30]
    for _ in range(12):
        chain = near(rng, chain, 3)
        fps.append(chain)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = simhash.links(df).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() for a, b in edges)
    roots = {r["node"]: r["root"] for r in components(simhash.links(df), "a", "b").collect()}
    want = brute_components(fps, signed)
    assert [roots.get(f, f) for f in signed] == want


def test_drop_near_copies(spark, edge, none):
    left = simhash.drop_near_copies(edge)
    assert left.columns == edge.columns
    groups = {r["component_id"] for r in simhash.near_groups(edge).collect()}
    assert left.count() == len(groups)
    assert simhash.drop_near_copies(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(path, "a bigint, b bigint"), "a", "b").collect()
    want = {k: 0 for k in range(51)} | {100 + k: 100 for k in range(40)}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
