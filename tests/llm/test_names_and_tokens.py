"""Columns that are called like temporary ones, and words whose lower case is not all letters."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gsx.llm import exact_dedup, jaccard, mixing, pii, tokens
from gsx.llm.texts import unused_name

NAMES = ("found", "names", "_found", "_names", "id", "sha", "keep", "place", "__id", "__sha", "__keep", "__nth",
         "limits", "again", "_limits", "_again", "ID_", "root", "n", "rid", "before", "target")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "call +49 30 1234567 now please", "a"), (2, "same text here", "a"), (3, "same text here", "b"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def kept_values(rows):
    return all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in NAMES)


def test_unused_name():
    assert unused_name("a", ["A", "a_"]) == "a__" and unused_name("b", []) == "b"


def test_clashing_columns_survive(clashing):
    masked = pii.pseudonymized(clashing, "k").collect()
    assert len(masked) == 4 and kept_values(masked)
    exact = exact_dedup.drop_copies(clashing).collect()
    assert sorted(r["doc_id"] for r in exact) == [1, 3, 4] and kept_values(exact)
    near = jaccard.drop_near_copies(clashing).collect()
    assert sorted(r["doc_id"] for r in near) == [1, 2, 4] and kept_values(near)
    mixed = mixing.taken_documents(clashing).collect()
    assert mixed and kept_values(mixed)


def test_spaced_text_keeps_its_ids():
    """Cutting before punctuation changes no id, over letters of every script near the cut range."""
    sys.path.append("/opt/tokenizers")
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x80, 0x250)] + list("aZ9̀́ẞﬁαİ中")
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(letters + list(".,!?;: '")) for _ in range(rng.randrange(1, 12)))
        cut = tokens.spaced(text.encode()).decode()
        want = whole.encode(text, add_special_tokens=False).ids
        assert whole.encode(cut, add_special_tokens=False).ids == want, text
    assert np.isin([b"\xc4\xb0"], tokens._SIGNS).all()


def test_words_in_use_stay_remembered(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "CACHE", 60)
    monkeypatch.setattr(tokens, "GROUP", 1)
    words, asked = tokens.WordTokens(path), []
    encode = words._encode
    monkeypatch.setattr(words, "_encode", lambda new: asked.extend(new) or encode(new))
    letters = "abcdefghijklmnopqrst"
    texts = [f"the house is near water x{a} " + " ".join(f"{a}{b}q" for b in letters[:12]) for a in letters]
    got = [b"".join(ids) for ids in words.each([t.encode() for t in texts])]
    want = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got == want
    assert asked.count(b"house") == 1 and len(asked) == len(set(asked))
    assert len(words.known) + len(words.older) <= 60
