"""Small documents that cover the odd cases."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "rid bigint, fp bigint, place string, kept boolean, text_sha256 string, score double, n bigint, tail string"
)
CLASH = (1, 2, "p", False, "x", 0.5, 3, "t")


def frame(spark, rows):
    """Documents of (doc_id, text, source), with columns whose names operators use inside."""
    data = [(i, t, "en", s, len(t or ""), *CLASH) for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA)


LONG = " ".join(f"word{k % 911} of{k}" for k in range(30_000))
EDGE = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "   \t\n ", None),
    (4, "one", "b"),
    (5, "one two", "b"),
    (6, "one two three four five six seven", "b"),
    (7, "One Two three four five six seven", "c"),
    (7, "one two three four five six seven", "c"),
    (8, LONG, "c"),
    (9, LONG, "c"),
    (10, LONG + " more", None),
    (None, "a text without an id", "a"),
    (None, "a text without an id", "a"),
    (11, "é ü ñ ́     \U0001f600 Straße ſK", "d"),
    (12, "repeat repeat repeat", "d"),
    (12, "repeat repeat repeat", "d"),
]
