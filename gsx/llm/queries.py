"""Queries of the operators of this package over the shared tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gsx.llm import (
    exact_dedup,
    jaccard_join,
    knn,
    licenses,
    lm,
    mixing,
    notices,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    simhash,
    vector_codes,
)


#: Key of the registered query only; a real key is a parameter of the operator.
PII_KEY = "example-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pii.pseudonymized(_table(spark, sf_dir, "documents"), PII_KEY)
    return changed.select("doc_id", "text", "n_replaced")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"), templates=notices.TEXTS, distinct=True)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = mixing.mix(_table(spark, sf_dir, "documents"))
    return (
        passes.groupBy("rid")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
            F.sum("taken").alias("taken"),
            F.max("served").alias("served"),
        )
        .drop("rid")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind != "novel")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))),
            ",",
        )

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in secrets.KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    coded, books = vector_codes.vector_codes(vectors, "vec_id", "embedding", "label")
    digest = F.sha2(F.lit(books.text() if books else "").cast("binary"), 256)
    summed = vector_codes.with_group_error(coded, "label", name="label_error")
    return summed.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` where one document in ten, by a checksum of its id, repeats its tail."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    listed = docs.select("doc_id", "text", h.alias("h"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.expr("h div 10")
    placed = listed.filter("h % 10 = 0 AND size(w) > 0").withColumns({"n": n, "g": g}).withColumn("a", F.expr("g % n"))
    cut = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("flatten(array_repeat(slice(w, int(a + 1), int(p)), int(ceil((n - a) / p))))")
    whole = F.concat(F.expr("slice(w, 1, int(a))"), F.slice(tail, 1, F.expr("int(n - a)")))
    same = listed.filter("NOT (h % 10 = 0 AND size(w) > 0) OR h IS NULL").select("doc_id", "text")
    return same.unionByName(cut.select("doc_id", F.array_join(whole, " ").alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_repeats(_table(spark, sf_dir, "documents")))
    # runs come by start and then period, so the first of equal exponents stays
    best = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), "
        "(b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"
    )
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of ``op11_vector_codes`` written out."""
    far = "list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(k: int, book: str) -> str:
        return f"""
near{k} AS MATERIALIZED (
  SELECT id, label, part, min_by(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT r.id, r.label, r.part, c.entry, {far} AS d FROM pieces r JOIN {book} c ON r.part = c.part)
  GROUP BY id, label, part)"""

    steps = []
    for k in range(rounds + 1):
        steps.append(assigned(k, f"book{k}"))
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT part, entry, list(m ORDER BY pos) AS v
  FROM (SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
        FROM (SELECT n.part, n.entry, unnest(range(1, len(p.v) + 1)) AS pos, unnest(p.v) AS x
              FROM near{k} n JOIN pieces p USING (id, part))
        GROUP BY part, entry, pos)
  GROUP BY part, entry),
book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v)::BIGINT[] AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
         list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT id, label, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v
  FROM kept, range(0, {parts}) t(part)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, v FROM pieces WHERE id <= {entries}),{",".join(steps)},
coded AS (
  SELECT id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY id, label)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY c.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded c JOIN kept k USING (id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lm_scores": op2_lm_scores,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_licenses": op5_licenses,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_topk": op9_topk,
    "op10_secrets": op10_secrets,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_jaccard_join": op13_jaccard_join,
}

SQL = {
    "op11_vector_codes": vector_codes_sql(),
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('42|' || doc_id) AS place
  FROM documents),
per AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0
              ELSE 1.0 END::DOUBLE AS weight
  FROM sized GROUP BY source),
stops AS (
  SELECT *, 2.0 * source_size AS stop, 2.0 * source_size / weight AS ratio,
         sum(source_size) OVER ()::DOUBLE * 1.5 AS budget FROM per),
levels AS (
  SELECT *, (budget - coalesce(sum(stop) OVER (ORDER BY ratio, source
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM stops),
targets AS (
  SELECT source, source_size,
         least(stop, weight * coalesce((SELECT level FROM levels WHERE level <= ratio
                                        ORDER BY ratio, source LIMIT 1), 'inf'::DOUBLE)) AS target
  FROM levels),
queued AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.place, t.source,
         sum(s.size) OVER (PARTITION BY t.source ORDER BY s.place, s.doc_id) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
pieces AS (
  SELECT *, least(size - piece * 128, 128) AS words,
         (before + pass * source_size + piece * 128 + least(size - piece * 128, 128))::DOUBLE
           / nullif(target, 0) AS finish
  FROM (SELECT *, unnest(range(0, greatest(1, (size + 127) // 128))) AS piece
        FROM queued, (SELECT unnest([0, 1]) AS pass))),
lined AS (
  SELECT *, sum(words) OVER (ORDER BY finish NULLS FIRST, source NULLS LAST, pass, place, doc_id, piece
                             ROWS UNBOUNDED PRECEDING) AS line,
         (SELECT floor(sum(target) + 1e-6)::BIGINT FROM targets) AS budget
  FROM pieces),
cut AS (SELECT *, greatest(words - greatest(line - budget, 0), 0) AS part FROM lined)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       sum(part)::BIGINT AS taken, max(CASE WHEN part > 0 THEN least(line, budget) END)::BIGINT AS served
FROM cut GROUP BY doc_id, size, source_size, target""",
    "op9_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 5""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
