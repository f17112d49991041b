"""L: copies, identifiers, leakage."""

from pyspark.sql import functions as F

from gsx.operators.dedup import (
    content_md5,
    copy_report,
    drop_copies,
    drop_copies_in_domain,
    duplicate_runs,
    leakage_checks,
    neutral_ids,
    removal_counts,
    replace_ids,
    split_overlap,
    vector_md5,
)
from gsx.plans.base import LINE_SQL, line_features, registry, sql_hash, table
from gsx.plans.sources import RESULT_SQL, result_rows
from gsx.session import settle

QUERIES, query = registry()


@query(
    "l1_content_dedup",
    """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)
WHERE r = 1""",
)
def l1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return drop_copies(docs, content_md5("text"), "doc_id").select("doc_id", "lang")


@query(
    "l1_copy_report",
    """
SELECT fingerprint, kept_id, kept_domain, doc_id AS removed_id, source AS removed_domain, lang AS label FROM (
  SELECT *, md5(text) AS fingerprint, first_value(doc_id) OVER w AS kept_id, first_value(source) OVER w AS kept_domain,
         row_number() OVER w AS nth
  FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)) WHERE nth > 1""",
)
def l1_report(spark, sf):
    return copy_report(table(spark, sf, "documents"), content_md5("text"), "doc_id", "source", "lang")


VECTOR = ("quantity", "discount", "tax")
VEC_HASH = "concat_ws(',', round(quantity * 10000)::BIGINT, round(discount * 10000)::BIGINT, round(tax * 10000)::BIGINT)"


@query(
    "l2_vector_dedup",
    f"""WITH {LINE_SQL}
SELECT row_id, domain FROM line WHERE domain <> 'F'
UNION ALL
SELECT min(row_id), 'F' FROM line WHERE domain = 'F' GROUP BY {VEC_HASH}""",
)
def l2(spark, sf):
    """Vectors repeated inside domain F; some row ids occur twice."""
    rows = line_features(spark, sf)
    return drop_copies_in_domain(rows, "domain", "F", VECTOR, "row_id").select("row_id", "domain")


@query(
    "l2_vector_report",
    f"""WITH {LINE_SQL},
f AS (SELECT row_id, domain, label, first_value(row_id) OVER w AS kept_id, row_number() OVER w AS nth
      FROM line WHERE domain = 'F' WINDOW w AS (PARTITION BY {VEC_HASH} ORDER BY row_id))
SELECT kept_id, 'F' AS kept_domain, row_id AS removed_id, domain AS removed_domain, label
FROM f WHERE nth > 1""",
)
def l2_report(spark, sf):
    """Rows of domain F whose vector an earlier row has, with that row."""
    inside = line_features(spark, sf).filter("domain = 'F'")
    return copy_report(inside, vector_md5(VECTOR), "row_id", "domain", "label").drop("fingerprint")


@query(
    "l3_neutral_ids",
    f"""
SELECT source, 'vd_' || lpad((row_number() OVER (ORDER BY {sql_hash(42, 'source')}))::VARCHAR, 4, '0') AS neutral_id
FROM (SELECT DISTINCT source FROM documents)""",
)
def l3(spark, sf):
    return neutral_ids(table(spark, sf, "documents"), "source", "vd_")


@query(
    "l3_replace_ids",
    f"""
WITH m AS (SELECT source, 'vd_' || lpad((row_number() OVER (ORDER BY {sql_hash(42, 'source')}))::VARCHAR, 4, '0') AS n
           FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, n AS source FROM documents JOIN m USING (source)""",
)
def l3_rows(spark, sf):
    return replace_ids(table(spark, sf, "documents").select("doc_id", "source"), "source", "vd_")


@query(
    "l4_removal_counts",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)
SELECT source AS removed_domain, count(*) FILTER (lang = 'en') AS label_en, count(*) FILTER (lang = 'de') AS label_de,
       count(*) AS removed FROM r WHERE r > 1 GROUP BY 1""",
)
def l4(spark, sf):
    docs = table(spark, sf, "documents")
    report = copy_report(docs, content_md5("text"), "doc_id", "source", "lang")
    return removal_counts(report, ["en", "de"])


@query(
    "l5_leakage_checks",
    f"""WITH {LINE_SQL}
SELECT 'leaky_ids' AS "check", count(*) FILTER (regexp_matches(row_id, '^1-'))::BIGINT AS value,
       count(*) FILTER (regexp_matches(row_id, '^1-')) = 0 AS passed FROM line
UNION ALL
SELECT 'duplicate_vectors', (count(*) - count(DISTINCT {VEC_HASH}))::BIGINT,
       count(*) = count(DISTINCT {VEC_HASH}) FROM line""",
)
def l5(spark, sf):
    return leakage_checks(line_features(spark, sf), "row_id", "^1-", vector_md5(VECTOR))


@query(
    "l6_split_overlap",
    """
SELECT 'l_partkey' AS key, count(*)::BIGINT AS shared FROM (
  SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')
UNION ALL
SELECT 'l_suppkey', count(*) FROM (
  SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O')""",
)
def l6(spark, sf):
    rows = table(spark, sf, "lineitem")
    train, test = rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")
    return split_overlap(train, test, ["l_partkey", "l_suppkey"])


def copied_runs(spark, sf):
    """Results in which some runs repeat another run, whole or nearly whole."""
    base = settle(result_rows(spark, sf))
    number = F.regexp_extract("run", r"_(\d+)$", 1).cast("int")
    whole = base.filter(number % 10 == 3).withColumn("run", F.concat(F.lit("copy_"), "run"))
    near = base.filter(number % 10 == 7).withColumn("run", F.concat(F.lit("near_"), "run"))
    near = near.withColumn("accuracy", F.col("accuracy") + 4e-7)
    return base.unionByName(whole).unionByName(near)


@query(
    "l7_duplicate_runs",
    f"""WITH {RESULT_SQL},
n AS (SELECT *, regexp_extract(run, '_(\\d+)$', 1)::INT AS number FROM res),
a AS (SELECT run, analysis, model, accuracy, auc, mcc FROM n
      UNION ALL SELECT 'copy_' || run, analysis, model, accuracy, auc, mcc FROM n WHERE number % 10 = 3
      UNION ALL SELECT 'near_' || run, analysis, model, accuracy + 4e-7, auc, mcc FROM n WHERE number % 10 = 7),
f AS (SELECT run, md5(string_agg(concat_ws('|', analysis, model, round(accuracy * 1e9)::BIGINT, round(auc * 1e9)::BIGINT,
        round(mcc * 1e9)::BIGINT), '~' ORDER BY analysis, model)) AS fp FROM a GROUP BY 1),
h AS (SELECT fp, min(run) AS head FROM f GROUP BY 1),
r AS (SELECT a.* FROM a JOIN h ON a.run = h.head),
p AS (SELECT x.run AS run_a, y.run AS run_b,
        avg((abs(x.accuracy - y.accuracy) <= 1e-6 AND abs(x.auc - y.auc) <= 1e-6 AND abs(x.mcc - y.mcc) <= 1e-6)::INT) AS match_share
      FROM r x JOIN r y ON x.run < y.run AND x.analysis = y.analysis AND x.model = y.model GROUP BY 1, 2)
SELECT head AS run_a, run AS run_b, 1.0::DOUBLE AS match_share, 'IDENTICAL' AS verdict
FROM f JOIN h USING (fp) WHERE run <> head
UNION ALL SELECT run_a, run_b, match_share, 'NEAR' FROM p WHERE match_share >= 0.95""",
)
def l7(spark, sf):
    return duplicate_runs(
        copied_runs(spark, sf), "run", ["analysis", "model"], ["accuracy", "auc", "mcc"]
    )
