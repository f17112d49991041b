"""S: scans, path parsing, run folders, sinks.  ``pages.url`` stands in for file paths."""

from pyspark.sql import functions as F

from gsx.functions.names import first_part_in, group_of, part_after, subject_from
from gsx.operators.joins import latest_per_key
from gsx.plans.base import r6, registry, table
from gsx.session import scratch_path
from gsx.sources.scan import (
    CORRUPT,
    load_log,
    manifest,
    promote_header,
    read_csv,
    scan_runs,
    with_run_parts,
)
from gsx.sources.sinks import write_csv, write_json, write_table

QUERIES, query = registry()

LABELS = {"en": 1, "de": 0, "fr": 0, "es": 0}
TASKS = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}


@query(
    "s1_manifest_scan",
    """
SELECT page_id, url, octet_length(encode(html))::BIGINT AS n_bytes, md5(html) AS file_md5
FROM pages WHERE lower(url) LIKE '%.html' OR lower(url) LIKE '%#top'""",
)
def s1(spark, sf):
    return manifest(table(spark, sf, "pages"), "url", "html", (".HTML", "#top"))


@query(
    "s2_label_from_path",
    """
SELECT * FROM (
  SELECT page_id, CASE list_filter(string_split(lower(url), '/'), lambda x: x IN ('en','de','fr','es'))[1]
    WHEN 'en' THEN 1 WHEN 'de' THEN 0 WHEN 'fr' THEN 0 WHEN 'es' THEN 0 END AS label_binary
  FROM pages) WHERE label_binary IS NOT NULL""",
)
def s2(spark, sf):
    label = first_part_in(F.col("url"), LABELS).alias("label_binary")
    return table(spark, sf, "pages").select("page_id", label).filter("label_binary IS NOT NULL")


@query(
    "s3_subject_from_name",
    r"""
SELECT page_id, coalesce(nullif(upper(regexp_extract(url, '/([a-z]{2}/\d+)', 1)), ''), 'UNKNOWN')
  AS subject_id
FROM pages""",
)
def s3(spark, sf):
    subject = subject_from(F.col("url"), r"/([a-z]{2}/\d+)").alias("subject_id")
    return table(spark, sf, "pages").select("page_id", subject)


@query(
    "s4_task_from_path",
    """
SELECT page_id, CASE t WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french'
  WHEN 'es' THEN 'spanish' END AS task
FROM (SELECT page_id, p[list_position(p, h) + 1] AS t
      FROM (SELECT page_id, string_split(url, '/') AS p, string_split(url, '/')[3] AS h FROM pages))""",
)
def s4(spark, sf):
    host = F.get(F.split("url", "/"), F.lit(2))
    tasks = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
    part = part_after(F.col("url"), host)
    return table(spark, sf, "pages").select("page_id", tasks[part].alias("task"))


@query(
    "s5_vowel_attempt",
    r"""
SELECT page_id, nullif(regexp_extract(url, '([0-9])([0-9])\.html$', 1), '') AS vowel,
       nullif(regexp_extract(url, '([0-9])([0-9])\.html$', 2), '')::INT AS attempt
FROM pages""",
)
def s5(spark, sf):
    pattern = r"([0-9])([0-9])\.html$"
    return table(spark, sf, "pages").select(
        "page_id",
        group_of(F.col("url"), pattern, 1).alias("vowel"),
        group_of(F.col("url"), pattern, 2).cast("int").alias("attempt"),
    )


@query(
    "s6_csv_scan",
    """
SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer GROUP BY 1""",
)
def s6(spark, sf):
    path = write_csv(table(spark, sf, "customer"), scratch_path(spark, "csv"))
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return (
        read_csv(spark, path, schema)
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    )


@query(
    "s7_column_subset_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def s7(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return orders.select("o_orderkey", "o_totalprice")


def exact_auc():
    """Twelve times the mean tax to six decimals, half up, in whole millionths.

    Sums of doubles depend on their order, which decides where a mean lies on a half.
    """
    return F.expr(
        "(24 * cast(sum(cast(l_tax AS decimal(18,6))) * 1000000 AS bigint) + count(l_tax)) div (2 * count(l_tax))"
    )


def result_rows(spark, sf, *more):
    """Summary rows per supplier, taken as experiment runs; ``more`` are further aggregates."""
    run = F.concat(
        F.when(F.col("l_suppkey") % 2 == 0, "evaluation_features_").otherwise("evaluation_training_"),
        F.when(F.col("l_suppkey") % 3 == 0, "compare").otherwise("mel_small"),
        F.when(F.col("l_suppkey") % 4 < 3, F.concat(F.lit("_"), F.element_at(
            F.array(F.lit("8k"), F.lit("10k"), F.lit("16k")), F.least(F.col("l_suppkey") % 4 + 1, F.lit(3)).cast("int")))).otherwise(""),
        F.lit("_20240101_"),
        F.col("l_suppkey").cast("string"),
    )
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            run.alias("run"),
            F.concat(F.lit("to "), "l_linestatus").alias("analysis"),
            F.col("l_returnflag").alias("model"),
        )
        .agg(
            r6(F.avg("l_quantity") / 50).alias("accuracy"),
            r6(F.avg("l_discount") * 10).alias("f1"),
            r6(F.avg("l_tax") * 12).alias("auc"),
            r6(F.avg("l_discount") * 20 - 1).alias("mcc"),
            *more,
        )
    )


_RESULT_SQL = """
res AS (
  SELECT concat(CASE WHEN l_suppkey % 2 = 0 THEN 'evaluation_features_' ELSE 'evaluation_training_' END,
                CASE WHEN l_suppkey % 3 = 0 THEN 'compare' ELSE 'mel_small' END,
                CASE l_suppkey % 4 WHEN 0 THEN '_8k' WHEN 1 THEN '_10k' WHEN 2 THEN '_16k' ELSE '' END,
                '_20240101_', l_suppkey::VARCHAR) AS run,
         'to ' || l_linestatus AS analysis, l_returnflag AS model,
         round(avg(l_quantity) / 50, 6) AS accuracy, round(avg(l_discount) * 10, 6) AS f1,
         {auc} AS auc, round(avg(l_discount) * 20 - 1, 6) AS mcc
  FROM lineitem GROUP BY 1, 2, 3)"""
RESULT_SQL = _RESULT_SQL.format(auc="round(avg(l_tax) * 12, 6)")
EXACT_RESULT_SQL = _RESULT_SQL.format(
    auc="(24 * (sum(l_tax::DECIMAL(18,6)) * 1000000)::BIGINT + count(l_tax)) // (2 * count(l_tax))"
)


@query("s8_many_run_scan", f"WITH {RESULT_SQL} SELECT run, analysis, model, accuracy, auc FROM res")
def s8(spark, sf):
    """One CSV folder per run: written by run, read back by glob with the name from the path."""
    root = scratch_path(spark, "runs")
    # partition folders are named run=<name>; the nested level plays the fixed subfolder
    rows = result_rows(spark, sf).withColumn("sub", F.lit("csv_results"))
    write_csv(rows.repartition("run"), root, ["run", "sub"])
    return scan_runs(spark, root, files="*/*/*.csv").select(
        "run", "analysis", "model", "accuracy", "auc"
    )


@query(
    "s9_run_name_parse",
    f"""WITH {RESULT_SQL}
SELECT DISTINCT run,
  CASE WHEN run LIKE 'evaluation_features_%' THEN 'Feature Evaluation' ELSE 'Training Evaluation' END AS kind,
  CASE WHEN run LIKE '%compare%' THEN 'compare' ELSE 'mel_small' END AS feature_set,
  CASE WHEN run LIKE '%\\_8k\\_%' ESCAPE '\\' THEN '8k' WHEN run LIKE '%\\_10k\\_%' ESCAPE '\\' THEN '10k'
       WHEN run LIKE '%\\_16k\\_%' ESCAPE '\\' THEN '16k' ELSE 'N/A' END AS sample_rate
FROM res""",
)
def s9(spark, sf):
    return with_run_parts(result_rows(spark, sf).select("run").distinct())


@query(
    "s10_load_log",
    """
SELECT run, n IS NOT NULL AS found, run IN (SELECT c_nationkey FROM customer) AS json_found,
  coalesce(n - bad, 0)::BIGINT AS rows_loaded,
  CASE WHEN n IS NULL THEN 'no summary file' WHEN bad > 0 THEN bad || ' rows not parsed'
       WHEN n = bad THEN 'empty summary file' END AS error
FROM (SELECT DISTINCT 2 * s_suppkey AS run FROM supplier)
LEFT JOIN (SELECT l_suppkey AS run, count(*) AS n, count(*) FILTER (l_quantity = 50 AND l_suppkey % 4 = 0) AS bad
           FROM lineitem GROUP BY 1) USING (run)""",
)
def s10(spark, sf):
    """Every other expected run has no lines; full quantities of some stand for bad rows."""
    expected = table(spark, sf, "supplier").select((2 * F.col("s_suppkey")).alias("run")).distinct()
    broken = (F.col("l_quantity") == 50) & (F.col("l_suppkey") % 4 == 0)
    loaded = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.when(broken, F.lit("?")).alias(CORRUPT)
    )
    json_runs = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("run"))
    return load_log(expected, loaded, json_runs)


@query(
    "s11_latest_version",
    """
SELECT split_part(url, '/', 3) AS host, max(url) AS url, count(*) AS versions FROM pages GROUP BY 1""",
)
def s11(spark, sf):
    pages = table(spark, sf, "pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("host"), "url")
    return latest_per_key(pages, "host", "url")


@query(
    "s12_sinks_round_trip",
    """
SELECT o_orderstatus AS status, count(*) AS n_parquet, count(*) AS n_json,
       round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def s12(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parquet = write_table(orders, scratch_path(spark, "table"), ["o_orderstatus"])
    json = write_json(orders, scratch_path(spark, "json"))
    a = spark.read.parquet(parquet).groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n_parquet"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    b = spark.read.schema("o_orderstatus string").json(json)
    b = b.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n_json"))
    return a.join(b, "status")


@query(
    "s13_header_fix",
    """
SELECT 'C' || c_custkey::VARCHAR AS code, c_mktsegment AS gender, c_acctbal AS score FROM customer""",
)
def s13(spark, sf):
    """Text columns whose first data row is the real header."""
    body = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("Unnamed: 0"),
        F.col("c_mktsegment").alias("Unnamed: 1"),
        F.col("c_acctbal").cast("string").alias("Unnamed: 2"),
    )
    header = spark.createDataFrame([("Participant code", "Gender", "Score")], body.schema)
    return promote_header(
        header.unionByName(body), "Participant code", ["code", "gender", "score"], ["score"]
    )
