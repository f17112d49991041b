"""P: column roles, feature dictionaries, filters.

Feature names are spelled from the data: an event type, a low-level descriptor drawn
from it and a functional.
"""

from pyspark.sql import functions as F

from gsx.functions.names import padded_code
from gsx.operators.columns import (
    category_sets,
    class_summary,
    classified,
    coerce_numeric,
    column_audit,
    drop_columns,
    drop_incomplete_columns,
    drop_incomplete_rows,
    domain_presence,
    equal_thirds,
    exclude_domains,
    exclusion_report,
    filter_report,
    keep_columns,
    knowledge_sets,
    numbered,
    prefix_groups,
    split_errors,
    substring_groups,
    usable_features,
)
from gsx.operators.stats import rank_by_auc, signed_auc
from gsx.plans.base import (
    DOC_DOMAINS,
    DOC_SQL,
    LINE_FEATURES,
    LINE_SQL,
    doc_long,
    line_features,
    r6,
    registry,
    sql_ranked,
    table,
)
from gsx.schema import FeatureSchema

QUERIES, query = registry()

# descriptor names that replace the adjective and the noun of a part name
FIRST = {
    "small": "mfcc_sma", "red": "pcm_zcr_sma", "blue": "F0final_sma", "hot": "jitterLocal_sma",
    "old": "pcm_RMSenergy_sma", "new": "lsf_sma", "large": "audspec_sma", "green": "shimmerLocal_sma",
}
LAST = {
    "ring": "amean", "widget": "stddev", "bolt": "percentile95.0", "gear": "iqr1-3",
    "gizmo": "numPeaks", "plate": "kurtosis", "nut": "range",
}


def feature_names(spark, sf):
    """Distinct feature names spelled from part names and sizes."""
    first = F.create_map(*[F.lit(x) for kv in FIRST.items() for x in kv])
    last = F.create_map(*[F.lit(x) for kv in LAST.items() for x in kv])
    words = F.split("p_name", " ")
    stem = F.coalesce(first[words[0]], F.concat(words[0], F.lit("_sma")))
    tail = F.coalesce(last[words[1]], words[1])
    name = F.concat(stem, F.lit("["), F.col("p_size").cast("string"), F.lit("]_"), tail)
    return table(spark, sf, "part").select(name.alias("feature")).distinct()


def _case(expr, mapping, other):
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


NAMES_SQL = f"""
names AS (
  SELECT DISTINCT {_case("split_part(p_name, ' ', 1)", FIRST, "split_part(p_name, ' ', 1) || '_sma'")}
    || '[' || p_size::VARCHAR || ']_' || {_case("split_part(p_name, ' ', 2)", LAST, "split_part(p_name, ' ', 2)")}
    AS feature
  FROM part)"""

CLASS_SQL = """
classes AS (
  SELECT feature,
    CASE WHEN regexp_matches(lower(feature), '^(jitter|shimmer|hnr|loghnr|voicingprob|f0final|f0env)') THEN 'Voice Quality'
         WHEN lower(feature) LIKE 'mfcc%' THEN 'MFCC'
         WHEN regexp_matches(lower(feature), '^(pcm_loudness|pcm_rmsenergy|energy|loudness)') THEN 'Prosodic/Energy'
         WHEN regexp_matches(lower(feature), '^(pcm_fftmag|audspec|spectral|chroma)') THEN 'Spectral'
         WHEN regexp_matches(lower(feature), '^(pcm_zcr|voicedsegments|unvoicedsegments|duration|tempo)') THEN 'Temporal/ZCR'
         WHEN regexp_matches(lower(feature), '^(lsf|lpc|lsp)') THEN 'LSF/LPC' ELSE 'Other' END AS class,
    regexp_replace(feature, '(?i)_(amean|stddev|percentile[0-9.]+|iqr[0-9-]+|numPeaks|kurtosis|range)$', '') AS stem
  FROM names)"""


@query(
    "p1_exclude_domain",
    """
SELECT lang, count(*) AS rows, lang IN ('fr', 'es') AS excluded FROM documents GROUP BY 1""",
)
def p1(spark, sf):
    return exclusion_report(table(spark, sf, "documents"), "lang", ["fr", "es"])


@query(
    "p1_rows_after_exclusion",
    "SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('fr', 'es')",
)
def p1_rows(spark, sf):
    return exclude_domains(table(spark, sf, "documents"), "lang", ["fr", "es"]).select(
        "doc_id", "lang"
    )


@query(
    "p2_domain_presence",
    """
SELECT e.lang, count(d.doc_id)::BIGINT AS rows, count(d.doc_id) > 0 AS present
FROM (VALUES ('en'), ('de'), ('it')) e(lang) LEFT JOIN documents d ON d.lang = e.lang GROUP BY 1""",
)
def p2(spark, sf):
    return domain_presence(table(spark, sf, "documents"), "lang", ["en", "de", "it"])


@query(
    "p3_feature_columns",
    """
SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS feature, count(*) AS rows
FROM lineitem""",
)
def p3(spark, sf):
    """Numeric columns outside the meta list, with the rows that hold a value."""
    df = table(spark, sf, "lineitem")
    roles = FeatureSchema.infer(
        df, "l_orderkey", "l_returnflag", "l_suppkey", "l_linestatus", ("l_partkey", "l_linenumber")
    )
    one = df.agg(*[F.count(f).alias(f) for f in roles.features])
    return one.unpivot([], list(roles.features), "feature", "rows")


@query(
    "p4_drop_list",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem""",
)
def p4(spark, sf):
    df, _absent = drop_columns(
        table(spark, sf, "lineitem"),
        ["l_tax", "l_discount", "l_comment", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"],
    )
    return df


@query("p5_keep_list", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def p5(spark, sf):
    df, _missing = keep_columns(
        table(spark, sf, "orders"), ["o_orderkey"], ["o_custkey", "o_clerk", "o_totalprice"]
    )
    return df


@query(
    "p5_column_audit",
    """
SELECT c.column, c.action, (SELECT count(*) FROM orders)::BIGINT AS rows
FROM (VALUES ('o_clerk', 'absent'), ('o_orderdate', 'dropped'), ('o_custkey', 'kept'),
             ('o_comment', 'missing')) c("column", action)""",
)
def p5_audit(spark, sf):
    df = table(spark, sf, "orders")
    audit = column_audit(df, ["o_clerk", "o_orderdate"], ["o_custkey", "o_comment"])
    return audit.withColumn("rows", F.lit(df.count()).cast("bigint"))


@query(
    "p6_substring_groups",
    f"""WITH {NAMES_SQL}
SELECT 'prosody' AS group_name, feature FROM names
WHERE regexp_matches(lower(feature), 'f0|pitch|jitter|shimmer|hnr|nhr')
UNION ALL
SELECT 'spectral', feature FROM names
WHERE regexp_matches(lower(feature), 'mfcc|lsp|spectral|zcr|energy|loudness')""",
)
def p6(spark, sf):
    return substring_groups(feature_names(spark, sf))


PREFIXES = {"structural": ["mfcc_sma[1]_", "mfcc_sma[2]_", "MFCC_sma[3]_"], "temporal": ["pcm_zcr_sma"]}


@query(
    "p7_prefix_groups",
    f"""WITH {NAMES_SQL}
SELECT 'structural' AS group_name, feature FROM names
WHERE starts_with(lower(feature), 'mfcc_sma[1]_') OR starts_with(lower(feature), 'mfcc_sma[2]_')
   OR starts_with(lower(feature), 'mfcc_sma[3]_')
UNION ALL
SELECT 'temporal', feature FROM names WHERE starts_with(lower(feature), 'pcm_zcr_sma')""",
)
def p7(spark, sf):
    return prefix_groups(feature_names(spark, sf), PREFIXES)


@query(
    "p8_name_classes",
    f"WITH {NAMES_SQL}, {CLASS_SQL} SELECT feature, class FROM classes",
)
def p8(spark, sf):
    return classified(feature_names(spark, sf)).select("feature", "class")


@query("p9_name_stems", f"WITH {NAMES_SQL}, {CLASS_SQL} SELECT feature, stem FROM classes")
def p9(spark, sf):
    return classified(feature_names(spark, sf)).select("feature", "stem")


@query(
    "p10_class_summary",
    f"""WITH {NAMES_SQL}, {CLASS_SQL}
SELECT class, count(*) AS n_features, count(DISTINCT stem) AS n_stems FROM classes GROUP BY 1""",
)
def p10(spark, sf):
    return class_summary(feature_names(spark, sf))


@query(
    "p11_equal_thirds",
    f"""WITH {NAMES_SQL}
SELECT feature, CASE WHEN pos < n // 3 THEN 'first' WHEN pos < 2 * n // 3 THEN 'second' ELSE 'third' END AS part
FROM (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS pos, count(*) OVER () AS n FROM names)""",
)
def p11(spark, sf):
    return equal_thirds(numbered(feature_names(spark, sf))).select("feature", "part")


CATEGORIES = {"counts": ["n_"], "shares": ["digit_", "upper_", "n_lines"], "few": ["mean_"]}


@query(
    "p12_category_sets",
    f"""WITH {DOC_SQL},
usable AS (
  SELECT feature, min(c)::BIGINT AS min_rows FROM
    (SELECT feature, domain, count(value) AS c FROM doc_long GROUP BY 1, 2 HAVING count(value) > 0)
  GROUP BY 1 HAVING count(*) = 2),
sets AS (
  SELECT 'counts' AS group_name, feature FROM usable WHERE starts_with(feature, 'n_')
  UNION ALL SELECT 'shares', feature FROM usable
    WHERE starts_with(feature, 'digit_') OR starts_with(feature, 'upper_') OR starts_with(feature, 'n_lines')
  UNION ALL SELECT 'few', feature FROM usable WHERE starts_with(feature, 'mean_'))
SELECT group_name, feature, n_features FROM
  (SELECT *, count(*) OVER (PARTITION BY group_name) AS n_features FROM sets) WHERE n_features >= 3""",
)
def p12(spark, sf):
    usable = usable_features(doc_long(spark, sf), "domain", DOC_DOMAINS)
    return category_sets(usable.select("feature"), CATEGORIES)


@query(
    "p13_knowledge_sets",
    f"""WITH {DOC_SQL}, {sql_ranked()},
names AS (SELECT DISTINCT feature FROM doc_long)
SELECT 'fixed' AS set_name, feature FROM names WHERE feature IN ('n_chars', 'n_words')
UNION ALL SELECT 'fixed_and_extra', feature FROM names
  WHERE feature IN ('n_chars', 'n_words', 'digit_share')
UNION ALL SELECT 'without_family', feature FROM names WHERE NOT starts_with(feature, 'n_')
UNION ALL SELECT 'top_' || domain, feature FROM ranked WHERE rank <= 3""",
)
def p13(spark, sf):
    long = doc_long(spark, sf)
    names = long.select("feature").distinct()
    ranking = rank_by_auc(signed_auc(long, ["domain", "feature"]))
    return knowledge_sets(
        names, ranking, "n_", ["n_chars", "n_words"], ["n_words", "digit_share"], 3
    )


@query(
    "p14_numeric_coercion",
    """
SELECT doc_id, first_word, TRY_CAST(tail AS DOUBLE) AS number FROM (
  SELECT doc_id, split_part(source, 'c', 1) AS first_word,
         CASE WHEN lang = 'fr' THEN source ELSE substr(source, 4) END AS tail FROM documents)
WHERE TRY_CAST(tail AS DOUBLE) IS NOT NULL""",
)
def p14(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.split("source", "c")[0].alias("first_word"),
        F.when(F.col("lang") == "fr", F.col("source")).otherwise(F.substring("source", 4, 9)).alias("number"),
    )
    return coerce_numeric(docs, ["number"], ["number"])


@query(
    "p15_code_normalisation",
    """
SELECT s_suppkey, 'SUBJ' || CASE WHEN length(s_suppkey::VARCHAR) >= 4 THEN s_suppkey::VARCHAR
  ELSE lpad(s_suppkey::VARCHAR, 4, '0') END AS subject_id FROM supplier""",
)
def p15(spark, sf):
    code = F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", padded_code("SUBJ", code).alias("subject_id")
    )


@query(
    "p16_type_filter_report",
    """
SELECT event_type, count(*) AS rows, event_type IN ('click', 'view') AS kept FROM events GROUP BY 1""",
)
def p16(spark, sf):
    return filter_report(table(spark, sf, "events"), "event_type", ["click", "view"])


@query(
    "p17_error_split",
    """
SELECT 'good' AS side, count(*) AS rows, NULL AS error FROM documents WHERE length(text) >= 200
UNION ALL SELECT 'failed', count(*), 'too short' FROM documents WHERE length(text) < 200""",
)
def p17(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.length("text") < 200, "too short").alias("error")
    )
    good, failed = split_errors(docs, "error")
    good = good.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("good").alias("side"), "rows", F.lit(None).cast("string").alias("error")
    )
    failed = failed.agg(F.count(F.lit(1)).alias("rows"), F.max("error").alias("error"))
    return good.unionByName(failed.select(F.lit("failed").alias("side"), "rows", "error"))


def _holed(spark, sf):
    return line_features(spark, sf).withColumn("discount", F.nullif("discount", F.lit(0.04)))


@query(
    "p18_complete_columns",
    f"""WITH {LINE_SQL}
SELECT domain, round(avg(quantity), 6) AS quantity, round(avg(price), 6) AS price, round(avg(tax), 6) AS tax
FROM line GROUP BY 1""",
)
def p18(spark, sf):
    kept = drop_incomplete_columns(_holed(spark, sf), LINE_FEATURES)
    features = [f for f in LINE_FEATURES if f in kept.columns]
    return kept.groupBy("domain").agg(*[r6(F.avg(f)).alias(f) for f in features])


@query(
    "p18_complete_rows",
    f"""WITH {LINE_SQL}
SELECT domain, count(*) AS rows FROM line WHERE discount <> 0.04 GROUP BY 1""",
)
def p18_rows(spark, sf):
    kept = drop_incomplete_rows(_holed(spark, sf), LINE_FEATURES)
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))


