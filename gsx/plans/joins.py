"""J and U: joins, set operations and dataset assembly."""

from pyspark.sql import functions as F

from gsx.operators.joins import (
    join_rankings,
    map_values,
    member_flag,
    side_by_side,
    transfer_cells,
    union_domains,
    with_features,
    with_subject_metadata,
)
from gsx.operators.dedup import run_pair_matches
from gsx.operators.split import (
    balanced_groups,
    first_k_per_group,
    seeded_order,
    stratified_split,
    undersample,
)
from gsx.operators.stats import overlap_counts, rank_by_auc, signed_auc
from gsx.plans.base import (
    DOC_DOMAINS,
    DOC_SQL,
    VLONG_SQL,
    doc_features,
    doc_long,
    registry,
    rounded,
    sql_hash,
    sql_ranked,
    table,
    vector_long,
)
from gsx.plans.sources import RESULT_SQL, result_rows

QUERIES, query = registry()


def doc_ranking(spark, sf):
    return rank_by_auc(signed_auc(doc_long(spark, sf), ["domain", "feature"]))


def vector_ranking(spark, sf):
    return rank_by_auc(signed_auc(vector_long(spark, sf), ["domain", "feature"]))


VRANK_SQL = f"{VLONG_SQL}, {sql_ranked('vlong')}"


@query(
    "j1_metadata_with_features",
    f"WITH {DOC_SQL} SELECT doc_id, source, label, n_words FROM doc",
)
def j1(spark, sf):
    feats = doc_features(spark, sf).select("doc_id", "label", "n_words")
    return with_features(table(spark, sf, "documents").select("doc_id", "source"), feats, "doc_id")


@query(
    "j2_subject_metadata",
    """
SELECT o_orderkey, c_mktsegment AS gender, c_mktsegment IS NOT NULL AS known
FROM orders LEFT JOIN customer ON o_custkey = 2 * c_custkey""",
)
def j2(spark, sf):
    # doubled keys leave the orders of odd customers without a subject
    subjects = table(spark, sf, "customer").select(
        (2 * F.col("c_custkey")).alias("o_custkey"), F.col("c_mktsegment").alias("gender")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return with_subject_metadata(orders, subjects, "o_custkey", "gender").drop("o_custkey")


@query(
    "j2_unknown_subjects",
    """
SELECT o_orderstatus, count(*) AS unknown FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE 2 * c_custkey = o_custkey) GROUP BY 1""",
)
def j2_unknown(spark, sf):
    known = table(spark, sf, "customer").select((2 * F.col("c_custkey")).alias("c_custkey"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    left = orders.join(known, orders.o_custkey == known.c_custkey, "left_anti")
    return left.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("unknown"))


@query(
    "j3_join_rankings",
    f"""WITH {DOC_SQL}, {sql_ranked()}
SELECT feature, max(rank) FILTER (domain = 'en') AS en_rank, max(rank) FILTER (domain = 'rest') AS rest_rank
FROM ranked GROUP BY 1 HAVING count(*) = 2""",
)
def j3(spark, sf):
    r = doc_ranking(spark, sf)
    return join_rankings({d: r.filter(F.col("domain") == d) for d in DOC_DOMAINS})


@query(
    "j4_map_values",
    "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey",
)
def j4(spark, sf):
    # keys are shifted so that some customers have no match
    names = table(spark, sf, "nation").select(
        (F.col("n_nationkey") - 5).alias("c_nationkey"), F.col("n_name").alias("nation")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return map_values(customers, names, "c_nationkey").select("c_custkey", "nation")


@query(
    "j5_membership_flag",
    """
SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
  THEN 'Y' END AS member FROM part""",
)
def j5(spark, sf):
    members = table(spark, sf, "lineitem").filter("l_quantity > 49").select(
        F.col("l_partkey").alias("p_partkey")
    )
    return member_flag(table(spark, sf, "part").select("p_partkey"), members, "p_partkey")


@query(
    "j6_transfer_cells",
    """
WITH d AS (SELECT DISTINCT lang AS name FROM documents UNION ALL SELECT 'Combined')
SELECT a.name AS train, b.name AS test FROM d a, d b""",
)
def j6(spark, sf):
    return transfer_cells(table(spark, sf, "documents"), "lang")


@query(
    "j7_side_by_side",
    f"""WITH {DOC_SQL}, {sql_ranked()}
SELECT rank, max(feature) FILTER (domain = 'en') AS en_feature, round(max(auc) FILTER (domain = 'en'), 6) AS en_auc,
  max(feature) FILTER (domain = 'rest') AS rest_feature, round(max(auc) FILTER (domain = 'rest'), 6) AS rest_auc
FROM ranked WHERE rank <= 5 GROUP BY 1""",
)
def j7(spark, sf):
    return rounded(side_by_side(doc_ranking(spark, sf), DOC_DOMAINS, 5), "en_auc", "rest_auc")


@query(
    "j8_run_pair_matches",
    f"""WITH {RESULT_SQL}
SELECT a.run AS run_a, b.run AS run_b, count(*) AS n_match FROM res a JOIN res b
  ON a.run < b.run AND a.analysis = b.analysis AND a.model = b.model
WHERE abs(a.auc - b.auc) <= 0.0015 AND abs(a.accuracy - b.accuracy) <= 0.0015 GROUP BY 1, 2""",
)
def j8(spark, sf):
    rows = result_rows(spark, sf)
    return run_pair_matches(rows, "run", ["analysis", "model"], ["auc", "accuracy"], 0.0015)


@query(
    "u1_union_domains",
    "SELECT lang, count(*) AS rows FROM documents GROUP BY 1",
)
def u1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    both = union_domains([docs.filter("lang = 'en'"), docs.filter("NOT lang <=> 'en'")])
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "u2_union_missing_columns",
    """
SELECT 'customer' AS dataset, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def u2(spark, sf):
    a = table(spark, sf, "customer").select(
        F.lit("customer").alias("dataset"),
        F.col("c_custkey").alias("key"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    b = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("dataset"),
        F.col("s_suppkey").alias("key"),
        F.col("s_acctbal").alias("balance"),
    )
    return union_domains([a, b], by_name_missing=True)


@query(
    "u3_top_set_membership",
    f"""WITH {VRANK_SQL}
SELECT feature, count(*) AS n_domains FROM ranked WHERE rank <= 14 GROUP BY 1""",
)
def u3(spark, sf):
    top = vector_ranking(spark, sf).filter("rank <= 14")
    return top.groupBy("feature").agg(F.count(F.lit(1)).alias("n_domains"))


CUTOFFS = (5, 9, 14, 20, 30, 50)


@query(
    "u4_overlap_counts",
    f"""WITH {VRANK_SQL},
w AS (SELECT feature, max(rank) FILTER (domain = '0') AS ra, max(rank) FILTER (domain = '1') AS rb FROM ranked GROUP BY 1)
SELECT cutoff::INT AS cutoff, count(*) FILTER (ra <= cutoff AND rb <= cutoff) AS shared
FROM w, (VALUES (5), (9), (14), (20), (30), (50)) c(cutoff) GROUP BY 1""",
)
def u4(spark, sf):
    return overlap_counts(vector_ranking(spark, sf), "0", "1", CUTOFFS)


@query(
    "u5_seeded_shuffle",
    f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash(42, 'o_orderkey')}) AS position FROM orders""",
)
def u5(spark, sf):
    return seeded_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "u6_undersample",
    f"""
SELECT doc_id, quality FROM (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash(42, 'doc_id')}) AS r FROM labels)
WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality))""",
)
def u6(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return undersample(labels, "quality", "doc_id")


ORDER_ROWS = f"""
o AS (SELECT o_orderkey, o_custkey, (o_orderstatus = 'F')::INT AS label FROM orders),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {sql_hash(42, 'o_orderkey')}) AS r,
             count(*) OVER (PARTITION BY o_custkey) AS c FROM o) WHERE r <= 3 AND c >= 3)"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )


@query("u7_first_k_per_group", f"WITH {ORDER_ROWS} SELECT o_orderkey, o_custkey, label FROM k")
def u7(spark, sf):
    return first_k_per_group(_orders(spark, sf), "o_custkey", "o_orderkey", 3)


@query(
    "u7_balanced_groups",
    f"""WITH {ORDER_ROWS},
g AS (SELECT o_custkey, min(label) AS cls FROM k GROUP BY 1),
c AS (SELECT o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {sql_hash(42, 'o_custkey')}) AS r FROM g)
      WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM g GROUP BY cls)))
SELECT o_orderkey, o_custkey, label FROM k WHERE o_custkey IN (SELECT o_custkey FROM c)""",
)
def u7b(spark, sf):
    return balanced_groups(_orders(spark, sf), "o_custkey", "label", "o_orderkey", 3)


@query(
    "u8_stratified_split",
    f"""
SELECT doc_id, quality, CASE WHEN r <= floor(c * 0.3) THEN 'fit' ELSE 'test' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash(42, 'doc_id')}) AS r,
         count(*) OVER (PARTITION BY quality) AS c FROM labels)""",
)
def u8(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return stratified_split(labels, "quality", "doc_id", 0.3)


