"""W: ranks, neighbours, first-k, arg-max, ordered top-k."""

from pyspark.sql import functions as F

from gsx.operators.joins import ordered_rows
from gsx.operators.ordered import running_counts, with_neighbours
from gsx.operators.split import first_k_per_group
from gsx.operators.stats import max_row
from gsx.plans.base import (
    EVENT_SQL,
    event_series,
    line_features,
    r6,
    registry,
    rounded,
    sql_hash,
    table,
    LINE_SQL,
)
from gsx.plans.joins import VRANK_SQL, vector_ranking
from gsx.plans.sources import EXACT_RESULT_SQL, exact_auc, result_rows

QUERIES, query = registry()


@query(
    "w1_rank_numbering",
    f"WITH {VRANK_SQL} SELECT domain, feature, rank, round(auc, 6) AS auc FROM ranked",
)
def w1(spark, sf):
    ranked = vector_ranking(spark, sf).select("domain", "feature", "rank", "auc")
    return rounded(ranked, "auc")


@query(
    "w2_average_rank",
    f"""WITH {LINE_SQL}
SELECT DISTINCT domain, price, rank() OVER (PARTITION BY domain ORDER BY price)
  + (count(*) OVER (PARTITION BY domain, price) - 1) / 2.0 AS avg_rank FROM line""",
)
def w2(spark, sf):
    counts = running_counts(line_features(spark, sf), "domain", "price", "label")
    before = F.col("pos_before") + F.col("neg_before")
    own = F.col("pos") + F.col("neg")
    return counts.select("domain", "price", (before + (own + 1) / 2.0).alias("avg_rank"))


@query(
    "w3_first_k_per_group",
    f"""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {sql_hash(42, 'doc_id')}) AS r,
  count(*) OVER (PARTITION BY source) AS c FROM documents) WHERE r <= 4 AND c >= 4""",
)
def w3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return first_k_per_group(docs, "source", "doc_id", 4)


@query(
    "w4_neighbours",
    f"""WITH {EVENT_SQL}
SELECT event_id, round(value - lag(value) OVER w, 6) AS diff,
  round(avg(value) OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5
FROM ev WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)""",
)
def w4(spark, sf):
    def near(w):
        return {
            "diff": r6(F.col("value") - F.lag("value").over(w)),
            "mean5": r6(F.avg("value").over(w.rowsBetween(-2, 2))),
        }

    rows = with_neighbours(event_series(spark, sf), "series", ["ts", "event_id"], 2, near)
    return rows.select("event_id", "diff", "mean5")


@query(
    "w5_arg_max_row",
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders)
WHERE r = 1""",
)
def w5(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return max_row(orders, ["o_custkey"], F.struct("o_totalprice", "o_orderkey"))


@query(
    "w6_mixed_order",
    f"""WITH {EXACT_RESULT_SQL}
SELECT run, analysis, model, row_number() OVER (ORDER BY CASE model WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END,
  auc DESC, run, analysis) AS position FROM res""",
)
def w6(spark, sf):
    key = F.when(F.col("model") == "R", 0).when(F.col("model") == "A", 1).otherwise(2)
    rows = ordered_rows(
        result_rows(spark, sf, exact_auc().alias("micro")),
        "position",
        [key, F.col("micro").desc(), F.col("run"), F.col("analysis")],
    )
    return rows.select("run", "analysis", "model", "position")


@query(
    "w7_top_k",
    """
(SELECT 'top' AS side, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15)
UNION ALL
(SELECT 'bottom', l_orderkey, l_linenumber, l_extendedprice FROM lineitem
 ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 15)""",
)
def w7(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    price = F.col("l_extendedprice")
    top = rows.orderBy(price.desc(), "l_orderkey", "l_linenumber").limit(15)
    low = rows.orderBy(price.asc(), "l_orderkey", "l_linenumber").limit(15)
    return top.withColumn("side", F.lit("top")).unionByName(low.withColumn("side", F.lit("bottom")))


