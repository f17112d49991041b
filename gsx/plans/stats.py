"""A: aggregations, class statistics, feature ranking."""

from pyspark.sql import functions as F

from gsx.operators import trees
from gsx.operators.stats import (
    anova_f,
    class_crosstab,
    class_scores,
    consensus,
    consistency_ranking,
    density_curves,
    direction_check,
    direction_table,
    domain_summary,
    fold_spread,
    folded_auc,
    fuse_ranks,
    group_means,
    null_audit,
    pivot_auc,
    rank_by_auc,
    signed_auc,
    spearman,
    top_by,
    union_and_stable,
    variance_filter,
)
from gsx.plans.base import (
    DOC_DOMAINS,
    DOC_FEATURES,
    DOC_SQL,
    LINE_FEATURES,
    LINE_SQL,
    VLONG_SQL,
    doc_features,
    doc_long,
    line_features,
    line_long,
    r6,
    registry,
    rounded,
    sql_auc,
    sql_class_scores,
    sql_ranked,
    table,
    vector_long,
)
from gsx.plans.joins import VRANK_SQL, doc_ranking, vector_ranking
from gsx.session import settle

QUERIES, query = registry()


@query(
    "a1_domain_summary",
    """
SELECT source AS domain, count(*) AS rows, count(*) FILTER (quality = 1) AS positives,
  count(*) FILTER (quality = 0) AS negatives, count(DISTINCT lang) AS groups,
  round(count(*)::DOUBLE / count(DISTINCT lang), 6) AS rows_per_group, min(lang) AS language
FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def a1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    rows = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("source").alias("domain"), F.col("quality").alias("label"), F.col("lang").alias("grp"),
        F.col("lang").alias("language"),
    )
    out = domain_summary(rows, "domain", "label", "grp", "language")
    return rounded(out, "rows_per_group")


@query(
    "a2_class_crosstab",
    """
SELECT coalesce(lang, 'TOTAL') AS lang, count(*) FILTER (quality = 0) AS class_0,
  count(*) FILTER (quality = 1) AS class_1, count(*) AS total,
  round(100.0 * count(*) / (SELECT count(*) FROM labels JOIN documents USING (doc_id)), 6) AS percent
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""",
)
def a2(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels"), "doc_id"
    )
    return rounded(class_crosstab(rows, "lang", "quality", [0, 1]), "percent")


@query(
    "a3_null_audit",
    f"""WITH {LINE_SQL}, h AS (SELECT *, nullif(discount, 0.04) AS d2, nullif(quantity, 7) AS q2 FROM line)
SELECT 'discount' AS feature, count(*) - count(d2) AS nulls, count(*) AS rows, round((count(*) - count(d2))::DOUBLE / count(*), 6) AS share FROM h
UNION ALL SELECT 'quantity', count(*) - count(q2), count(*), round((count(*) - count(q2))::DOUBLE / count(*), 6) FROM h
UNION ALL SELECT 'price', count(*) - count(price), count(*), round((count(*) - count(price))::DOUBLE / count(*), 6) FROM h
UNION ALL SELECT 'tax', count(*) - count(tax), count(*), round((count(*) - count(tax))::DOUBLE / count(*), 6) FROM h""",
)
def a3(spark, sf):
    rows = line_features(spark, sf).withColumns(
        {
            "discount": F.nullif("discount", F.lit(0.04)),
            "quantity": F.nullif("quantity", F.lit(7.0)),
        }
    )
    return rounded(null_audit(rows, LINE_FEATURES), "share")


@query(
    "a4_variance_filter",
    f"""WITH {LINE_SQL}
SELECT feature, round(var_pop(value), 6) AS variance, var_pop(value) > 0.001 AS keep FROM line_long
WHERE domain = 'F' GROUP BY 1""",
)
def a4(spark, sf):
    train = line_features(spark, sf).filter("domain = 'F'")
    return rounded(variance_filter(train, LINE_FEATURES), "variance")


EXPECTED = {
    "n_chars": "pos>neg", "n_words": "pos>neg", "n_lines": "pos<neg", "digit_share": "pos<neg",
    "upper_share": "pos>neg",
}


@query(
    "a5_direction_check",
    f"""WITH {DOC_SQL}, s AS ({sql_class_scores("doc_long", "feature")})
SELECT feature, round(pos_mean, 6) AS pos_mean, round(neg_mean, 6) AS neg_mean,
  CASE WHEN direction = CASE WHEN feature IN ('n_chars', 'n_words', 'upper_share') THEN 'pos>neg' ELSE 'pos<neg' END
       THEN 'OK' ELSE 'INVERTED' END AS "check",
  round(p_value, 6) AS p_value,
  CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS stars,
  round(abs(pos_mean - neg_mean) / (sqrt(((p - 1) * pos_sd * pos_sd + (n - 1) * neg_sd * neg_sd) / (p + n - 2)) + 1e-10), 6) AS cohen_d
FROM s WHERE feature <> 'mean_word_len'""",
)
def a5(spark, sf):
    out = direction_check(doc_long(spark, sf), EXPECTED)
    return rounded(out, "pos_mean", "neg_mean", "p_value", "cohen_d")


@query(
    "a6_mann_whitney",
    f"""WITH {LINE_SQL}, s AS ({sql_class_scores("line_long", "domain, feature")})
SELECT domain, feature, p::BIGINT AS n_pos, n::BIGINT AS n_neg, u, round(p_value, 6) AS p_value FROM s""",
)
def a6(spark, sf):
    out = class_scores(line_long(spark, sf), ["domain", "feature"])
    return out.select("domain", "feature", "n_pos", "n_neg", "u", r6("p_value").alias("p_value"))


RANK_OUT = """SELECT domain, feature, rank, n_pos, n_neg, round(auc, 6) AS auc, round(p_value, 6) AS p_value,
  round(pos_mean, 6) AS pos_mean, round(neg_mean, 6) AS neg_mean, direction FROM ranked"""


def _rank_out(ranked):
    return rounded(
        ranked.select(
            "domain", "feature", "rank", "n_pos", "n_neg", "auc", "p_value", "pos_mean",
            "neg_mean", "direction",
        ),
        "auc", "p_value", "pos_mean", "neg_mean",
    )


@query("a7_signed_auc_ranking", f"WITH {DOC_SQL}, {sql_ranked()} {RANK_OUT}")
def a7(spark, sf):
    return _rank_out(doc_ranking(spark, sf))


@query("a7_signed_auc_lines", f"WITH {LINE_SQL}, {sql_ranked('line_long')} {RANK_OUT}")
def a7_lines(spark, sf):
    return _rank_out(rank_by_auc(signed_auc(line_long(spark, sf), ["domain", "feature"])))


@query("a7_signed_auc_vectors", f"WITH {VRANK_SQL} {RANK_OUT}")
def a7_vectors(spark, sf):
    return _rank_out(vector_ranking(spark, sf))


@query(
    "a8_folded_auc",
    f"""WITH {DOC_SQL},
b AS (SELECT feature, domain, value, label FROM doc_long UNION ALL SELECT feature, 'combined', value, label FROM doc_long),
s AS ({sql_auc("b", "feature, domain", "value")})
SELECT feature, """
    + ", ".join(
        f"round(max(greatest(auc, 1 - auc)) FILTER (domain = '{d}' AND n_pos + n_neg >= 10), 6) AS {d}_auc"
        for d in (*DOC_DOMAINS, "combined")
    )
    + " FROM s GROUP BY 1",
)
def a8(spark, sf):
    wide = pivot_auc(folded_auc(doc_long(spark, sf)), [*DOC_DOMAINS, "combined"])
    return rounded(wide, "en_auc", "rest_auc", "combined_auc")


@query(
    "a9_rank_by_auc",
    f"WITH {LINE_SQL}, {sql_ranked('line_long')} SELECT domain, feature, rank FROM ranked",
)
def a9(spark, sf):
    scores = signed_auc(line_long(spark, sf), ["domain", "feature"])
    return rank_by_auc(scores).select("domain", "feature", "rank")


CONS_SQL = f"""{VRANK_SQL},
cons AS (
  SELECT feature, count(*) FILTER (rank <= 10) AS dataset_count,
    string_agg(domain, ' | ' ORDER BY domain) FILTER (rank <= 10) AS in_datasets,
    max(rank) FILTER (domain = '0') AS "0_rank", max(auc) FILTER (domain = '0') AS "0_auc",
    max(rank) FILTER (domain = '1') AS "1_rank", max(auc) FILTER (domain = '1') AS "1_auc",
    avg(auc) FILTER (rank <= 10) AS mean_auc_in_top
  FROM ranked GROUP BY 1 HAVING count(*) FILTER (rank <= 10) > 0)"""


@query(
    "a10_consensus",
    f"""WITH {CONS_SQL}
SELECT feature, dataset_count, in_datasets, "0_rank", round("0_auc", 6) AS "0_auc", "1_rank", round("1_auc", 6) AS "1_auc",
  round(mean_auc_in_top, 6) AS mean_auc_in_top, dataset_count = 2 AS is_common_all FROM cons""",
)
def a10(spark, sf):
    out = consensus(vector_ranking(spark, sf), ["0", "1"], 10)
    return rounded(out, "0_auc", "1_auc", "mean_auc_in_top")


@query(
    "a11_union_and_stable",
    f"""WITH {CONS_SQL}
SELECT 'UNION' AS set_name, feature FROM cons UNION ALL SELECT 'STABLE', feature FROM cons WHERE dataset_count >= 2""",
)
def a11(spark, sf):
    return union_and_stable(consensus(vector_ranking(spark, sf), ["0", "1"], 10))


CONSIST_SQL = f"""{VRANK_SQL},
c AS (SELECT feature, count(*) AS n_domains, avg(auc) AS mean_auc, min(auc) AS min_auc,
        min(direction) = max(direction) AS same_direction FROM ranked GROUP BY 1 HAVING count(*) = 2),
k AS (SELECT * FROM c WHERE same_direction OR (SELECT count(*) FILTER (same_direction) FROM c) < 20),
cr AS (SELECT *, row_number() OVER (ORDER BY min_auc DESC, feature)::INT AS rank FROM k)"""


@query(
    "a12_consistency_ranking",
    f"""WITH {CONSIST_SQL}
SELECT feature, n_domains, round(mean_auc, 6) AS mean_auc, round(min_auc, 6) AS min_auc, same_direction, rank FROM cr""",
)
def a12(spark, sf):
    scores = signed_auc(vector_long(spark, sf), ["domain", "feature"])
    return rounded(consistency_ranking(scores, 2), "mean_auc", "min_auc")


@query(
    "a13_direction_table",
    f"""WITH {DOC_SQL},
m AS (SELECT feature, domain, CASE WHEN avg(value) FILTER (label = 1) > avg(value) FILTER (label = 0) THEN 'pos>neg' ELSE 'pos<neg' END AS d
      FROM doc_long GROUP BY 1, 2)
SELECT feature, max(d) FILTER (domain = 'en') AS en_direction, max(d) FILTER (domain = 'rest') AS rest_direction,
  min(d) = max(d) AS compatible FROM m GROUP BY 1""",
)
def a13(spark, sf):
    return direction_table(doc_long(spark, sf), DOC_DOMAINS)


@query(
    "a14_group_means",
    f"""WITH {LINE_SQL}
SELECT grp, round(avg(quantity), 6) AS quantity, round(avg(price), 6) AS price, round(avg(discount), 6) AS discount,
  round(avg(tax), 6) AS tax, min(domain) AS domain, min(label) AS label, min(label) = max(label) AS label_consistent
FROM line GROUP BY 1""",
)
def a14(spark, sf):
    out = group_means(line_features(spark, sf), "grp", "label", LINE_FEATURES, carry=["domain"])
    return rounded(out, *LINE_FEATURES)


@query(
    "a15_spearman",
    f"""WITH {VRANK_SQL},
w AS (SELECT feature, max(auc) FILTER (domain = '0') AS a, max(auc) FILTER (domain = '1') AS b FROM ranked GROUP BY 1 HAVING count(*) = 2),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM w),
o AS (SELECT count(*) AS n, corr(ra, rb) AS rho, corr(ra, rb) * sqrt((count(*) - 2) / (1 - corr(ra, rb) * corr(ra, rb))) AS t FROM r),
g AS (SELECT *, n - 2 AS df, (n - 2) % 2 AS odd, atan(abs(t) / sqrt(n - 2)) AS angle FROM o),
-- the finite sum for whole degrees of freedom
k AS (SELECT *, unnest(range(0, (df - odd) // 2)) AS k FROM g),
c AS (SELECT *, exp(sum(CASE WHEN k = 0 THEN 0 WHEN odd = 1 THEN ln(2.0 * k / (2 * k + 1)) ELSE ln((2.0 * k - 1) / (2 * k)) END)
                    OVER (ORDER BY k)) * cos(angle) ** (2 * k + odd) AS part FROM k),
s AS (SELECT coalesce(sum(part), 0) AS total FROM c)
SELECT '0' AS domain_a, '1' AS domain_b, n, round(rho, 6) AS rho, round(t, 6) AS t,
  round(1 - CASE WHEN odd = 1 THEN 2 / pi() * (angle + sin(angle) * total) ELSE sin(angle) * total END, 6) AS p_value
FROM g, s""",
)
def a15(spark, sf):
    return rounded(spearman(vector_ranking(spark, sf), "0", "1"), "rho", "t", "p_value")


@query(
    "a16_rank_fusion",
    f"""WITH {VRANK_SQL},
w AS (SELECT feature, max(rank) FILTER (domain = '0') AS rank_0, max(rank) FILTER (domain = '1') AS rank_1 FROM ranked GROUP BY 1 HAVING count(*) = 2)
SELECT *, (rank_0 + rank_1) / 2.0 AS mean_rank,
  row_number() OVER (ORDER BY (rank_0 + rank_1) / 2.0, feature)::INT AS overall_rank FROM w""",
)
def a16(spark, sf):
    r = vector_ranking(spark, sf)
    wide = r.groupBy("feature").agg(
        F.max(F.when(F.col("domain") == "0", F.col("rank"))).alias("rank_0"),
        F.max(F.when(F.col("domain") == "1", F.col("rank"))).alias("rank_1"),
    ).filter("rank_0 IS NOT NULL AND rank_1 IS NOT NULL")
    return fuse_ranks(wide, ["rank_0", "rank_1"])


@query(
    "a17_anova_top_k",
    f"""WITH {VLONG_SQL},
c AS (SELECT domain, feature, label, count(*)::DOUBLE AS c, avg(value) AS m, var_pop(value) AS v FROM vlong GROUP BY 1, 2, 3),
g AS (SELECT *, sum(c * m) OVER w / sum(c) OVER w AS gm FROM c WINDOW w AS (PARTITION BY domain, feature)),
f AS (SELECT domain, feature, (sum(c * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(c * v) / (sum(c) - count(*))) AS f_stat
      FROM g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY f_stat DESC, feature)::INT AS rank FROM f)
SELECT domain, feature, round(f_stat, 6) AS f_stat, rank FROM r WHERE rank <= 10""",
)
def a17(spark, sf):
    stats = anova_f(vector_long(spark, sf), ["domain", "feature"])
    return rounded(top_by(stats, "f_stat", "feature", 10, ["domain"]), "f_stat")


@query("a18_impurity_importance")
def a18(spark, sf):
    # text is read once; the forests see six numbers of a document
    docs = settle(doc_features(spark, sf).select("doc_id", "domain", "label", *DOC_FEATURES))
    sets = docs.withColumn("fitted_on", F.explode(F.array("domain", F.lit("combined"))))
    found = trees.importances(sets, DOC_FEATURES, "label", "doc_id", "fitted_on", trees.SPECS["forest_300"])
    return found.select("rank", "feature", "importance", F.col("part").alias("fitted_on"))


@query(
    "a19_density_curves",
    f"""WITH {DOC_SQL},
s AS (SELECT label, feature, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM doc_long GROUP BY 1, 2),
k AS (SELECT *, sd * pow(n, -0.2) AS h FROM s WHERE n > 1 AND sd > 0),
g AS (SELECT k.*, p.point, lo + p.point * (hi - lo) / 199.0 AS x FROM k, range(0, 200) p(point))
SELECT label, feature, point::INT AS point, round(x, 6) AS x,
  round(sum(exp(-((x - value) / h) * ((x - value) / h) / 2) / (n * h * sqrt(2 * pi()))), 6) AS density
FROM g JOIN doc_long USING (label, feature) GROUP BY 1, 2, 3, x""",
)
def a19(spark, sf):
    out = density_curves(doc_long(spark, sf), ["label", "feature"], points=200)
    return rounded(out, "x", "density")


@query(
    "a20_fold_spread",
    f"""WITH {LINE_SQL},
b AS (SELECT domain AS model, (grp % 5)::INT AS fold, price AS value, label FROM line),
s AS ({sql_auc("b", "model, fold", "value")})
SELECT model, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std FROM s GROUP BY 1""",
)
def a20(spark, sf):
    from gsx.operators.ordered import auc

    rows = line_features(spark, sf).select(
        F.col("domain").alias("model"), (F.col("grp") % 5).alias("fold"), "price", "label"
    )
    folds = auc(rows, ["model", "fold"], "price", "label")
    return rounded(fold_spread(folds, ["model"], ["auc"]), "auc_mean", "auc_std")


