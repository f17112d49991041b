"""Inputs shared by the queries, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gsx.sources.scan import read_table

DOC_FEATURES = ("n_chars", "n_words", "n_lines", "digit_share", "upper_share", "mean_word_len")
LINE_FEATURES = ("quantity", "price", "discount", "tax")
DOC_DOMAINS = ("en", "rest")
LINE_DOMAINS = ("F", "O")
CHANNELS = ("click", "error", "purchase", "signup", "view")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table that the query multiplies or scores row by row."""
    return read_table(spark, f"{sf}/{name}.parquet")


def r6(c):
    """Six decimals, the precision at which results of two engines are compared."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def registry():
    """A query dictionary and the function that fills it."""
    found: dict[str, Query] = {}

    def register(name: str, sql: str | None = None):
        def wrap(fn):
            found[name] = Query(fn, sql)
            return fn

        return wrap

    return found, register


# --- document features -------------------------------------------------------------------


def doc_stats(docs: DataFrame) -> DataFrame:
    """Text statistics of a document, all inside generated code."""
    text = F.col("text")
    words = F.size(F.split(F.trim(text), r"\s+"))
    size = F.greatest(F.length(text), F.lit(1))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        F.when(F.col("lang") == "en", "en").otherwise("rest").alias("domain"),
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"),
        (F.regexp_count(text, F.lit("\n")) + 1).cast("double").alias("n_lines"),
        (F.regexp_count(text, F.lit("[0-9]")) / size).alias("digit_share"),
        (F.regexp_count(text, F.lit("[A-Z]")) / size).alias("upper_share"),
        (F.length(text) / words).alias("mean_word_len"),
    )


def doc_features(spark, sf) -> DataFrame:
    """Labelled documents with their features; domain is ``en`` or ``rest``."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return doc_stats(dealt_table(spark, sf, "documents")).join(labels, "doc_id")


def doc_long(spark, sf) -> DataFrame:
    wide = doc_features(spark, sf)
    return wide.unpivot(
        ["doc_id", "lang", "source", "domain", "label"], list(DOC_FEATURES), "feature", "value"
    )


DOC_SQL = r"""
doc AS (
  SELECT d.doc_id, d.lang, d.source, CASE WHEN d.lang = 'en' THEN 'en' ELSE 'rest' END AS domain,
         l.quality AS label,
         d.n_chars::DOUBLE AS n_chars,
         len(regexp_split_to_array(trim(d.text, ' '), '\s+'))::DOUBLE AS n_words,
         (len(d.text) - len(replace(d.text, chr(10), '')) + 1)::DOUBLE AS n_lines,
         (len(d.text) - len(regexp_replace(d.text, '[0-9]', '', 'g')))::DOUBLE
           / greatest(len(d.text), 1) AS digit_share,
         (len(d.text) - len(regexp_replace(d.text, '[A-Z]', '', 'g')))::DOUBLE
           / greatest(len(d.text), 1) AS upper_share,
         len(d.text)::DOUBLE / len(regexp_split_to_array(trim(d.text, ' '), '\s+')) AS mean_word_len
  FROM documents d JOIN labels l USING (doc_id)),
doc_long AS (
  SELECT doc_id, lang, source, domain, label, feature, value FROM doc
  UNPIVOT (value FOR feature IN
    (n_chars, n_words, n_lines, digit_share, upper_share, mean_word_len)))"""


# --- order lines -------------------------------------------------------------------------


def line_features(spark, sf, more=()) -> DataFrame:
    """Order lines; domain is the line status, group the supplier, label a return."""
    return dealt_table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_id"),
        F.col("l_linestatus").alias("domain"),
        F.col("l_suppkey").alias("grp"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        *more,
    )


def line_long(spark, sf) -> DataFrame:
    return line_features(spark, sf).unpivot(
        ["row_id", "domain", "grp", "label"], list(LINE_FEATURES), "feature", "value"
    )


LINE_SQL = """
line AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS row_id, l_linestatus AS domain,
         l_suppkey AS grp, (l_returnflag = 'R')::INT AS label, l_quantity AS quantity,
         l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem),
line_long AS (
  SELECT row_id, domain, grp, label, feature, value FROM line
  UNPIVOT (value FOR feature IN (quantity, price, discount, tax)))"""


# --- series ------------------------------------------------------------------------------


def event_series(spark, sf) -> DataFrame:
    """Events as series: one per user, one channel per event type."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("series"),
        F.col("event_type").alias("channel"),
        "ts",
        "event_id",
        "value",
    )


EVENT_SQL = """
ev AS (SELECT user_id AS series, event_type AS channel, ts, event_id, value FROM events)"""


def vector_series(spark, sf) -> DataFrame:
    """Embeddings as series of 64 steps."""
    return dealt_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("series"),
        F.col("label").alias("cls"),
        F.posexplode("embedding").alias("seq", "v"),
    ).select("series", "cls", "seq", F.col("v").cast("double").alias("value"))


VEC_SQL = """
vec AS (
  SELECT vec_id AS series, label AS cls, (i - 1)::INT AS seq, embedding[i]::DOUBLE AS value
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i
        FROM embeddings))"""


def vector_long(spark, sf) -> DataFrame:
    """Embedding coordinates as features ``e00`` … ``e63`` in long form."""
    s = vector_series(spark, sf)
    return s.select(
        F.col("series").alias("row_id"),
        F.pmod("series", F.lit(2)).cast("string").alias("domain"),
        F.pmod("series", F.lit(50)).alias("grp"),
        (F.col("cls") >= 5).cast("int").alias("label"),
        F.concat(F.lit("e"), F.lpad(F.col("seq").cast("string"), 2, "0")).alias("feature"),
        "value",
    )


VLONG_SQL = VEC_SQL + """,
vlong AS (
  SELECT series AS row_id, (series % 2)::VARCHAR AS domain, series % 50 AS grp,
         (cls >= 5)::INT AS label, 'e' || lpad(seq::VARCHAR, 2, '0') AS feature, value
  FROM vec)"""


# --- SQL building blocks -------------------------------------------------------------------


def sql_auc(source: str, keys: str, score: str = "score", label: str = "label") -> str:
    """AUC by average ranks, written for one SELECT."""
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    tie = f"PARTITION BY {keys}, {score}" if keys else f"PARTITION BY {score}"
    return f"""
  SELECT {head}sum({label})::BIGINT AS n_pos, (count(*) - sum({label}))::BIGINT AS n_neg,
         CASE WHEN sum({label}) > 0 AND sum({label}) < count(*) THEN
           (sum(CASE WHEN {label} = 1 THEN r ELSE 0 END) - sum({label}) * (sum({label}) + 1) / 2.0)
           / (sum({label})::DOUBLE * (count(*) - sum({label}))) END AS auc
  FROM (SELECT *, rank() OVER ({part} ORDER BY {score})
                  + (count(*) OVER ({tie}) - 1) / 2.0 AS r
        FROM {source} WHERE {score} IS NOT NULL AND {label} IS NOT NULL) {group}"""


def sql_p(z: str) -> str:
    """Two-sided normal p by the same polynomial."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    return (
        f"(({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * "
        f"(-1.453152027 + {t} * 1.061405429))))) * exp(-({x} * {x})))"
    )


def sql_hash(seed, *cols: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(cols) + "))"


def sql_class_scores(source: str, keys: str) -> str:
    """Class sizes, means, U, raw AUC and p per key."""
    return f"""
  SELECT *, CASE WHEN sd > 0 THEN least({sql_p('(greatest(abs(u - pn / 2) - 0.5, 0) / sd)')}, 1.0) END
            AS p_value,
         CASE WHEN pn > 0 THEN u / pn END AS raw_auc,
         CASE WHEN pos_mean > neg_mean THEN 'pos>neg' ELSE 'pos<neg' END AS direction
  FROM (
    SELECT *, p * n AS pn, r_sum - p * (p + 1) / 2 AS u,
           sqrt(p * n / 12 * ((p + n + 1) - ties / ((p + n) * (p + n - 1)))) AS sd
    FROM (
      SELECT {keys}, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS n,
             avg(CASE WHEN label = 1 THEN value END) AS pos_mean,
             avg(CASE WHEN label = 0 THEN value END) AS neg_mean,
             stddev_samp(CASE WHEN label = 1 THEN value END) AS pos_sd,
             stddev_samp(CASE WHEN label = 0 THEN value END) AS neg_sd,
             sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS r_sum,
             sum(t * t - 1)::DOUBLE AS ties
      FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value)
                      + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS r,
                   count(*) OVER (PARTITION BY {keys}, value) AS t
            FROM {source} WHERE value IS NOT NULL AND label IS NOT NULL)
      GROUP BY {keys}))"""


def sql_ranked(source: str = "doc_long") -> str:
    """Signed AUC and rank per domain."""
    return f"""
scored AS ({sql_class_scores(source, 'domain, feature')}),
ranked AS (
  SELECT domain, feature, p::BIGINT AS n_pos, n::BIGINT AS n_neg, pos_mean, neg_mean, p_value,
         direction, auc,
         row_number() OVER (PARTITION BY domain ORDER BY auc DESC, feature)::INT AS rank
  FROM (SELECT *, CASE WHEN direction = 'pos>neg' THEN raw_auc ELSE 1 - raw_auc END AS auc
        FROM scored WHERE p >= 5 AND n >= 5))"""
