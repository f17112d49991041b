"""Scans of recordings, feature files and experiment folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gsx.functions.names import parse_run
from gsx.schema import nan_to_null

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("analysis", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("auc", T.DoubleType()),
        T.StructField("mcc", T.DoubleType()),
    ]
)
CORRUPT = "_corrupt"
# Fixed value: where a run keeps its summary.
SUMMARY_FILES = "*/csv_results/analysis_summary.csv"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; one that arrives in fewer pieces than there are cores is dealt out.

    A large table has far more splits than cores and is read as it is.
    """
    df = nan_to_null(spark.read.parquet(path))
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def any_case(suffix: str) -> str:
    """Glob that matches a suffix in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def scan_files(spark: SparkSession, root: str, suffix: str = ".wav") -> DataFrame:
    """Path, size and content hash of every file below ``root`` with ``suffix`` in any case.

    The bytes are hashed inside the scan task and never leave it.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", any_case(suffix))
        .load(root)
        .select("path", F.col("length").alias("n_bytes"), F.md5("content").alias("file_md5"))
    )


def manifest(listing: DataFrame, path: str, content: str, suffixes) -> DataFrame:
    """The manifest from a listing table; suffixes match in any case."""
    low = F.lower(path)
    match = F.lit(False)
    for s in suffixes:
        match = match | low.endswith(s.lower())
    return listing.filter(match).select(
        *[c for c in listing.columns if c != content],
        F.octet_length(content).cast("bigint").alias("n_bytes"),
        F.md5(content).alias("file_md5"),
    )


def read_csv(spark, path: str, schema: T.StructType | str, keep_bad_rows: bool = False) -> DataFrame:
    """CSV with a header and a declared schema (S6); bad rows may be kept as text."""
    reader = spark.read.option("header", True)
    if keep_bad_rows:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return nan_to_null(reader.schema(schema).csv(path))


def run_of(path: Column) -> Column:
    """The run directory of ``…/<run>/<folder>/<file>``, written plainly or as ``run=<run>``."""
    return F.regexp_extract(path, r"/(?:run=)?([^/]+)/[^/]+/[^/]+$", 1)


def scan_runs(
    spark: SparkSession, root: str, schema=RESULT_SCHEMA, files: str = SUMMARY_FILES
) -> DataFrame:
    """Summary rows of every run below ``root`` with the run name."""
    table = read_csv(spark, f"{root}/{files}", schema, keep_bad_rows=True)
    return table.withColumn("run", run_of(F.col("_metadata.file_path")))


def with_run_parts(df: DataFrame, run: str = "run") -> DataFrame:
    """Kind, feature set and rate parsed from the run name."""
    return df.withColumns(parse_run(F.col(run)))


def load_log(expected: DataFrame, loaded: DataFrame, json_runs: DataFrame, run: str = "run") -> DataFrame:
    """Per expected run: summary and JSON found, rows read, and what went wrong.

    ``loaded`` may carry the text of rows that could not be parsed in ``CORRUPT``; those are
    counted apart.  ``json_runs`` names the runs that have a JSON file.
    """
    bad = F.col(CORRUPT).isNotNull() if CORRUPT in loaded.columns else F.lit(False)
    seen = loaded.groupBy(run).agg(
        F.count_if(~bad).alias("rows_loaded"), F.count_if(bad).alias("rows_bad")
    )
    with_json = json_runs.select(run).distinct().withColumn("json_found", F.lit(True))
    return expected.join(seen, run, "left").join(with_json, run, "left").select(
        run,
        F.col("rows_loaded").isNotNull().alias("found"),
        F.coalesce("json_found", F.lit(False)).alias("json_found"),
        F.coalesce("rows_loaded", F.lit(0)).alias("rows_loaded"),
        F.when(F.col("rows_loaded").isNull(), "no summary file")
        .when(F.col("rows_bad") > 0, F.concat(F.col("rows_bad").cast("string"), F.lit(" rows not parsed")))
        .when(F.col("rows_loaded") == 0, "empty summary file")
        .alias("error"),
    )


def promote_header(df: DataFrame, first_value: str, names, numeric=()) -> DataFrame:
    """Drop the row that repeats the real header and rename the columns."""
    first = df.columns[0]
    body = df.filter(~F.col(first).eqNullSafe(F.lit(first_value))).toDF(*names)
    return body.withColumns({c: F.col(c).try_cast("double") for c in numeric})
