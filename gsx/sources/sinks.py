"""Writers of step outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, by=()) -> str:
    """Parquet, optionally partitioned by low-cardinality columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_csv(df: DataFrame, path: str, by=()) -> str:
    df.write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)
    return path
