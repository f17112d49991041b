"""Column roles of a feature table and the missing-value rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSchema:
    """Which columns identify a row, its label, group and domain, and the features."""

    row_id: str
    label: str
    group: str
    domain: str
    features: tuple[str, ...]
    meta: tuple[str, ...] = field(default=())

    @classmethod
    def infer(cls, df: DataFrame, row_id, label, group, domain, meta=()) -> "FeatureSchema":
        """Features are the numeric columns whose name is not a meta name."""
        taken = {row_id, label, group, domain, *meta}
        return cls(row_id, label, group, domain, tuple(numeric_columns(df, taken)), tuple(meta))

    def check(self, df: DataFrame) -> DataFrame:
        """Raise when a required column is absent."""
        need = [self.row_id, self.label, self.group, self.domain, *self.features]
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        return df


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns outside ``exclude``, in schema order; no job runs."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so NULL alone means missing."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[null_if_nan(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def to_long(df: DataFrame, ids, features) -> DataFrame:
    """Wide to long: one row per (ids, feature) with a double value."""
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(list(ids), list(features), "feature", "value")
