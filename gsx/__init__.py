"""gsx: grouped-signal analytics and cross-domain evaluation on Spark DataFrames."""

from gsx.schema import FeatureSchema

__all__ = ["FeatureSchema"]
