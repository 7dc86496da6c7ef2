"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyline.operators.features import ts_features
from tallyline.plans import (  # noqa: F401  (they register their queries)
    catalog_crosstab,
    catalog_forecast,
    catalog_segments,
    catalog_series,
    catalog_sources,
)
from tallyline.plans.registry import ORACLES, QUERIES
from tallyline.sources.tables import Tables, long_series

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return ts_features(long_series(Tables(spark, folder), ["franchise"]))
