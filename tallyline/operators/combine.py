"""Joins and unions of histories, forecasts, hierarchies and labels.

No join is hinted. A hierarchy or label table is small next to the history in most uses, and
then Catalyst or adaptive execution broadcasts it after checking its size; otherwise the join
is a sort-merge join on the series or level key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, LongType, NumericType, StringType


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the smallest of its duplicates, so that a join does not multiply rows."""
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    return (
        df.groupBy(key)
        .agg(F.min(F.struct(*others)).alias("kept"))
        .select(key, *[F.col("kept")[c].alias(c) for c in others])
        .select(*df.columns)
    )


def hierarchy_left_join(
    df: DataFrame,
    products: DataFrame | None = None,
    locations: DataFrame | None = None,
    product_key: str = "catalog_number",
    location_key: str = "country",
) -> DataFrame:
    """Attach hierarchy levels; rows without a hierarchy entry stay."""
    if products is not None:
        df = df.join(unique_by(products, product_key), product_key, "left")
    if locations is not None:
        df = df.join(unique_by(locations.drop("selling_division"), location_key), location_key, "left")
    return df


def label_join(
    df: DataFrame, labels: DataFrame, key: str = "unique_id", label: str = "cluster", how: str = "left",
) -> DataFrame:
    """Label per series onto its history; ``inner`` drops series without a label."""
    return df.drop(label).join(labels.select(key, label), key, how)


def full_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with coalesced keys; NULL keys do not match."""
    return left.join(right, list(keys), "full")


def keep_series(df: DataFrame, series: DataFrame, key: str = "unique_id") -> DataFrame:
    """Rows of the series that occur in another table."""
    return df.join(series.select(key), key, "left_semi")


def without_series(df: DataFrame, series: DataFrame, key: str = "unique_id") -> DataFrame:
    """Rows of the series that do not occur in another table."""
    return df.join(series.select(key), key, "left_anti")


def union_strict(*tables: DataFrame) -> DataFrame:
    """All rows of tables with the same columns."""
    names = set(tables[0].columns)
    for t in tables[1:]:
        if set(t.columns) != names:
            raise ValueError("tables differ in columns; use union_diagonal")
    return reduce(lambda a, b: a.unionByName(b), tables)


def _wider(a: DataType, b: DataType) -> DataType:
    if a == b:
        return a
    if isinstance(a, NumericType) and isinstance(b, NumericType):
        if isinstance(a, IntegralType) and isinstance(b, IntegralType):
            return LongType()
        if isinstance(a, FloatType) and isinstance(b, FloatType):
            return FloatType()
        return DoubleType()
    return StringType()


def union_diagonal(*tables: DataFrame) -> DataFrame:
    """All rows by column name: missing columns become NULL, types are widened."""
    types: dict[str, DataType] = {}
    for t in tables:
        for f in t.schema.fields:
            types[f.name] = _wider(types[f.name], f.dataType) if f.name in types else f.dataType
    cast = [
        t.select(*[F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) for f in t.schema.fields])
        for t in tables
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def union_distinct(*tables: DataFrame) -> DataFrame:
    return union_strict(*tables).distinct()
