"""Star-schema extraction: one fact, three inner-joined dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.dates import add_months, stamp


@dataclass(frozen=True)
class Star:
    """The four tables of the star and the columns they join on.

    ``product`` is versioned: only rows whose ``current`` column equals ``current_value`` count. ``derived`` are
    measures computed from the fact's columns after the joins, so that they need not travel with its rows.
    """

    fact: DataFrame
    product: DataFrame
    location: DataFrame
    matrix: DataFrame
    product_key: tuple[str, str] = ("item_skey", "product_skey")
    location_key: tuple[str, str] = ("location_skey", "loc_skey")
    matrix_key: tuple[str, str] = ("matrix_skey", "mdp_key")
    current: str = "current"
    current_value: str = "True"
    date: str = "sales_date"
    derived: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Selection:
    """What to extract: a month window round ``as_of`` and one filter per hierarchy."""

    as_of: str
    past_months: int = 6
    next_months: int = 6
    location: Mapping[str, Sequence[str]] = field(default_factory=dict)
    product: Mapping[str, Sequence[str]] = field(default_factory=dict)


def month_window(date: Column, as_of, past: int, ahead: int) -> Column:
    """Between ``past`` months before and ``ahead`` months after the reference day."""
    now = stamp(as_of)
    return date.between(add_months(now, -past), add_months(now, ahead))


def star_join(star: Star, selection: Selection) -> DataFrame:
    """Filter each table on its own columns, then join: the filters reach the scans."""
    fact = star.fact.filter(month_window(
        F.col(star.date), selection.as_of, selection.past_months, selection.next_months))
    product = star.product.filter(F.col(star.current) == star.current_value).drop(star.current)
    for level, values in selection.product.items():
        product = product.filter(F.col(level).isin(list(values)))
    location = star.location
    for level, values in selection.location.items():
        location = location.filter(F.col(level).isin(list(values)))
    matrix = star.matrix.select(star.matrix_key[1])
    joined = (
        fact.join(product, F.col(star.product_key[0]) == F.col(star.product_key[1]))
        .join(location, F.col(star.location_key[0]) == F.col(star.location_key[1]))
        .join(matrix, F.col(star.matrix_key[0]) == F.col(star.matrix_key[1]))
    )
    return joined.withColumns(dict(star.derived)) if star.derived else joined


def star_extract(
    star: Star, selection: Selection, keys: Sequence[str], measures: Sequence[str],
) -> DataFrame:
    """Sum of the measures by the keys over the selected part of the star."""
    return star_join(star, selection).groupBy(*keys).agg(
        *[F.sum(F.col(m).cast("decimal(18,4)")).cast("double").alias(m) for m in measures])


def extract_count(star: Star, selection: Selection, keys: Sequence[str]) -> DataFrame:
    """Number of rows ``star_extract`` would return, without building its measures."""
    return star_join(star, selection).select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_rows"))
