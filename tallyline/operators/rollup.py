"""Aggregations over sales history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyline.functions.dates import month_name
from tallyline.functions.numeric import safe_corr, safe_div
from tallyline.functions.text import null_text
from tallyline.lineage import cut
from tallyline.operators.quantiles import weighted_quantiles, with_buckets

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def numeric_measures(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def total(c: Column | str, digits: int | None = 4) -> Column:
    """Sum with 0 for no values; rounded to four digits so row order cannot show."""
    summed = F.coalesce(F.sum(c), F.lit(0.0))
    return summed if digits is None else F.round(summed, digits)


def level_rollup(
    df: DataFrame,
    product: str | None,
    location: str | None,
    level: str | None = None,
    date: str = "sales_date",
) -> DataFrame:
    """Sum every numeric measure by date, product level and location level.

    ``level`` wins over ``product``; a missing location falls back to ``region``.
    """
    keys = [date, *[k for k in (level or product, location or "region") if k]]
    for k in keys:
        if k not in df.columns:
            raise ValueError(f"no such level: {k}")
    return df.groupBy(*keys).agg(*[total(m).alias(m) for m in numeric_measures(df, keys)])


def default_rollup(df: DataFrame) -> DataFrame:
    return level_rollup(df, "business_unit", "region")


def catalog_month_rollup(df: DataFrame, key: str = "catalog_number", date: str = "sales_date") -> DataFrame:
    """Sum by product and date. Sort at the sink: a sorted intermediate result would be reshuffled."""
    return df.groupBy(key, date).agg(*[total(m).alias(m) for m in numeric_measures(df, (key, date))])


def year_month_totals(
    df: DataFrame, actual: str, forecast: str | None = None, date: str = "sales_date",
) -> DataFrame:
    """Actual and forecast by year and month; the forecast is NULL where there is none."""
    d = F.col(date)
    value = F.round(F.sum(forecast), 4) if forecast in df.columns else F.lit(None).cast("double")
    return (
        df.groupBy(F.year(d).alias("year"), F.month(d).alias("month_number"))
        .agg(total(actual).alias("actual"), value.alias("forecast"), F.max(month_name(d)).alias("month"))
        .select("year", "month_number", "month", "actual", "forecast")
    )


def date_line(
    df: DataFrame, actual: str, forecast: str | None = None, date: str = "sales_date",
) -> DataFrame:
    value = F.round(F.sum(forecast), 4) if forecast in df.columns else F.lit(None).cast("double")
    return df.groupBy(date).agg(total(actual).alias("actual"), value.alias("forecast"))


def month_name_line(
    df: DataFrame, actual: str, forecast: str | None = None, date: str = "sales_date",
) -> DataFrame:
    """Totals by calendar month across years; ``month_number`` gives the calendar order."""
    d = F.col(date)
    value = F.round(F.sum(forecast), 4) if forecast in df.columns else F.lit(None).cast("double")
    return (
        df.groupBy(F.month(d).alias("month_number"))
        .agg(F.max(month_name(d)).alias("month"), total(actual).alias("actual"), value.alias("forecast"))
    )


def year_by_month(df: DataFrame, measure: str, date: str = "sales_date") -> DataFrame:
    """One row per year with twelve month columns ``m01``..``m12``, NULL where a month is missing."""
    d = F.col(date)
    return df.groupBy(F.year(d).alias("year")).agg(*[
        F.round(F.sum(F.when(F.month(d) == m, F.col(measure))), 4).alias(f"m{m:02d}") for m in range(1, 13)
    ])


def date_columns(df: DataFrame, date: str) -> list[str]:
    """The distinct dates of a table in order, as text, for use as pivot columns.

    They come to the driver because they become column names: one per day of the calendar at most.
    """
    found = [r[0] for r in df.select(date).distinct().collect()]
    return sorted(d for d in found if d is not None)


def date_pivot(
    df: DataFrame,
    location: str | None,
    measure: str,
    level: str | None = None,
    date: str = "sales_date",
    dates: Sequence[str] | None = None,
) -> DataFrame:
    """Rows by location (and level), one column per day in date order, named yyyy-mm-dd.

    Days are compared as text, so no literal depends on the time zone of the session. Unless the
    days are given, the roll-up is written once: the source is not scanned again to find them.
    """
    rows = [location or "region", *([level] if level else [])]
    day = F.col(date).cast("date").cast("string").alias("_day")
    rolled = df.groupBy(*rows, day).agg(F.round(F.sum(measure), 4).alias("_sum"))
    if dates is None:
        rolled = cut(rolled)
        dates = date_columns(rolled, "_day")
    return rolled.groupBy(*rows).pivot("_day", list(dates)).agg(F.first("_sum"))


def seasonality_metrics(df: DataFrame, key: str = "unique_id", value: str = "y") -> DataFrame:
    """Mean, spread, range and coefficient of variation per series."""
    y = F.col(value)
    return (
        df.groupBy(key)
        .agg(F.avg(y).alias("mean_sales"), F.stddev_samp(y).alias("std_sales"),
             F.min(y).alias("min_sales"), F.max(y).alias("max_sales"), F.count(y).alias("n_months"))
        .withColumn("cv", safe_div("std_sales", "mean_sales"))
        .withColumn("range_ratio", safe_div("max_sales", "min_sales"))
        .withColumn("relative_range", safe_div(F.col("max_sales") - F.col("min_sales"), "mean_sales"))
    )


def month_means(df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y") -> DataFrame:
    return df.groupBy(key, F.month(date).alias("month_number")).agg(F.avg(value).alias("month_mean"))


def monthly_cv(df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y") -> DataFrame:
    """Coefficient of variation of the calendar-month means, which leaves growth over years out."""
    return (
        month_means(df, key, date, value).groupBy(key)
        .agg(F.avg("month_mean").alias("overall_monthly_mean"), F.stddev_samp("month_mean").alias("monthly_std"))
        .withColumn("monthly_cv", safe_div("monthly_std", "overall_monthly_mean"))
    )


def seasonal_variance_ratio(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y",
) -> DataFrame:
    return (
        month_means(df, key, date, value).groupBy(key)
        .agg(F.var_samp("month_mean").alias("seasonal_var"), F.avg("month_mean").alias("overall_mean"))
        .withColumn("seasonal_strength",
                    safe_div("seasonal_var", F.col("overall_mean") * F.col("overall_mean")))
    )


def table_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, NULL count, mean, std, min, quartiles and max, one row per column.

    The table is read once, as (column, value) pairs that are counted and written; everything else
    comes from the counts. Deviations are taken from the mean, so the spread does not cancel.
    """
    pairs = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    counted = cut(pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("weight")))
    counts = with_buckets(counted.filter(F.col("value").isNotNull()))
    v, n = F.col("value"), F.col("weight")
    known = F.when(v.isNotNull(), n)
    sums = counted.groupBy("column").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("null_count"),
        safe_div(F.sum(v * n), F.sum(known)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    squares = counted.join(sums.select("column", F.col("mean").alias("_m")), "column").groupBy("column").agg(
        F.sum((v - F.col("_m")) * (v - F.col("_m")) * n).alias("_s"))
    moments = sums.join(squares, "column").withColumn(
        "std", F.sqrt(safe_div("_s", F.when(F.col("count") > 1, F.col("count") - 1))))
    quartiles = weighted_quantiles(counts, ["column"], QUARTILES)
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "null_count", "mean", "std", "min", *QUARTILES, "max")


def attribute_value_counts(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Every attribute with each of its values and the number of rows; NULL counts as 'null'."""
    pairs = df.select(*[null_text(a).alias(a) for a in attributes]).unpivot(
        [], list(attributes), "attribute", "value")
    return pairs.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def high_cardinality(df: DataFrame, attributes: Sequence[str], limit: int = 500) -> DataFrame:
    """Number of distinct values per attribute and whether it is small enough to be listed.

    The values are counted as rows of (attribute, value), not gathered in a set.
    """
    return (
        attribute_value_counts(df, attributes).groupBy("attribute")
        .agg(F.count(F.lit(1)).alias("n_values"))
        .withColumn("listed", F.col("n_values") <= limit)
    )


def relabel_year(year: Column, mapping: Mapping[int, int]) -> Column:
    """Treat one year as another, to fill a partial year."""
    for source, target in mapping.items():
        year = F.when(year == source, F.lit(target)).otherwise(year)
    return year


def year_correlation(
    df: DataFrame,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    relabel: Mapping[int, int] | None = None,
) -> DataFrame:
    """Per series and pair of years, the correlation of their monthly values.

    The self-join is on (series, calendar month), so a key meets at most one row per year.
    """
    year = relabel_year(F.year(date), relabel or {})
    monthly = df.groupBy(F.col(key), year.alias("year"), F.month(date).alias("month_number")).agg(
        F.round(F.sum(value), 4).alias("value"))
    a = monthly.select(key, "month_number", F.col("year").alias("year_a"), F.col("value").alias("a"))
    b = monthly.select(key, "month_number", F.col("year").alias("year_b"), F.col("value").alias("b"))
    return (
        a.join(b, [key, "month_number"]).filter(F.col("year_a") < F.col("year_b"))
        .groupBy(key, "year_a", "year_b")
        .agg(F.count(F.lit(1)).alias("n_months"), safe_corr("a", "b").alias("correlation"))
    )


def top_products(df: DataFrame, measure: str, n: int, key: str = "catalog_number") -> DataFrame:
    """The n products with the largest total; ties by key. Each task keeps n rows only."""
    return df.groupBy(key).agg(total(measure).alias("total")).orderBy(F.desc("total"), key).limit(n)


def eligible_products(
    df: DataFrame, measure: str, as_of, key: str = "catalog_number", date: str = "sales_date",
    months: int = 13, recent_above: float = 12.0, earlier_above: float = 0.0,
) -> DataFrame:
    """Products with enough recent volume that were active before; both windows in one pass."""
    from tallyline.functions.dates import add_months, stamp

    limit = add_months(stamp(as_of), -months)
    recent = F.col(date) > limit
    return (
        df.groupBy(key)
        .agg(total(F.when(recent, F.col(measure))).alias("recent_total"),
             total(F.when(~recent, F.col(measure))).alias("earlier_total"))
        .filter((F.col("recent_total") > recent_above) & (F.col("earlier_total") > earlier_above))
    )


def top_seasonal(metrics: DataFrame, n: int, key: str = "unique_id", by: str = "monthly_cv") -> DataFrame:
    return metrics.orderBy(F.desc(by), key).limit(n)
