"""Chart data as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.rollup import (
    date_line,
    monthly_cv,
    seasonality_metrics,
    top_seasonal,
    year_month_totals,
)

COLOUR_COUNT = 8


def column_chart_series(
    df: DataFrame, actual: str, forecast: str | None = None, date: str = "sales_date",
) -> DataFrame:
    """Twelve points per year and kind, with a series name and a colour index by year.

    A forecast series exists only for years with any forecast. The windows run over the yearly
    table: one row per year and month at most.
    """
    totals = year_month_totals(df, actual, forecast, date)
    years = totals.groupBy("year").agg(
        F.map_from_entries(F.collect_list(F.struct("month_number", F.struct("actual", "forecast")))).alias("m"),
        F.count("forecast").alias("n_forecast"))
    colour = (F.row_number().over(Window.orderBy("year")) - 1) % COLOUR_COUNT
    points = years.withColumn("colour", colour.cast("int")).select(
        "year", "colour", "n_forecast", "m", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_number"))
    value = F.try_element_at("m", F.col("month_number"))
    kinds = F.array(
        F.struct(F.lit("Actual").alias("kind"), value["actual"].alias("value")),
        F.struct(F.lit("Forecast").alias("kind"), value["forecast"].alias("value")))
    return (
        points.withColumn("point", F.explode(kinds))
        .filter((F.col("point.kind") == "Actual") | (F.col("n_forecast") > 0))
        .select(F.concat(F.col("year").cast("string"), F.lit(" - "), F.col("point.kind")).alias("name"),
                F.col("point.kind").alias("kind"), "month_number", F.col("point.value").alias("value"), "colour")
    )


def line_chart_series(
    df: DataFrame, actual: str, forecast: str | None = None, date: str = "sales_date",
) -> DataFrame:
    return date_line(df, actual, forecast, date)


def segment_scatter(features: DataFrame, segments: DataFrame, key: str = "unique_id") -> DataFrame:
    """One point per series with its segment."""
    return features.join(segments, key).select(
        key, "segment", F.col("mean_volume").alias("volume"), "cv",
        F.col("seasonality_strength").alias("seasonality"), F.col("growth_rate").alias("growth"))


def season_overlay(
    df: DataFrame, top_n: int = 12, key: str = "unique_id", date: str = "ds", value: str = "y",
) -> DataFrame:
    """Monthly values by year of the most seasonal series, with their coefficient of variation."""
    ranked = monthly_cv(df, key, date, value).select(key, F.round("monthly_cv", 6).alias("monthly_cv"))
    chosen = top_seasonal(ranked.filter(F.col("monthly_cv").isNotNull()), top_n, key).select(key)
    cv = seasonality_metrics(df, key, value).select(key, "cv")
    return (
        df.join(chosen, key, "left_semi").join(cv, key)
        .select(key, F.year(date).alias("year"), F.month(date).alias("month"), F.col(value).alias("sales"), "cv")
    )
