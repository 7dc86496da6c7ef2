"""From history to merged forecasts: label, model, average, attach levels, merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.dates import add_months, month_start, stamp
from tallyline.functions.text import key_split
from tallyline.lineage import cut
from tallyline.operators import backtest as validation
from tallyline.operators.arima import arima
from tallyline.operators.clusters import shape_clusters
from tallyline.operators.combine import (
    full_merge,
    hierarchy_left_join,
    keep_series,
    union_diagonal,
    without_series,
)
from tallyline.operators.forecast import (
    cluster_models,
    ensemble_mean,
    exp_smoothing,
    join_models,
    lag_regression,
    linear_trend,
    model_input,
    seasonal_naive,
)
from tallyline.operators.prefix_backtest import backtest_prefix
from tallyline.operators.windows import label_fill

MODELS = ("lag_regression", "arima", "exp_smoothing", "linear_trend", "seasonal_naive")


def forecast_enrich(
    forecasts: DataFrame,
    products: DataFrame,
    locations: DataFrame,
    group_region: str | None = None,
    date: str = "ds",
) -> DataFrame:
    """Split the series id, attach both hierarchies, and keep one group region when asked."""
    keyed = forecasts.withColumnRenamed(date, "sales_date").select(
        "*", *key_split("unique_id", ["country", "catalog_number"]))
    rich = hierarchy_left_join(keyed, products, locations)
    return rich if group_region is None else rich.filter(F.col("group_region") == group_region)


def forecast_merge(
    history: DataFrame,
    forecasts: DataFrame,
    models: Sequence[str],
    keep_unforecast: bool = False,
) -> DataFrame:
    """History and forecasts in one table.

    Older model columns of the history go. Both sides meet on every level they share, the series id
    and the month. The history keeps its label; rows that only the forecast has take the forecast's,
    and gaps are filled within the series. With ``keep_unforecast`` series without a forecast stay too.
    """
    plain = history.drop(*models)
    # Written once: it selects the series of the history and is merged with them.
    forecasts = cut(forecasts)
    keys = [c for c in plain.columns if c in forecasts.columns and c != "cluster"]
    if "cluster" in forecasts.columns:
        forecasts = forecasts.withColumnRenamed("cluster", "_forecast_cluster")
    merged = full_merge(keep_series(plain, forecasts), forecasts, keys)
    if "_forecast_cluster" in merged.columns:
        own = F.col("cluster") if "cluster" in merged.columns else F.lit(None).cast("string")
        merged = merged.withColumn("cluster", F.coalesce(own, F.col("_forecast_cluster"))).drop("_forecast_cluster")
    if keep_unforecast:
        merged = union_diagonal(merged, without_series(plain, forecasts))
    return label_fill(merged, "cluster", "unique_id", "sales_date") if "cluster" in merged.columns else merged


def ensemble_forecasts(series: DataFrame, horizon: int = 60) -> DataFrame:
    """All models and their mean, per cluster where a label exists.

    Models that look at one series at a time run once over all series; only the pooled regression
    is fitted per cluster.
    """
    series = cut(series)
    plain = series.drop("cluster")
    labelled = "cluster" in series.columns
    pooled = (cluster_models(series, horizon) if labelled
              else lag_regression(plain, horizon))
    single = join_models(
        arima(plain, horizon), exp_smoothing(plain, horizon), linear_trend(plain, horizon), seasonal_naive(plain, horizon))
    joined = pooled.join(single, ["unique_id", "ds"], "left" if labelled else "full")
    return ensemble_mean(joined, MODELS)


def run_cycle(
    history: DataFrame,
    products: DataFrame,
    locations: DataFrame,
    as_of,
    measure: str = "act_orders_rev",
    horizon: int = 60,
    validate: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Merged history and forecasts, and the back-test of each model (unless left out).

    ``history`` has ``unique_id``, ``country``, ``catalog_number``, ``sales_date`` and the measure.
    """
    if "cluster" not in history.columns:
        renamed = history.withColumnsRenamed({"sales_date": "ds", measure: "y"})
        history = shape_clusters(renamed, as_of).withColumnsRenamed({"ds": "sales_date", "y": measure})
    history = cut(history)
    # Written once: every model and every back-test reads it.
    series = cut(model_input(history, as_of, measure))
    forecasts = forecast_enrich(ensemble_forecasts(series, horizon), products, locations)
    scores = []
    if validate:
        plain = series.drop("cluster")
        tested = {
            "seasonal_naive": validation.backtest(plain, seasonal_naive, as_of, "seasonal_naive"),
            "linear_trend": validation.backtest(plain, linear_trend, as_of, "linear_trend"),
            "arima": validation.backtest(plain, arima, as_of, "arima"),
            "lag_regression": backtest_prefix(plain, as_of)[0],
        }
        scores = [validation.error_metrics(table, "actual", "forecast").withColumn("model", F.lit(name))
                  for name, table in tested.items()]
    merged = forecast_merge(history, forecasts, [*MODELS, "ensemble"])
    return merged, reduce(lambda a, b: a.unionByName(b), scores) if scores else None


def forecast_vs_published(
    df: DataFrame,
    as_of,
    actual: str,
    published: Sequence[tuple[str, str]],
    date: str = "sales_date",
    months: int = 12,
) -> DataFrame:
    """Published forecasts of the next months beside the actuals of every year, by calendar month.

    ``published`` lists (column, series name). ``marker`` is the month two months ahead, the one the
    forecast of today is measured on.
    """
    first = month_start(stamp(as_of))
    d = F.col(date)
    ahead = df.filter((d >= first) & (d < add_months(first, months)))
    parts = [
        ahead.groupBy(F.month(d).alias("month")).agg(F.round(F.sum(c), 4).alias("value")).select(
            F.lit(n).alias("name"), F.lit("line").alias("kind"), "month", "value")
        for c, n in published
    ]
    parts.append(
        df.groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(F.round(F.sum(actual), 4).alias("value"))
        .select(F.col("year").cast("string").alias("name"), F.lit("bar").alias("kind"), "month", "value"))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("marker", add_months(first, 2))
