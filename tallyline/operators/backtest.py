"""Error metrics and walk-forward validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.dates import add_months, last_full_month
from tallyline.functions.numeric import safe_div
from tallyline.lineage import cut


def error_metrics(
    df: DataFrame, actual: str, forecast: str, by: Sequence[str] = (),
) -> DataFrame:
    """MAE, MSE, RMSE and MAPE over rows that have both values; MAPE leaves zero actuals out."""
    error = F.col(actual) - F.col(forecast)
    pairs = df.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull())
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(safe_div(F.abs(error), F.abs(F.col(actual)))).alias("mape"),
    )


def cut_offs(as_of, origins: int, step: int, holdout: int) -> list[Column]:
    """Last training month of each origin; the newest leaves ``holdout`` full months to score."""
    return [add_months(last_full_month(as_of), -(holdout + i * step)) for i in range(origins)]


def backtest(
    df: DataFrame,
    forecaster: Callable[[DataFrame, int], DataFrame],
    as_of,
    model: str,
    holdout: int = 6,
    origins: int = 1,
    step: int = 6,
    pooled: bool = False,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
) -> DataFrame:
    """Actual and forecast of every held-out month, for rolling origins.

    A model that sees one series at a time gets all origins in one call, each (origin, series) pair
    being a series of its own. A pooled model would learn across origins, so it is fitted per origin.
    Series that end before the cut-off forecast from their own last month; only months in the
    hold-out are scored.
    """
    df = cut(df.select(key, date, value))
    cuts = cut_offs(as_of, origins, step, holdout)
    origin = F.array(*[F.struct(F.lit(i).alias("origin"), c.alias("cut")) for i, c in enumerate(cuts)])
    tagged = df.withColumn("_o", F.explode(origin)).select(
        F.concat(F.col("_o.origin").cast("string"), F.lit("#"), F.col(key)).alias("_id"),
        F.col("_o.origin").alias("origin"), F.col("_o.cut").alias("cut"), key, date, value)
    train = tagged.filter(F.col(date) <= F.col("cut"))
    test = tagged.filter((F.col(date) > F.col("cut")) & (F.col(date) <= add_months("cut", holdout)))

    def run(part: DataFrame) -> DataFrame:
        source = part.select(F.col("_id").alias(key), date, value)
        return forecaster(source, holdout).select(F.col(key).alias("_id"), date, model)

    if pooled:
        predicted = run(train.filter(F.col("origin") == 0))
        for i in range(1, origins):
            predicted = predicted.unionByName(run(train.filter(F.col("origin") == i)))
    else:
        predicted = run(train)
    return test.join(predicted, ["_id", date]).select(
        "origin", key, date, F.col(value).alias("actual"), F.col(model).alias("forecast"))
