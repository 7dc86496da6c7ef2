"""Window operators on long series.

A series has one row per month, so a window over a series is bounded by the calendar, however
many source rows one series collects: they are summed, with map-side combining, before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.dates import month_index
from tallyline.functions.numeric import finite_or_zero, safe_div


def series_order(key: str = "unique_id", date: str = "ds"):
    return Window.partitionBy(key).orderBy(date)


def series_all(key: str = "unique_id"):
    return Window.partitionBy(key)


def lagged(value: str, k: int, key: str = "unique_id", date: str = "ds", by: str = "row") -> Column:
    """Value k rows earlier, or k calendar months earlier with ``by='month'``.

    Months are found without completing the calendar first: a range frame of exactly one month.
    """
    if by == "row":
        return F.lag(value, k).over(series_order(key, date))
    if by != "month":
        raise ValueError(f"unknown lag unit: {by}")
    frame = Window.partitionBy(key).orderBy(month_index(date)).rangeBetween(-k, -k)
    return F.max(value).over(frame)


def lag_set(
    df: DataFrame,
    lags: Sequence[int] = (3, 4, 5, 6, 12),
    fallback: bool = True,
    value: str = "y",
    key: str = "unique_id",
    date: str = "ds",
    by: str = "row",
) -> DataFrame:
    """Columns ``lag<k>``; with ``fallback`` a missing lag takes the current value."""
    def column(k: int) -> Column:
        lag = lagged(value, k, key, date, by)
        return F.coalesce(lag, F.col(value)) if fallback else lag

    return df.withColumns({f"lag{k}": column(k) for k in lags})


def zscore(df: DataFrame, value: str = "y", key: str = "unique_id", name: str = "ynorm") -> DataFrame:
    """(y - mean) / sample std per series; undefined becomes 0."""
    w = series_all(key)
    score = safe_div(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.withColumn(name, finite_or_zero(score))


def iqr_cap(
    df: DataFrame, value: str = "y", key: str = "unique_id", interpolation: str = "nearest", factor: float = 1.5,
) -> DataFrame:
    """Cap each series at its quartiles -/+ 1.5 interquartile ranges.

    ``nearest`` takes the quartile at the rounded rank (n - 1) q, ``linear`` interpolates.
    """
    w = series_all(key)
    if interpolation == "nearest":
        n = F.count(value).over(w)
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).asc_nulls_last())) - 1
        df = df.withColumns({"_n": n, "_rank": rank})
        quartile = {
            q: F.max(F.when(F.col("_rank") == F.floor((F.col("_n") - 1) * q + 0.5), F.col(value))).over(w)
            for q in (0.25, 0.75)
        }
    elif interpolation == "linear":
        quartile = {q: F.percentile(value, q).over(w) for q in (0.25, 0.75)}
    else:
        raise ValueError(f"unknown interpolation: {interpolation}")
    df = df.withColumns({"_q1": quartile[0.25], "_q3": quartile[0.75]})
    spread = (F.col("_q3") - F.col("_q1")) * factor
    low, high = F.col("_q1") - spread, F.col("_q3") + spread
    y = F.col(value)
    capped = F.when(y < low, low).when(y > high, high).otherwise(y)
    return df.withColumn(value, capped).drop("_n", "_rank", "_q1", "_q3")


def label_fill(df: DataFrame, label: str = "cluster", key: str = "unique_id", date: str = "ds") -> DataFrame:
    """Fill a label forward, then backward, within its series."""
    order = series_order(key, date)
    forward = F.last(label, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(label, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(label, F.coalesce(forward, backward))


def partition_count(df: DataFrame, value: str = "y", key: str = "unique_id", name: str = "num") -> DataFrame:
    return df.withColumn(name, F.count(value).over(series_all(key)))


def month_presence(df: DataFrame, value: str = "y", key: str = "unique_id", date: str = "ds") -> DataFrame:
    """``mc``: values in the same calendar month where y > 0, else 0; ``mcmax``: its maximum."""
    same_month = Window.partitionBy(key, F.month(date))
    count = F.when(F.col(value) > 0, F.count(value).over(same_month)).otherwise(F.lit(0))
    return df.withColumn("mc", count).withColumn("mcmax", F.max("mc").over(series_all(key)))


def rolling(
    df: DataFrame, size: int, minimum: int, value: str = "y", key: str = "unique_id", date: str = "ds",
    prefix: str = "rolling",
) -> DataFrame:
    """Rolling mean, sample std and their ratio over ``size`` rows, from ``minimum`` values on."""
    frame = series_order(key, date).rowsBetween(1 - size, 0)
    enough = F.count(value).over(frame) >= minimum
    return df.withColumns({
        f"{prefix}_mean": F.when(enough, F.avg(value).over(frame)),
        f"{prefix}_std": F.when(enough, F.stddev_samp(value).over(frame)),
    }).withColumn(f"{prefix}_cv", safe_div(f"{prefix}_std", f"{prefix}_mean"))


def rolling_change(df: DataFrame, size: int = 6, value: str = "y", key: str = "unique_id", date: str = "ds") -> DataFrame:
    """Absolute change of the full rolling mean and std from row to row."""
    order = series_order(key, date)
    rolled = rolling(df, size, size, value, key, date)
    return rolled.withColumns({
        f"{s}_change": F.abs(F.col(f"rolling_{s}") - F.lag(f"rolling_{s}").over(order)) for s in ("mean", "std")
    }).drop("rolling_cv")


def first_difference(df: DataFrame, value: str = "y", key: str = "unique_id", date: str = "ds") -> DataFrame:
    return df.withColumn("ydiff", F.col(value) - F.lag(value).over(series_order(key, date)))


def rolling_mean(df: DataFrame, size: int = 3, value: str = "y", key: str = "unique_id", date: str = "ds") -> DataFrame:
    frame = series_order(key, date).rowsBetween(1 - size, 0)
    full = F.count(value).over(frame) == size
    return df.withColumn("ymean", F.when(full, F.avg(value).over(frame)))


def position_index(df: DataFrame, key: str = "unique_id", date: str = "ds") -> DataFrame:
    """0-based position, length, half, third and first/last six of each row in its series."""
    n = F.col("n")
    third = F.floor(n / 3)
    return (
        df.withColumns({
            "pos": F.row_number().over(series_order(key, date)) - 1,
            "n": F.count(F.lit(1)).over(series_all(key)),
        })
        .withColumns({
            "half": F.when(F.col("pos") < F.floor(n / 2), 1).otherwise(2),
            "third": F.when(F.col("pos") < third, 1).when(F.col("pos") < 2 * third, 2).otherwise(3),
            "first_six": F.col("pos") < 6,
            "last_six": F.col("pos") >= n - 6,
        })
    )
