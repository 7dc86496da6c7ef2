"""One row of features per series.

Each table is one window pass (position, lags, rolling statistics) and one grouped aggregate on
the same partitioning, so the series is shuffled once. No Python runs per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.dates import month_sequence, month_start
from tallyline.functions.numeric import safe_corr, safe_div, volume_band
from tallyline.operators.windows import rolling, series_all, series_order

SEASON = 12
MIN_LENGTH = 12


def _positioned(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.withColumns({
        "pos": F.row_number().over(series_order(key, date)) - 1,
        "n": F.count(F.lit(1)).over(series_all(key)),
    })


def _with_lags(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    order = series_order(key, date)
    return df.withColumns({f"lag{k}": F.lag(value, k).over(order) for k in (1, SEASON)})


def seasonal_strength(value: Column, pos: Column, n: Column) -> Column:
    """Variance of the phase means over the variance of the series, for two seasons or more.

    The twelve phase means are conditional averages of one aggregate; the table is not grouped
    by phase first.
    """
    means = F.array(*[F.avg(F.when(pos % SEASON == k, value)) for k in range(SEASON)])
    centre = F.aggregate(means, F.lit(0.0), lambda a, m: a + m) / SEASON
    spread = F.aggregate(means, F.lit(0.0), lambda a, m: a + (m - centre) * (m - centre)) / SEASON
    ratio = F.coalesce(safe_div(spread, F.var_pop(value)), F.lit(0.0))
    return F.when(F.max(n) >= 2 * SEASON, ratio).otherwise(F.lit(0.0))


def _recent_growth(value: Column, pos: Column, n: Column) -> Column:
    first, last = F.avg(F.when(pos < 6, value)), F.avg(F.when(pos >= n - 6, value))
    return F.coalesce(safe_div(last, first), F.lit(1.0))


def _ts_columns(value: str) -> dict[str, Column]:
    y, pos, n = F.col(value), F.col("pos"), F.col("n")
    return {
        "mean": F.avg(y),
        "std": F.stddev_pop(y),
        "cv": F.coalesce(safe_div(F.stddev_pop(y), F.avg(y)), F.lit(0.0)),
        "trend_slope": F.regr_slope(y, pos),
        "seasonal_strength": seasonal_strength(y, pos, n),
        "lag1_corr": safe_corr(y, F.col("lag1")),
        "lag12_corr": safe_corr(y, F.col(f"lag{SEASON}")),
        "volatility": F.stddev_pop(y - F.col("lag1")),
        "zero_prop": F.avg(F.when(y == 0, 1.0).otherwise(0.0)),
        "recent_growth": _recent_growth(y, pos, n),
    }


TS_FEATURES = (
    "mean", "std", "cv", "trend_slope", "seasonal_strength", "lag1_corr", "lag12_corr",
    "volatility", "zero_prop", "recent_growth",
)


def ts_features(
    df: DataFrame,
    features: tuple[str, ...] = TS_FEATURES,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """The chosen features of every series with at least ``min_length`` rows."""
    columns = _ts_columns(value)
    prepared = _with_lags(_positioned(df, key, date), key, date, value)
    return (
        prepared.filter(F.col("n") >= min_length)
        .groupBy(key).agg(*[columns[f].alias(f) for f in features])
    )


# --- SKU features -----------------------------------------------------------------------------

SKU_FEATURES = (
    "mean_volume", "cv", "trend_strength", "trend_direction", "seasonality_strength", "growth_rate",
    "volatility", "volume_category", "lifecycle_stage", "break_points", "series_length",
)


def _sku_aggregates(value: str) -> dict[str, Column]:
    y, pos, n = F.col(value), F.col("pos"), F.col("n")
    third = F.floor(n / 3)
    return {
        "mean_volume": F.avg(y),
        "std_volume": F.stddev_samp(y),
        "series_length": F.max(n),
        "slope": F.regr_slope(y, pos),
        "trend_strength": F.abs(safe_corr(y, pos)),
        "seasonal_r": F.abs(safe_corr(y, F.col(f"lag{SEASON}"))),
        "first_mean": F.avg(F.when(pos < 6, y)),
        "last_mean": F.avg(F.when(pos >= n - 6, y)),
        "volatility": F.avg("part_cv"),
        "third_1": F.avg(F.when(pos < third, y)),
        "third_2": F.avg(F.when((pos >= third) & (pos < 2 * third), y)),
        "third_3": F.avg(F.when(pos >= 2 * third, y)),
        # Bounded by the calendar: one value per month of one series.
        "mean_limit": F.percentile("mean_change", 0.8),
        "std_limit": F.percentile("std_change", 0.8),
        "changes": F.collect_list(F.when(pos >= 6, F.struct("mean_change", "std_change"))),
    }


def _lifecycle() -> Column:
    a, b, c = F.col("third_1"), F.col("third_2"), F.col("third_3")
    return (
        F.when((a < b) & (b < c), "growth")
        .when((a > b) & (b > c), "decline")
        .when((a < b) & (b > c), "maturity")
        .otherwise("stable")
    )


def _growth_rate() -> Column:
    ratio = safe_div("last_mean", "first_mean")
    base = F.when(ratio >= 0, ratio)  # a negative base has no real root
    return F.when(F.col("first_mean") > 0, F.pow(base, F.lit(12.0) / F.col("series_length")) - 1).otherwise(
        F.lit(0.0))


def _break_points() -> Column:
    hits = F.filter("changes", lambda c: (
        F.coalesce(c["mean_change"] > F.col("mean_limit"), F.lit(False))
        | F.coalesce(c["std_change"] > F.col("std_limit"), F.lit(False))))
    return F.size(hits)


def sku_features(
    df: DataFrame,
    features: tuple[str, ...] = SKU_FEATURES,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
) -> DataFrame:
    """Segmentation features of every series with at least twelve values.

    A coefficient of variation without a positive mean is infinite, and a correlation or root
    that is undefined is NULL.
    """
    order = series_order(key, date)
    observed = df.filter(F.col(value).isNotNull())
    staged = _positioned(observed, key, date).withColumns({
        f"lag{SEASON}": F.lag(value, SEASON).over(order)})
    staged = rolling(staged, 6, 3, value, key, date, prefix="part")
    full = F.col("pos") >= 5
    staged = staged.withColumns({
        "full_mean": F.when(full, F.col("part_mean")), "full_std": F.when(full, F.col("part_std"))})
    staged = staged.withColumns({
        f"{s}_change": F.abs(F.col(f"full_{s}") - F.lag(f"full_{s}").over(order)) for s in ("mean", "std")})
    grouped = staged.filter(F.col("n") >= MIN_LENGTH).groupBy(key).agg(
        *[c.alias(name) for name, c in _sku_aggregates(value).items()])
    columns = {
        "mean_volume": F.col("mean_volume"),
        "cv": F.when(F.col("mean_volume") > 0, safe_div("std_volume", "mean_volume")).otherwise(
            F.lit(float("inf"))),
        "trend_strength": F.col("trend_strength"),
        "trend_direction": F.signum("slope").cast("int"),
        "seasonality_strength": F.when(
            F.col("series_length") > 2 * SEASON, F.coalesce("seasonal_r", F.lit(0.0))).otherwise(F.lit(0.0)),
        "growth_rate": _growth_rate(),
        "volatility": F.col("volatility"),
        "volume_category": volume_band("mean_volume"),
        "lifecycle_stage": _lifecycle(),
        "break_points": _break_points(),
        "series_length": F.col("series_length"),
    }
    return grouped.select(key, *[columns[f].alias(f) for f in features])


# --- seasonality ------------------------------------------------------------------------------


def seasonal_metrics(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y",
) -> DataFrame:
    """Series metrics and the spread of the twelve calendar-month means.

    All come from one aggregate, so the series are shuffled once and nothing is joined.
    """
    y = F.col(value)
    means = F.array_compact(F.array(*[F.avg(F.when(F.month(date) == m, y)) for m in range(1, SEASON + 1)]))
    grouped = df.groupBy(key).agg(
        F.avg(y).alias("mean_sales"), F.stddev_samp(y).alias("std_sales"), F.min(y).alias("min_sales"),
        F.max(y).alias("max_sales"), F.count(y).alias("n_months"), means.alias("_means"))
    total = F.aggregate("_means", F.lit(0.0), lambda s, m: s + m)
    centre = F.col("overall_monthly_mean")
    spread = F.aggregate("_means", F.lit(0.0), lambda s, m: s + (m - centre) * (m - centre))
    return (
        grouped.withColumn("overall_monthly_mean", safe_div(total, F.size("_means")))
        .withColumn("monthly_std", F.sqrt(safe_div(spread, F.size("_means") - 1)))
        .withColumns({
            "cv": safe_div("std_sales", "mean_sales"),
            "range_ratio": safe_div("max_sales", "min_sales"),
            "relative_range": safe_div(F.col("max_sales") - F.col("min_sales"), "mean_sales"),
            "monthly_cv": safe_div("monthly_std", "overall_monthly_mean"),
        })
        .drop("_means")
    )


def seasonal_flags(
    df: DataFrame,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    cv: float = 0.3,
    range_ratio: float = 2.0,
    month_cv: float = 0.25,
) -> DataFrame:
    """Three criteria, their score 0..3 and ``is_seasonal`` for two or more.

    Series without a monthly cv are dropped.
    """
    metrics = seasonal_metrics(df, key, date, value)
    flags = {
        "high_cv": F.col("cv") >= cv,
        "high_range_ratio": F.col("range_ratio") >= range_ratio,
        "high_monthly_cv": F.col("monthly_cv") >= month_cv,
    }
    score = sum((F.when(c, 1).otherwise(0) for c in flags.values()), F.lit(0))
    return (
        metrics.filter(F.col("monthly_cv").isNotNull())
        .withColumns(flags).withColumn("seasonality_score", score)
        .withColumn("is_seasonal", F.col("seasonality_score") >= 2)
    )


def calendar_complete(
    df: DataFrame,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    bounds: str = "series",
) -> DataFrame:
    """One row per series and month between bounds; missing months are NULL.

    ``series`` uses the first and last month of each series, ``table`` those of the whole table.
    Dates are moved to the start of their month first.
    """
    monthly = df.groupBy(F.col(key), month_start(date).alias(date)).agg(F.sum(value).alias(value))
    if bounds == "series":
        spans = monthly.groupBy(key).agg(F.min(date).alias("first"), F.max(date).alias("last"))
        first, last = F.col("first"), F.col("last")
    elif bounds == "table":
        spans = monthly.select(key).distinct()
        first, last = monthly.agg(F.min(date)).scalar(), monthly.agg(F.max(date)).scalar()
    else:
        raise ValueError(f"unknown bounds: {bounds}")
    calendar = spans.select(key, F.explode(month_sequence(first, last)).alias(date))
    return calendar.join(monthly, [key, date], "left")


def linear_interpolate(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y",
) -> DataFrame:
    """Fill gaps between known values linearly by row; the last known value carries on to the end."""
    order = series_order(key, date)
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col(value).alias("y")))
    staged = df.withColumn("_pos", F.row_number().over(order)).withColumn("_known", known).withColumns({
        "_left": F.last("_known", ignorenulls=True).over(before),
        "_right": F.first("_known", ignorenulls=True).over(after),
    })
    left, right = F.col("_left"), F.col("_right")
    share = safe_div(F.col("_pos") - left["pos"], right["pos"] - left["pos"])
    between = left["y"] + (right["y"] - left["y"]) * share
    filled = F.coalesce(F.col(value), between, left["y"])
    return staged.withColumn(value, filled).drop("_pos", "_known", "_left", "_right")


def decompose(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y", season: int = SEASON,
) -> DataFrame:
    """Classical additive decomposition: centred moving average, phase means, remainder.

    The phase is the position modulo the season. Trend, seasonal and remainder are NULL in the
    first and last half season, where the centred average has no full frame.
    """
    order = series_order(key, date)
    half = season // 2
    back, ahead = order.rowsBetween(-half, half - 1), order.rowsBetween(1 - half, half)
    full = F.count(value).over(order.rowsBetween(-half, half)) == season + 1
    staged = df.withColumn("pos", F.row_number().over(order) - 1).withColumn(
        "trend", F.when(full, (F.avg(value).over(back) + F.avg(value).over(ahead)) / 2))
    staged = staged.withColumn("detrended", F.col(value) - F.col("trend")).withColumn(
        "phase", F.col("pos") % season)
    phase_mean = F.avg("detrended").over(Window.partitionBy(key, "phase"))
    staged = staged.withColumn("phase_mean", phase_mean)
    # The mean over the phases, not over the rows: each phase counts once.
    first_of_phase = F.when(F.col("pos") < season, F.col("phase_mean"))
    centre = F.avg(first_of_phase).over(series_all(key))
    return staged.withColumn(
        "seasonal", F.when(F.col("trend").isNotNull(), F.col("phase_mean") - centre)
    ).withColumn("remainder", F.col("detrended") - F.col("seasonal")).drop("phase_mean", "detrended", "phase")


# Variances below this share of the mean square are rounding noise, e.g. around a straight line.
NOISE = 1e-24


def seasonal_strength_decomp(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y", min_periods: int = 24,
) -> DataFrame:
    """var(S) / (var(S) + var(R)) with a status for short and constant series."""
    parts = decompose(linear_interpolate(df, key, date, value), key, date, value)
    measured = parts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_periods"), F.var_samp(value).alias("variance"),
        F.var_pop("seasonal").alias("s"), F.var_pop("remainder").alias("r"),
        (F.avg(F.col(value) * F.col(value)) * NOISE).alias("noise"))
    enough = F.col("n_periods") >= min_periods
    both = F.col("s") + F.col("r")
    ratio = F.coalesce(F.when(both > F.col("noise"), safe_div("s", both)), F.lit(0.0))
    return measured.select(
        key,
        F.when(~enough, F.lit(None)).when(F.col("variance") == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))).alias("seasonal_strength"),
        "n_periods",
        F.when(~enough, "insufficient_data").when(F.col("variance") == 0, "constant_series").otherwise(
            "success").alias("status"),
    )


def seasonal_strength_alt(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y", min_periods: int = 24,
) -> DataFrame:
    """1 - var(R) / var(S + R) on the completed calendar; NULL below two seasons or without variance."""
    complete = linear_interpolate(calendar_complete(df, key, date, value), key, date, value)
    parts = decompose(complete, key, date, value)
    both = F.var_samp(F.col("seasonal") + F.col("remainder"))
    usable = (F.count(F.lit(1)) >= min_periods) & (both > F.avg(F.col(value) * F.col(value)) * NOISE)
    return parts.groupBy(key).agg(
        F.when(usable, 1 - safe_div(F.var_samp("remainder"), both)).alias("seasonal_strength"))
