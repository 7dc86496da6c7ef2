"""Forecasts of monthly series.

Input is a long series table (``unique_id``, ``ds``, ``y``, one row per series and month); output is
(``unique_id``, ``ds``, model column). Closed forms and parameter searches run as column expressions
per series; models that learn from many series are one pooled Spark ML fit on scaled targets, so
the number of fits does not grow with the number of series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.dates import add_months, days_since, month_index, month_sequence
from tallyline.functions.numeric import nan_to_zero, null_to_zero, row_mean
from tallyline.functions.text import key_concat
from tallyline.lineage import cut
from tallyline.names import NON_MODEL_COLUMNS
from tallyline.operators.filters import drop_if_present, last_months
from tallyline.operators.rollup import numeric_measures
from tallyline.operators.windows import iqr_cap, lag_set

SEASON = 12
SEED = 42
LAGS = (3, 4, 5, 6, 12, 24)


# --- preparation ---------------------------------------------------------------------------------


def model_input(
    history: DataFrame,
    as_of,
    measure: str = "act_orders_rev",
    date: str = "sales_date",
    months: int = 36,
    interpolation: str = "nearest",
) -> DataFrame:
    """The last full months of the history as capped series.

    Planning columns go, NaN becomes 0, the series id is built where absent, outliers are capped
    per series. A cluster label is kept.
    """
    df = drop_if_present(history, [c for c in NON_MODEL_COLUMNS if c != measure])
    floats = [c for c in numeric_measures(df) if dict(df.dtypes)[c] in ("double", "float")]
    df = df.withColumns({c: nan_to_zero(c) for c in floats})
    if "unique_id" not in df.columns:
        df = df.withColumn("unique_id", key_concat("country", "catalog_number"))
    df = iqr_cap(last_months(df, as_of, months, date), measure, interpolation=interpolation)
    kept = ["cluster"] if "cluster" in df.columns else []
    return df.select("unique_id", F.col(date).alias("ds"), F.col(measure).alias("y"), *kept)


def future_frame(df: DataFrame, months: int, key: str = "unique_id", date: str = "ds") -> DataFrame:
    """The months after the last one of each series, with month and day features."""
    last = df.groupBy(key).agg(F.max(date).alias("_last"))
    span = month_sequence(add_months("_last", 1), add_months("_last", months))
    return with_date_features(last.select(key, F.explode(span).alias(date)), date)


def with_date_features(df: DataFrame, date: str = "ds") -> DataFrame:
    return df.withColumns({"month": F.month(date), "days": days_since(date)})


def train_features(df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y") -> DataFrame:
    """Month, days since 2021 and the value twelve rows before (or the value itself)."""
    return lag_set(with_date_features(df, date), (SEASON,), True, value, key, date)


def robust_scale(df: DataFrame, key: str = "unique_id", value: str = "y") -> DataFrame:
    """(y - median) / interquartile range per series; ``centre`` and ``scale`` allow inversion.

    A series without spread keeps scale 1.
    """
    stats = df.groupBy(key).agg(
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    spread = F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))
    scale = F.when(spread > 0, spread).otherwise(F.lit(1.0))
    return (
        df.join(stats.select(key, F.get("_q", F.lit(1)).alias("centre"), scale.alias("scale")), key)
        .withColumn("scaled", (F.col(value) - F.col("centre")) / F.col("scale"))
    )


def history_arrays(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y", spread: bool = False,
) -> DataFrame:
    """One row per series: its values in date order, and its last month.

    The array is as long as the calendar, whatever the number of source rows. With ``spread`` the
    arrays are dealt out again: they are small but folding over them is not.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(date), null_to_zero(value).alias("y"))))
    arrays = df.groupBy(key).agg(F.max(date).alias("last"), F.transform(pairs, lambda p: p["y"]).alias("ys"))
    return arrays.repartition(key) if spread else arrays


def unrolled(states: DataFrame, values: Column, name: str, key: str, date: str) -> DataFrame:
    """An array of forecasts per series as rows."""
    return states.select(key, "last", F.posexplode(values).alias("_h", name)).select(
        key, F.add_months(F.col("last").cast("date"), F.col("_h") + 1).cast("timestamp_ntz").alias(date), name)


# --- models in closed form -----------------------------------------------------------------------


def seasonal_naive(
    df: DataFrame, horizon: int, key: str = "unique_id", date: str = "ds", value: str = "y",
    name: str = "seasonal_naive",
) -> DataFrame:
    """The last twelve values, repeated; NULL where the series is too short."""
    states = history_arrays(df, key, date, value)
    n = F.size("ys")
    values = F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.get("ys", n - SEASON + h % SEASON))
    return unrolled(states, values, name, key, date)


def linear_trend(
    df: DataFrame, horizon: int, key: str = "unique_id", date: str = "ds", value: str = "y",
    name: str = "linear_trend",
) -> DataFrame:
    """Least-squares trend per series plus the mean deviation of each calendar month.

    Slope, intercept and the twelve monthly means are one aggregate.
    """
    t, y = month_index(date), F.col(value)
    monthly = F.array(*[
        F.struct(F.avg(F.when(F.month(date) == m, y)).alias("y"), F.avg(F.when(F.month(date) == m, t)).alias("t"))
        for m in range(1, SEASON + 1)])
    fitted = df.filter(y.isNotNull()).groupBy(key).agg(
        F.max(date).alias("last"),
        F.coalesce(F.regr_slope(y, t), F.lit(0.0)).alias("slope"),
        F.avg(y).alias("mean_y"), F.avg(t).alias("mean_t"), monthly.alias("monthly"))

    def line(at: Column) -> Column:
        return F.col("mean_y") + F.col("slope") * (at - F.col("mean_t"))

    steps = fitted.select("*", F.explode(month_sequence(add_months("last", 1), add_months("last", horizon))).alias("at"))
    month = F.get("monthly", F.month("at") - 1)
    offset = F.coalesce(month["y"] - line(month["t"]), F.lit(0.0))
    return steps.select(key, F.col("at").alias(date), (line(month_index("at")) + offset).alias(name))


# Smoothing weights tried for level, trend and season.
SMOOTHING_GRID = tuple(
    (a, b, g) for a in (0.1, 0.3, 0.6, 0.9) for b in (0.0, 0.1) for g in (0.1, 0.4))


def exp_smoothing(
    df: DataFrame,
    horizon: int,
    grid: Sequence[tuple[float, float, float]] = SMOOTHING_GRID,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    name: str = "exp_smoothing",
) -> DataFrame:
    """Additive level, trend and season smoothing; the weights with the least squared one-step error.

    Every (series, weights) pair is one row, folded over the values of the series inside the JVM.
    Series shorter than two seasons are smoothed without trend and season.
    """
    states = history_arrays(df, key, date, value, spread=True)
    ys, n = F.col("ys"), F.size("ys")
    long_enough = n >= 2 * SEASON

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)

    first, second = F.slice("ys", 1, SEASON), F.slice("ys", SEASON + 1, SEASON)
    zeros = F.array_repeat(F.lit(0.0), SEASON)
    states = states.withColumns({
        "level0": F.when(long_enough, mean(first)).otherwise(F.get(ys, F.lit(0))),
        "trend0": F.when(long_enough, (mean(second) - mean(first)) / SEASON).otherwise(F.lit(0.0)),
    }).withColumns({
        "season0": F.when(long_enough, F.transform(first, lambda y: y - F.col("level0"))).otherwise(zeros),
        "rest": F.when(long_enough, F.slice("ys", SEASON + 1, F.greatest(n - SEASON, F.lit(1)))).otherwise(ys),
        "w": F.explode(F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g"), F.lit(i).alias("i"))
            for i, (a, b, g) in enumerate(grid)])),
    })
    trended = F.when(long_enough, 1.0).otherwise(0.0)
    a, b, g = F.col("w.a"), F.col("w.b") * trended, F.col("w.g") * trended

    def step(acc: Column, y: Column) -> Column:
        level, trend, season = acc["level"], acc["trend"], acc["season"]
        s = F.get(season, F.lit(0))
        error = y - (level + trend + s)
        new_level = level + trend + a * error
        new_trend = trend + b * a * error
        new_season = s + g * (1 - a) * error
        return F.struct(
            new_level.alias("level"), new_trend.alias("trend"),
            F.concat(F.slice(season, 2, SEASON - 1), F.array(new_season)).alias("season"),
            (acc["sse"] + error * error).alias("sse"))

    start = F.struct(F.col("level0").alias("level"), F.col("trend0").alias("trend"),
                     F.col("season0").alias("season"), F.lit(0.0).alias("sse"))
    fitted = states.select(key, "last", "w", F.aggregate("rest", start, step).alias("fit"))
    best = fitted.groupBy(key, "last").agg(F.min_by("fit", F.struct("fit.sse", "w.i")).alias("fit"))
    values = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda h: F.col("fit.level") + h * F.col("fit.trend") + F.get(F.col("fit.season"), (h - 1) % SEASON))
    return unrolled(best, values, name, key, date)


BOOST_ROUNDS, BOOST_RATE = 100, 0.5


def linear_boost(
    df: DataFrame,
    horizon: int = 60,
    rounds: int = BOOST_ROUNDS,
    rate: float = BOOST_RATE,
    penalty: float = 0.0,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    name: str = "linear_boost",
) -> DataFrame:
    """Boosted linear model per series on month, days since 2021 and the value twelve rows before.

    From the series' mean, every round moves the bias and then each weight in turn by ``rate`` times its
    Newton step on the squared error (``penalty`` times the squared weights added). All steps follow from the
    series' sums and products, so the fit is one aggregate and a fold over the rounds, whatever the number of
    rows; the forecast is a fold over the horizon. A lag before the start counts as the mean.
    """
    names = ("month", "days", "lag12")
    rows = train_features(df.select(key, date, null_to_zero(value).alias(value)), key, date, value)
    rows = rows.withColumn("_base", F.avg(value).over(Window.partitionBy(key)))
    x, rest = [F.col(n).cast("double") for n in names], F.col(value) - F.col("_base")
    sums = rows.groupBy(key).agg(
        F.max(date).alias("last"), F.first("_base").alias("base"), F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * rest) for c in x]).alias("c"),
        *[F.array(*[F.sum(a * b) for b in x]).alias(f"g{i}") for i, a in enumerate(x)])

    def step(w: list[Column], i: int) -> Column:
        """The weight ``i`` after its step, from the bias (place 0) and weights before it."""
        gradient = F.get("s", F.lit(i)) * w[0] - F.get("c", F.lit(i)) + penalty * w[i + 1]
        for j in range(len(names)):
            gradient = gradient + F.get(f"g{i}", F.lit(j)) * w[j + 1]
        # A feature that is 0 throughout keeps weight 0.
        return w[i + 1] - F.coalesce(rate * gradient / F.nullif(F.get(f"g{i}", F.lit(i)) + penalty, F.lit(0.0)), F.lit(0.0))

    def one_round(acc: Column, _: Column) -> Column:
        def held(values: Column, *rest: Callable[[list[Column]], Column]) -> Column:
            """The steps one after the other, each value computed once."""
            if not rest:
                return values
            return F.element_at(F.transform(F.array(values), lambda v: held(
                rest[0]([F.get(v, F.lit(j)) for j in range(len(names) + 1)]), *rest[1:])), 1)

        def moved(i: int) -> Callable[[list[Column]], Column]:
            return lambda w: F.array(*[step(w, i) if j == i + 1 else w[j] for j in range(len(names) + 1)])

        bias = F.get(acc, F.lit(0))
        for j in range(len(names)):
            bias = bias - rate / F.col("n") * F.get("s", F.lit(j)) * F.get(acc, F.lit(j + 1))
        bias = bias - rate * F.get(acc, F.lit(0))
        start = F.array(bias, *[F.get(acc, F.lit(j + 1)) for j in range(len(names))])
        return held(start, *[moved(i) for i in range(len(names))])

    zeros = F.array(*[F.lit(0.0)] * (len(names) + 1))
    fitted = sums.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zeros, one_round)).select(key, "base", "w")
    states = history_arrays(df, key, date, value, spread=True).join(fitted, key)

    def roll(acc: Column, h: Column) -> Column:
        day = F.add_months(F.col("last").cast("date"), h)
        lag = F.coalesce(F.get(acc, F.size(acc) - SEASON), F.col("base"))
        value_next = F.col("base") + F.get("w", F.lit(0)) + F.get("w", F.lit(1)) * F.month(day) + F.get("w", F.lit(2)) * days_since(day)
        return F.concat(acc, F.array(value_next + F.get("w", F.lit(3)) * lag))

    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("ys"), roll)
    return unrolled(states, F.slice(rolled, F.size("ys") + 1, horizon), name, key, date)


# --- pooled models -------------------------------------------------------------------------------


def _scales(df: DataFrame, key: str, value: str) -> DataFrame:
    std = F.stddev_pop(value)
    return df.groupBy(key).agg(
        F.avg(value).alias("centre"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("scale"))


def _scaled(df: DataFrame, key: str, value: str) -> DataFrame:
    w = Window.partitionBy(key)
    std = F.stddev_pop(value).over(w)
    return df.withColumns({
        "centre": F.avg(value).over(w), "scale": F.when(std > 0, std).otherwise(F.lit(1.0)),
    }).withColumn("z", (F.col(value) - F.col("centre")) / F.col("scale"))


TREE_FEATURES = ("month", "days", "zlag12")


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_trees(
    df: DataFrame, kind: str = "boosted", key: str = "unique_id", date: str = "ds", value: str = "y", seed: int = SEED,
):
    """One pooled tree model on month, days and the scaled value twelve rows before."""
    staged = _scaled(df.withColumn(value, null_to_zero(value)), key, value)
    staged = lag_set(with_date_features(staged, date), (SEASON,), True, "z", key, date)
    train = cut(_assembled(staged.withColumnRenamed("lag12", "zlag12"), TREE_FEATURES).select("features", "z"))
    if kind == "boosted":
        estimator = GBTRegressor(featuresCol="features", labelCol="z", maxIter=20, maxDepth=4, seed=seed)
    elif kind == "forest":
        estimator = RandomForestRegressor(featuresCol="features", labelCol="z", numTrees=30, maxDepth=8, seed=seed)
    else:
        raise ValueError(f"unknown model: {kind}")
    return estimator.fit(train)


def tree_predictor(model) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: model.transform(_assembled(rows, TREE_FEATURES)).drop("features")


def recursive_forecast(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    blocks: int = 5,
    block: int = SEASON,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    name: str = "prediction",
) -> DataFrame:
    """Predict ``blocks`` blocks of ``block`` months; each block reads the one before as its lags.

    ``predict`` adds ``prediction`` (scaled) to rows with month, days and ``zlag12``. The state between
    blocks is one row per series: its scale, its last month and its last twelve scaled values.
    Each block is one distributed prediction, written before the next one reads it.
    """
    if block > SEASON:
        raise ValueError("a block cannot be longer than the lag it reads")
    arrays = history_arrays(df, key, date, value).join(
        _scales(df.withColumn(value, null_to_zero(value)), key, value), key)
    n = F.size("ys")
    recent = F.transform(F.sequence(F.lit(0), F.lit(SEASON - 1)), lambda i: F.coalesce(
        (F.get("ys", n - SEASON + i) - F.col("centre")) / F.col("scale"), F.lit(0.0)))
    state = cut(arrays.select(key, "last", "centre", "scale", recent.alias("recent")))
    blocks_done: list[DataFrame] = []
    for _ in range(blocks):
        rows = state.select("*", F.posexplode(F.slice("recent", 1, block)).alias("h", "zlag12"))
        rows = rows.withColumn(
            date, F.add_months(F.col("last").cast("date"), F.col("h") + 1).cast("timestamp_ntz"))
        done = cut(predict(with_date_features(rows, date)).select(
            key, date, "h", "last", "centre", "scale", "recent", F.col("prediction").alias("_z")))
        blocks_done.append(done.select(key, date, (F.col("_z") * F.col("scale") + F.col("centre")).alias(name)))
        fresh = F.transform(F.sort_array(F.collect_list(F.struct("h", "_z"))), lambda p: p["_z"])
        state = done.groupBy(key).agg(
            F.max(date).alias("last"), F.first("centre").alias("centre"), F.first("scale").alias("scale"),
            F.concat(F.slice(F.first("recent"), block + 1, SEASON), fresh).alias("recent"))
    result = blocks_done[0]
    for other in blocks_done[1:]:
        result = result.unionByName(other)
    return result


def tree_forecast(
    df: DataFrame, horizon: int = 60, kind: str = "boosted", key: str = "unique_id", date: str = "ds",
    value: str = "y", name: str = "tree", seed: int = SEED,
) -> DataFrame:
    df = cut(df.select(key, date, value))
    model = fit_trees(df, kind, key, date, value, seed)
    blocks = -(-horizon // SEASON)
    table = recursive_forecast(df, tree_predictor(model), blocks, SEASON, key, date, value, name)
    if horizon % SEASON == 0:
        return table
    last = df.groupBy(key).agg(F.max(date).alias("_last"))
    return table.join(last, key).filter(F.col(date) <= add_months("_last", horizon)).drop("_last")


def voting_forecast(
    df: DataFrame, horizon: int = 60, key: str = "unique_id", date: str = "ds", value: str = "y",
    name: str = "voting", seed: int = SEED,
) -> DataFrame:
    """Mean of the boosted trees and the linear trend."""
    df = cut(df.select(key, date, value))
    tree = tree_forecast(df, horizon, "boosted", key, date, value, "tree", seed)
    line = linear_trend(df, horizon, key, date, value, "line")
    return tree.join(line, [key, date], "full").select(key, date, row_mean("tree", "line").alias(name))


RIDGE = 0.01
# A cluster's fit starts from this many rows of the pooled one.
PRIOR_ROWS = 24.0


def _lag_moments(staged: DataFrame, lags: Sequence[int], group: Sequence[str]) -> DataFrame:
    """Per group the complete rows and the means of ``z``, its lags and their products: one aggregate."""
    names = [f"lag{k}" for k in lags]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    complete = F.lit(True)
    for name in names:
        complete = complete & F.col(name).isNotNull()

    def mean(c: Column) -> Column:
        return F.avg(F.when(complete, c))

    return staged.groupBy(*group).agg(
        F.count(F.when(complete, 1)).cast("double").alias("rows"),
        F.array(*[mean(F.col(n)) for n in names]).alias("x"), mean(F.col("z")).alias("zz"),
        F.array(*[mean(F.col(n) * F.col("z")) for n in names]).alias("xz"),
        F.array(*[mean(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("xx"))


def _towards_pool(moments: DataFrame, width: int, prior: float = PRIOR_ROWS) -> DataFrame:
    """Each group's means with ``prior`` rows of the pooled means added; a group without rows gets the pool's."""
    moments = cut(moments)
    sizes = {"x": width, "xz": width, "xx": width * (width + 1) // 2}

    def pooled(c: Column) -> Column:
        return F.sum(F.col("rows") * c) / F.nullif(F.sum("rows"), F.lit(0.0))

    pool = moments.filter("rows > 0").agg(F.struct(
        pooled(F.col("zz")).alias("zz"),
        *[F.array(*[pooled(F.get(n, F.lit(i))) for i in range(size)]).alias(n) for n, size in sizes.items()])).scalar()

    def mixed(own: Column, whole: Column) -> Column:
        return F.when(F.col("rows") > 0, (F.col("rows") * own + prior * whole) / (F.col("rows") + prior)).otherwise(whole)

    return moments.withColumn("_pool", pool).select(
        *[c for c in moments.columns if c not in (*sizes, "zz")], mixed(F.col("zz"), F.col("_pool.zz")).alias("zz"),
        *[F.zip_with(n, F.col(f"_pool.{n}"), mixed).alias(n) for n in sizes])


def solved(moments: DataFrame, width: int, group: Sequence[str]) -> DataFrame:
    """Per group the ridge regression of ``z`` on its lags: ``weights`` and ``intercept``.

    One small system of equations per group. A group without a mean has no weights.
    """
    pairs = [(i, j) for i in range(width) for j in range(i, width)]

    def solve(frames):
        for frame in frames:
            rows = []
            for x, z, xz, xx in zip(frame["x"], frame["zz"], frame["xz"], frame["xx"]):
                if z is None or np.isnan(z):
                    rows.append((None, None))
                    continue
                x, xz = np.array(x, dtype=float), np.array(xz, dtype=float)
                both = np.zeros((width, width))
                for (i, j), v in zip(pairs, xx):
                    both[i, j] = both[j, i] = v
                spread = both - np.outer(x, x)
                # The penalty is relative to each lag's variance, as if lags were standardised.
                spread += np.diag(RIDGE * np.maximum(np.diag(spread), 1e-12))
                w = np.linalg.lstsq(spread, xz - x * z, rcond=None)[0]
                rows.append((w.tolist(), float(z - w @ x)))
            out = frame[list(group)].copy()
            out["weights"], out["intercept"] = [r[0] for r in rows], [r[1] for r in rows]
            yield out

    kinds = "".join(f"{g} {moments.schema[g].dataType.simpleString()}, " for g in group)
    return moments.select(*group, "x", "zz", "xz", "xx").mapInPandas(solve, f"{kinds}weights array<double>, intercept double")


def rolled_forward(lags: Sequence[int], horizon: int) -> Column:
    """The months after ``ys``: a fold over the horizon with ``weights`` and ``intercept`` on values of ``centre`` and ``scale``."""
    scaled = F.transform("ys", lambda y: (y - F.col("centre")) / F.col("scale"))

    def roll(acc: Column, _: Column) -> Column:
        value_next = F.col("intercept")
        for i, k in enumerate(lags):
            value_next = value_next + F.get("weights", F.lit(i)) * F.coalesce(F.get(acc, F.size(acc) - k), F.lit(0.0))
        return F.concat(acc, F.array(value_next))

    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), scaled, roll)
    return F.transform(F.slice(rolled, F.size("ys") + 1, horizon), lambda z: z * F.col("scale") + F.col("centre"))


def lag_regression(
    df: DataFrame,
    horizon: int = 56,
    lags: Sequence[int] = LAGS,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    name: str = "lag_regression",
    cluster: str | None = None,
) -> DataFrame:
    """A linear model on lagged values over all series (or per ``cluster``), rolled forward by months.

    The fit is one aggregate, whatever the number of clusters; the coefficients join the series and
    the recursion is a fold over the horizon. A lag before the start of a series counts as its mean.
    A cluster's equations lean towards the pooled ones, so a cluster of short series still has a forecast.
    Where no series at all has a complete row of lags, nothing can be fitted and the forecast is NULL.
    """
    group = [cluster] if cluster else []
    # Written once: the fit and the roll-forward both read the series.
    df = cut(df.select(key, date, *group, null_to_zero(value).alias(value)))
    staged = lag_set(_scaled(df, key, value), lags, False, "z", key, date)
    moments = _lag_moments(staged, lags, group)
    weights = cut(solved(_towards_pool(moments, len(lags)) if group else moments, len(lags), group))
    arrays = history_arrays(df, key, date, value, spread=True).join(_scales(df, key, value), key)
    if cluster:
        labels = df.groupBy(key).agg(F.min(cluster).alias(cluster))
        arrays = arrays.join(labels, key).join(weights, cluster)
    else:
        # One row, read as scalar subqueries.
        arrays = arrays.withColumn("_fit", weights.select(F.struct("weights", "intercept")).scalar()).select(
            "*", "_fit.weights", "_fit.intercept")
    values = rolled_forward(lags, horizon)
    plain = F.when(F.col("intercept").isNotNull(), values).otherwise(F.array_repeat(F.lit(None).cast("double"), horizon))
    if not cluster:
        return unrolled(arrays, plain, name, key, date)
    return arrays.select(key, cluster, "last", F.posexplode(plain).alias("_h", name)).select(
        key, F.add_months(F.col("last").cast("date"), F.col("_h") + 1).cast("timestamp_ntz").alias(date), name, cluster)


def cluster_models(
    df: DataFrame, horizon: int, lags: Sequence[int] = LAGS, cluster: str = "cluster", key: str = "unique_id",
) -> DataFrame:
    """The lag regression fitted and rolled forward per cluster; rows without a label are left out.

    All clusters are fitted in one job with the label as key, so their number has no bound.
    """
    known = df.filter(F.col(cluster).isNotNull()).withColumn(cluster, F.col(cluster).cast("string"))
    return lag_regression(known, horizon, lags, key, cluster=cluster)


# --- ensembles -----------------------------------------------------------------------------------


def join_models(*forecasts: DataFrame, key: str = "unique_id", date: str = "ds") -> DataFrame:
    """Outputs of several models side by side."""
    result = forecasts[0]
    for other in forecasts[1:]:
        result = result.join(other, [key, date], "full")
    return result


def ensemble_mean(df: DataFrame, models: Sequence[str], name: str = "ensemble") -> DataFrame:
    """Mean of the model columns that have a value."""
    return df.withColumn(name, row_mean(*models))

