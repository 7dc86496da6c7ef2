"""Seasonal ARIMA per series by innovations regression, without an iterative solver.

The yearly difference of a series is explained in two stages. A long autoregression gives residuals that stand for
the innovations; then the difference is regressed on its own lags and on lags of those residuals, once for every
order of a fixed set, and the order with the least corrected Akaike criterion is kept. All regressions follow from
sums of products over the series' months, so a fit is windows and one aggregate on one partitioning, whatever the
number of series and rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.numeric import null_to_zero
from tallyline.operators.forecast import SEASON, history_arrays, unrolled

# Regressors of the second stage: lags of the difference (w) and of the innovations (e).
REGRESSORS: Mapping[str, tuple[str, int]] = {"ar1": ("w", 1), "ma1": ("e", 1), "sma1": ("e", SEASON)}
# Orders tried, as (p, 0, q)(0, 1, Q) with a season of twelve; at most two regressors each.
ORDERS: Sequence[tuple[str, ...]] = ((), ("ar1",), ("ma1",), ("sma1",), ("ar1", "ma1"), ("ar1", "sma1"), ("ma1", "sma1"))
# Months that a regression needs, beside its coefficients.
LEAST_ROWS = 12


def order_name(order: Sequence[str]) -> str:
    p, q, s = (int(n in order) for n in ("ar1", "ma1", "sma1"))
    return f"({p},0,{q})(0,1,{s})"


def _two(a: Column, b: Column, ab: Column, ay: Column, by: Column) -> tuple[Column, Column]:
    """Coefficients of a regression on two regressors, from sums of squares and products; 0 where they are collinear."""
    det = a * b - ab * ab
    usable = det > 1e-9 * a * b
    zero = F.lit(0.0)
    return (F.when(usable, (ay * b - by * ab) / det).otherwise(zero), F.when(usable, (by * a - ay * ab) / det).otherwise(zero))


def innovations(df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y") -> DataFrame:
    """The series with the yearly difference ``w`` and the residuals ``e`` of its autoregression on two lags."""
    order, whole = Window.partitionBy(key).orderBy(date), Window.partitionBy(key)
    rows = df.select(key, date, null_to_zero(value).alias(value)).withColumn("w", F.col(value) - F.lag(value, SEASON).over(order))
    rows = rows.withColumns({"_1": F.lag("w", 1).over(order), "_2": F.lag("w", 2).over(order)})

    def total(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_2").isNotNull(), F.col(a) * F.col(b))).over(whole), F.lit(0.0))

    names = {"aa": ("_1", "_1"), "bb": ("_2", "_2"), "ab": ("_1", "_2"), "ay": ("_1", "w"), "by": ("_2", "w")}
    rows = rows.withColumns({f"_{n}": total(*pair) for n, pair in names.items()})
    first, second = _two(*[F.col(f"_{n}") for n in ("aa", "bb", "ab", "ay", "by")])
    return rows.withColumn("e", F.col("w") - first * F.col("_1") - second * F.col("_2")).select(key, date, value, "w", "e")


def _sums(rows: DataFrame, key: str, date: str) -> DataFrame:
    """Per series the months in which all regressors are known, and sums of their products and of the difference's."""
    order = Window.partitionBy(key).orderBy(date)
    rows = rows.withColumns({n: F.lag(c, k).over(order) for n, (c, k) in REGRESSORS.items()})
    known = functools.reduce(operator.and_, [F.col(n).isNotNull() for n in REGRESSORS]) & F.col("e").isNotNull()
    names = [*REGRESSORS, "w"]
    return rows.filter(known).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]])


def _candidate(order: Sequence[str]) -> Column:
    """struct<aicc, place, order, coefficients by regressor> of one order, from the sums."""
    zero, weights = F.lit(0.0), dict.fromkeys(REGRESSORS, F.lit(0.0))
    if len(order) == 1:
        a = F.col(f"{order[0]}_{order[0]}")
        weights[order[0]] = F.when(a > 0, F.col(f"{order[0]}_w") / a).otherwise(zero)
    elif order:
        one, two = order
        weights[one], weights[two] = _two(*[F.col(c) for c in (
            f"{one}_{one}", f"{two}_{two}", f"{one}_{two}", f"{one}_w", f"{two}_w")])
    error = F.col("w_w")
    for name in order:
        error = error - weights[name] * F.col(f"{name}_w")
    k = len(order) + 1  # and the variance
    n = F.col("n").cast("double")
    # A perfect fit counts as a billionth of the difference's own square.
    aicc = n * F.log(F.greatest(error, 1e-9 * F.col("w_w")) / n) + 2 * k + 2.0 * k * (k + 1) / (n - k - 1)
    usable = (n >= LEAST_ROWS + k) & (F.col("w_w") > 0)
    return F.struct(F.when(usable, F.round(aicc, 9)).alias("aicc"), F.lit(ORDERS.index(tuple(order))).alias("place"),
                    F.lit(order_name(order)).alias("order"), *[weights[n].alias(n) for n in REGRESSORS])


def fit(df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "y") -> DataFrame:
    """(key, order, ar1, ma1, sma1): the chosen order and its coefficients; series too short for any have order NULL.

    Of orders with equal criteria the first of ``ORDERS`` wins.
    """
    return _chosen(_sums(innovations(df, key, date, value), key, date), key)


def _chosen(sums: DataFrame, key: str) -> DataFrame:
    best = F.array_min(F.filter(F.array(*[_candidate(o) for o in ORDERS]), lambda c: c["aicc"].isNotNull()))
    return sums.withColumn("_best", best).select(key, "_best.order", *[F.col(f"_best.{n}").alias(n) for n in REGRESSORS])


def arima(
    df: DataFrame, horizon: int = 60, key: str = "unique_id", date: str = "ds", value: str = "y", name: str = "arima",
) -> DataFrame:
    """Months after each series' end: last year's value plus the predicted difference; NULL where there is no month a year before.

    Future innovations are 0. A series too short for a regression repeats its last twelve values.
    """
    rows = innovations(df, key, date, value)
    fitted = _chosen(_sums(rows, key, date), key)
    tails = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(date), "w", "e"))).alias("_we")).select(
        F.col(key).alias("_key"), F.transform("_we", lambda p: F.coalesce(p["w"], F.lit(0.0))).alias("ws"),
        F.transform("_we", lambda p: F.coalesce(p["e"], F.lit(0.0))).alias("es"))
    states = history_arrays(df, key, date, value, spread=True).join(fitted, key, "left").join(
        tails, F.col(key) == F.col("_key")).drop("_key")

    def step(acc: Column, _: Column) -> Column:
        def lagged(array: str, k: int) -> Column:
            return F.coalesce(F.get(acc[array], F.size(acc[array]) - k), F.lit(0.0))

        w = F.lit(0.0)
        for n, (c, k) in REGRESSORS.items():
            w = w + F.coalesce(F.col(n), F.lit(0.0)) * lagged("ws" if c == "w" else "es", k)
        moved = F.element_at(F.transform(F.array(w), lambda w: F.struct(
            F.concat(acc["ys"], F.array(F.get(acc["ys"], F.size(acc["ys"]) - SEASON) + w)).alias("ys"),
            F.concat(acc["ws"], F.array(w)).alias("ws"), F.concat(acc["es"], F.array(F.lit(0.0))).alias("es"))), 1)
        return moved

    # Typed as able to hold NULL: a value below one season has no year before it.
    start = F.struct(F.transform("ys", lambda y: F.when(y.isNotNull(), y)).alias("ys"), F.col("ws"), F.col("es"))
    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["ys"])
    return unrolled(states, F.slice(rolled, F.size("ys") + 1, horizon), name, key, date)
