"""Walk-forward validation of the pooled lag regression from running moments, at any number of origins.

The regression's normal equations are sums over rows. Per series the sums of first and second moments
run along the months, so the training rows of an origin (all up to its cut-off, or a window of months before it)
are the difference of two rows of running sums. Scaling by the series' mean and deviation, which differ
from origin to origin, is applied to the moments. Then one aggregate over series gives every origin's
equations, and every series is rolled forward from every origin in the same job: no fit reads the series again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.dates import add_months
from tallyline.functions.numeric import null_to_zero
from tallyline.lineage import cut
from tallyline.operators.backtest import cut_offs
from tallyline.operators.forecast import LAGS, rolled_forward, solved


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def running_moments(
    df: DataFrame, lags: Sequence[int] = LAGS, key: str = "unique_id", date: str = "ds", value: str = "y",
) -> DataFrame:
    """Per series and month the running sums of everything the fit needs.

    ``ones``, ``v``, ``vv``: all rows, the shifted value and its square; ``rows``, ``first``, ``second``: rows with all
    lags, the sums of (value, lags) and of their products. Values are shifted by the series' mean (``shift``),
    which keeps the products small beside their differences.
    """
    whole = Window.partitionBy(key)
    upto = whole.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = whole.orderBy(date)
    shifted = df.select(key, date, null_to_zero(value).alias("_y")).withColumn("shift", F.avg("_y").over(whole)).withColumn(
        "_v0", F.col("_y") - F.col("shift"))
    names = ["_v0"] + [f"_v{i}" for i in range(1, len(lags) + 1)]
    lagged = shifted.withColumns({n: F.lag("_v0", k).over(ordered) for n, k in zip(names[1:], lags)})
    complete = F.lit(True)
    for n in names[1:]:
        complete = complete & F.col(n).isNotNull()

    def running(c: Column) -> Column:
        return F.sum(c).over(upto)

    def kept(c: Column) -> Column:
        return F.coalesce(F.when(complete, c), F.lit(0.0))

    return lagged.select(
        key, date, "shift", running(F.lit(1.0)).alias("ones"), running(F.col("_v0")).alias("v"),
        running(F.col("_v0") * F.col("_v0")).alias("vv"), running(kept(F.lit(1.0))).alias("rows"),
        F.array(*[running(kept(F.col(n))) for n in names]).alias("first"),
        F.array(*[running(kept(F.col(names[i]) * F.col(names[j]))) for i, j in _pairs(len(names))]).alias("second"))


SUMS = ("ones", "v", "vv", "rows", "first", "second")


def origin_moments(
    moments: DataFrame, cuts: Sequence[Column], months: int | None, key: str, date: str,
) -> DataFrame:
    """(origin, cut, key, shift, sums): each origin's training rows of every series that has any."""
    origins = F.array(*[F.struct(
        F.lit(i).alias("origin"), c.alias("cut"),
        (add_months(c, -months) if months else F.lit(None).cast("timestamp_ntz")).alias("before")) for i, c in enumerate(cuts)])
    tagged = moments.withColumn("_o", F.explode(origins)).select("*", "_o.origin", "_o.cut", "_o.before").drop("_o")
    newest = F.struct(F.col(date), *[F.col(c) for c in SUMS])
    at = tagged.filter(F.col(date) <= F.col("cut")).groupBy("origin", "cut", key).agg(
        F.first("shift").alias("shift"), F.max_by(newest, date).alias("_end"),
        F.max_by(newest, F.when(F.col(date) <= F.col("before"), F.col(date))).alias("_start"))

    def difference(name: str) -> Column:
        end, start = F.col("_end")[name], F.col("_start")[name]
        if name in ("first", "second"):
            return F.when(F.col("_start").isNull(), end).otherwise(F.zip_with(end, start, lambda a, b: a - b))
        return end - F.coalesce(start, F.lit(0.0))

    return at.select("origin", "cut", key, "shift", *[difference(c).alias(c) for c in SUMS]).filter("ones > 0.5")


def _scaled_moments(part: DataFrame, width: int) -> DataFrame:
    """Moments of (y - centre) / scale from those of y - shift, with the centre and scale of the origin's rows."""
    centre = F.col("v") / F.col("ones")
    std = F.sqrt(F.greatest(F.col("vv") / F.col("ones") - centre * centre, F.lit(0.0)))
    # Rounding leaves a trace of variance where there is none.
    flat = std <= 1e-7 * (F.abs(F.col("shift") + centre) + F.abs(centre))
    part = part.withColumns({"_c": centre, "scale": F.when(flat, F.lit(1.0)).otherwise(std)}).withColumn(
        "centre", F.col("shift") + F.col("_c"))

    def one(i: int) -> Column:
        return (F.get("first", F.lit(i)) - F.col("rows") * F.col("_c")) / F.col("scale")

    def two(place: int, i: int, j: int) -> Column:
        c = F.col("_c")
        crossed = F.get("second", F.lit(place)) - c * (F.get("first", F.lit(i)) + F.get("first", F.lit(j))) + F.col("rows") * c * c
        return crossed / (F.col("scale") * F.col("scale"))

    return part.select("*", F.array(*[one(i) for i in range(width)]).alias("z1"),
                       F.array(*[two(p, i, j) for p, (i, j) in enumerate(_pairs(width))]).alias("z2"))


def origin_weights(scaled: DataFrame, lags: Sequence[int]) -> DataFrame:
    """(origin, weights, intercept): the ridge regression of every origin, one aggregate for all of them."""
    width = len(lags) + 1
    pairs = _pairs(width)

    def mean(c: Column) -> Column:
        return F.sum(c) / F.nullif(F.sum("rows"), F.lit(0.0))

    def product(i: int, j: int) -> Column:
        return mean(F.get("z2", F.lit(pairs.index((i, j)))))

    equations = scaled.groupBy("origin").agg(
        F.array(*[mean(F.get("z1", F.lit(i))) for i in range(1, width)]).alias("x"), mean(F.get("z1", F.lit(0))).alias("zz"),
        F.array(*[product(0, i) for i in range(1, width)]).alias("xz"),
        F.array(*[product(i, j) for i, j in pairs if i > 0]).alias("xx"))
    return solved(equations, len(lags), ["origin"])


def backtest_prefix(
    df: DataFrame,
    as_of,
    holdout: int = 6,
    origins: int = 1,
    step: int = 6,
    months: int | None = None,
    lags: Sequence[int] = LAGS,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
) -> tuple[DataFrame, DataFrame]:
    """(origin, key, date, actual, forecast) of every held-out month, and (origin, weights, intercept).

    The same as fitting ``forecast.lag_regression`` on the rows up to each cut-off. With ``months`` only that many
    months before a cut-off train (lags may reach further back), which a refit would need another read for.
    """
    df = cut(df.select(key, date, value))
    cuts = cut_offs(as_of, origins, step, holdout)
    scaled = cut(_scaled_moments(
        origin_moments(running_moments(df, lags, key, date, value), cuts, months, key, date), len(lags) + 1
    ).select("origin", "cut", key, "centre", "scale", "rows", "z1", "z2"))
    weights = cut(origin_weights(scaled, lags))
    arrays = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(date), F.col(value)))).alias("_points"))
    state = scaled.select("origin", "cut", key, "centre", "scale").join(arrays, key).join(weights, "origin")
    known = F.filter("_points", lambda p: p[date] <= F.col("cut"))
    later = F.filter("_points", lambda p: (p[date] > F.col("cut")) & (p[date] <= add_months("cut", holdout)))
    state = state.withColumns({
        "ys": F.transform(known, lambda p: F.coalesce(p[value], F.lit(0.0))), "last": F.element_at(known, -1)[date], "_later": later})
    values = F.when(F.col("intercept").isNotNull(), rolled_forward(lags, holdout)).otherwise(
        F.array_repeat(F.lit(None).cast("double"), holdout))
    tested = state.select("origin", key, "last", values.alias("_values"), F.explode("_later").alias("_p"))
    # A series that ended before the cut-off is forecast from its own last month.
    ahead = F.months_between(F.col(f"_p.{date}").cast("date"), F.col("last").cast("date")).cast("int")
    return tested.filter(ahead <= holdout).select(
        "origin", key, F.col(f"_p.{date}").alias(date), F.col(f"_p.{value}").alias("actual"),
        F.get("_values", ahead - 1).alias("forecast")), weights
