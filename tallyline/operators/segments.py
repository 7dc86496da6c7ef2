"""Segments of series: rules, statistics, and both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.numeric import finite_or_zero, safe_div
from tallyline.lineage import cut
from tallyline.operators import lloyd
from tallyline.operators.clusters import SEED, finite_rows, standardise, vector_table

STATISTICAL_FEATURES = (
    "cv", "trend_strength", "seasonality_strength", "growth_rate", "volatility", "break_points")
SUB_FEATURES = ("cv", "trend_strength", "volatility")


def business_segments(features: DataFrame, key: str = "unique_id") -> DataFrame:
    """First matching rule: seasonal, growth, decline, volatile, stable; with the volume band."""
    growth = finite_or_zero("growth_rate")
    kind = (
        F.when(finite_or_zero("seasonality_strength") > 0.3, "seasonal")
        .when(growth > 0.2, "growth")
        .when(growth < -0.2, "decline")
        .when(finite_or_zero("volatility") > 0.5, "volatile")
        .otherwise("stable")
    )
    return features.select(key, F.concat(kind, F.lit("_"), F.col("volume_category")).alias("segment"))


def statistical_segments(features: DataFrame, key: str = "unique_id", seed: int = SEED) -> DataFrame:
    """KMeans on six standardised features with the best k; series without finite features apart."""
    features = cut(features)
    valid = finite_rows(features, STATISTICAL_FEATURES)
    n = valid.count()
    if n < 2:
        return features.select(key, F.lit("single_cluster").alias("segment"))
    vectors = vector_table(standardise(valid, STATISTICAL_FEATURES), STATISTICAL_FEATURES, key)
    run, _ = lloyd.search(vectors, min(9, n - 1), seed=seed)
    labels = lloyd.labels(vectors, key, {"": run})
    return features.select(key).join(labels, key, "left").select(
        key,
        F.coalesce(F.concat(F.lit("statistical_cluster_"), F.col("cluster").cast("string")),
                   F.lit("outlier_cluster")).alias("segment"))


def combined_segments(features: DataFrame, key: str = "unique_id", seed: int = SEED) -> DataFrame:
    """Rule segments, those of more than three series split by KMeans on three features.

    Features are standardised within their segment. All segments are fitted together, a round of all
    their restarts being one job.
    """
    base = cut(business_segments(features, key).join(features.select(key, *SUB_FEATURES), key))
    points, ks = rule_points(base, key)
    if not ks:
        return base.select(key, "segment")
    found = lloyd.labels(points, key, lloyd.best_fits(points, ks, seed=seed)).select(
        F.col(key).alias("_key"), F.concat("segment", F.lit("_sub"), F.col("cluster").cast("string")).alias("refined"))
    return base.join(found, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("refined", "segment").alias("segment"))


def rule_points(base: DataFrame, key: str = "unique_id") -> tuple[DataFrame, dict[str, int]]:
    """Points of the rule segments that are split, and the number of clusters of each."""
    valid = finite_rows(base, SUB_FEATURES)
    members = base.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    stats = valid.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_valid"),
        *[c for f in SUB_FEATURES for c in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))])
    vector = F.array(*[
        F.coalesce(safe_div(F.col(f) - F.col(f"{f}_mean"), F.col(f"{f}_std")), F.lit(0.0)) for f in SUB_FEATURES])
    points = lloyd.prepared(valid.join(stats, "segment").select(key, "segment", vector.alias("vector")), "vector", key, "segment")
    # Fifteen rows at most: five kinds, three bands.
    split = members.join(stats.select("segment", "n_valid"), "segment").filter((F.col("n") > 3) & (F.col("n_valid") > 1))
    return points, {r["segment"]: min(3, r["n_valid"]) for r in split.collect()}


def segment_series(features: DataFrame, method: str = "combined", key: str = "unique_id", seed: int = SEED) -> DataFrame:
    methods = {
        "business_logic": lambda: business_segments(features, key),
        "statistical": lambda: statistical_segments(features, key, seed),
        "combined": lambda: combined_segments(features, key, seed),
    }
    if method not in methods:
        raise ValueError(f"unknown method: {method}")
    return methods[method]()


def segment_summary(features: DataFrame, segments: DataFrame, key: str = "unique_id") -> DataFrame:
    """Per segment the number of series and average volume, cv, seasonality and growth.

    The member list is the ``segments`` table itself: a segment may hold a large part of all
    series, which must not become one row.
    """
    return features.join(segments, key).groupBy("segment").agg(
        F.count(F.lit(1)).alias("sku_count"),
        F.avg("mean_volume").alias("avg_volume"),
        F.avg("cv").alias("avg_cv"),
        F.avg("seasonality_strength").alias("avg_seasonality"),
        F.avg("growth_rate").alias("avg_growth_rate"),
    )


# Model names per rule, and the default pair.
SEASONAL_MODELS = ("Prophet", "SARIMA", "Holt-Winters")
VARIABLE_MODELS = ("Prophet", "LSTM", "Random Forest")
GROWTH_MODELS = ("Prophet", "Linear Regression with Trend")
SMALL_MODELS = ("Simple Exponential Smoothing", "Linear Regression")
DEFAULT_MODELS = ("ARIMA", "Simple Exponential Smoothing")


def model_recommendation(summary: DataFrame) -> DataFrame:
    """Model names per segment, each once, in alphabetical order."""
    def names(values: tuple[str, ...]):
        return F.array(*[F.lit(v) for v in values])

    none = F.array().cast("array<string>")
    rules = (
        (F.col("avg_seasonality") > 0.3, SEASONAL_MODELS),
        (F.col("avg_cv") > 0.8, VARIABLE_MODELS),
        (F.col("avg_growth_rate") > 0.2, GROWTH_MODELS),
        (F.col("sku_count") < 5, SMALL_MODELS),
    )
    chosen = F.array_distinct(F.concat(*[F.when(c, names(v)).otherwise(none) for c, v in rules]))
    models = F.when(F.size(chosen) > 0, chosen).otherwise(names(DEFAULT_MODELS))
    return summary.select("segment", F.array_sort(models).alias("models"))
