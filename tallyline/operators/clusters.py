"""Clustering of series: k-means in batched rounds, and bisecting k-means of Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.dates import month_index
from tallyline.functions.numeric import finite_or_zero, is_finite, safe_div
from tallyline.lineage import cut
from tallyline.operators import lloyd
from tallyline.operators.combine import label_join
from tallyline.operators.features import TS_FEATURES, ts_features
from tallyline.operators.filters import training_cutoff
from tallyline.operators.windows import zscore

SEED = 42


def month_vectors(
    df: DataFrame, key: str = "unique_id", date: str = "ds", value: str = "ynorm",
) -> DataFrame:
    """One array per series over all months of the table; missing months are 0.

    The array is filled from the months a series has, so no series x month grid is built.
    """
    index = month_index(date)
    first, last = df.agg(F.min(index)).scalar(), df.agg(F.max(index)).scalar()
    filled = df.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(index.alias("k"), F.col(value).alias("v")))).alias("known"))
    vector = F.transform("_axis", lambda m: F.coalesce(F.try_element_at("known", m), F.lit(0.0)))
    return (
        filled.withColumns({"_first": first, "_last": last})
        .withColumn("_axis", F.sequence("_first", "_last"))
        .select(key, vector.alias("vector"))
    )


def standardise(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / population std per feature over the whole table; a constant feature gives 0.

    The statistics are one row, read as a scalar subquery.
    """
    stats = df.agg(F.struct(*[
        c for f in features for c in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))
    ])).scalar()
    return df.withColumn("_stats", stats).withColumns({
        f: F.coalesce(safe_div(F.col(f) - F.col("_stats")[f"{f}_mean"], F.col("_stats")[f"{f}_std"]), F.lit(0.0))
        for f in features
    }).drop("_stats")


def vector_table(df: DataFrame, features: Sequence[str], key: str = "unique_id") -> DataFrame:
    """The features as points, written once, since every round of a fit reads them again."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    return lloyd.prepared(df.select(key, vector.alias("vector")), "vector", key)


def best_k(points: DataFrame, last_k: int, default: int = 2, seed: int = SEED) -> tuple[int, float]:
    """The k from 2 to ``last_k`` with the best silhouette (squared Euclidean), and the score."""
    run, scores = lloyd.search(points, last_k, default, seed=seed)
    return run.k, scores.get(run.k, -1.0)


def kmeans_labels(points: DataFrame, k: int, key: str = "unique_id", seed: int = SEED) -> DataFrame:
    """(key, cluster) of the best of several starts."""
    return lloyd.labels(points, key, lloyd.best_fits(points, {"": k}, seed=seed)).drop("segment")


def feature_points(
    history: DataFrame, as_of, key: str = "unique_id", date: str = "ds", value: str = "y",
) -> DataFrame:
    """Standardised features of every series up to one month before ``as_of``, as points."""
    train = training_cutoff(history, as_of, 1, date=date)
    clean = ts_features(train, key=key, date=date, value=value).select(key, *[finite_or_zero(f).alias(f) for f in TS_FEATURES])
    return vector_table(standardise(cut(clean), TS_FEATURES), TS_FEATURES, key)


def feature_clusters(
    history: DataFrame,
    as_of,
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    max_clusters: int = 10,
    seed: int = SEED,
) -> DataFrame:
    """History with a cluster label per series from its features up to one month before ``as_of``.

    With fewer than four series that have features, every label is NULL.
    """
    # Written once: the features and the labelled result both read it.
    history = cut(history)
    points = feature_points(history, as_of, key, date, value)
    n = points.count()
    if n < 4:
        return history.withColumn("cluster", F.lit(None).cast("string"))
    run, _ = lloyd.search(points, min(max_clusters, n // 2 - 1), seed=seed)
    labels = lloyd.labels(points, key, {"": run}).drop("segment")
    # The label joins on the series, so all its rows carry it and there is no gap left to fill.
    return label_join(history, labels.withColumn("cluster", F.col("cluster").cast("string")), key)


def shape_vectors(
    history: DataFrame, as_of, key: str = "unique_id", date: str = "ds", value: str = "y",
) -> DataFrame:
    """Normalised month vectors of the training rows."""
    train = training_cutoff(history, as_of, 1, date=date)
    return month_vectors(zscore(train, value, key), key, date)


def shape_clusters(
    history: DataFrame,
    as_of,
    k: int = 6,
    method: str = "bisecting",
    key: str = "unique_id",
    date: str = "ds",
    value: str = "y",
    seed: int = SEED,
) -> DataFrame:
    """History with a label per series from the shape of its normalised months.

    ``bisecting`` splits clusters top-down, ``kmeans`` fits all at once.
    """
    # Written once: the axis of months, the vectors and the labelled result all read it.
    history = cut(history)
    vectors = shape_vectors(history, as_of, key, date, value)
    if method == "bisecting":
        vectors = cut(vectors.select(key, array_to_vector("vector").alias("vector")))
        model = BisectingKMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(vectors)
        labels = model.transform(vectors).select(key, "cluster")
    elif method == "kmeans":
        labels = kmeans_labels(lloyd.prepared(vectors, "vector", key), k, key, seed)
    else:
        raise ValueError(f"unknown method: {method}")
    # The label joins on the series, so all its rows carry it and there is no gap left to fill.
    return label_join(history, labels.withColumn("cluster", F.col("cluster").cast("string")), key)


def finite_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    for f in features:
        df = df.filter(is_finite(F.col(f).cast("double")))
    return df
