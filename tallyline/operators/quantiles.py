"""Exact quantiles of groups of any size.

``percentile`` gathers the values of a group in one aggregation buffer. That is fine for a series,
which is bounded by the calendar, but not for a group that may hold a third of all rows (and a
grand total always holds all of them). Here the values are counted first, so equal values travel
once. Then boundaries cut the distinct values into buckets of about ``BUCKET_ROWS`` values, bucket
counts tell which bucket holds a wanted rank, and only the values of that bucket are ranked. The
number of buckets follows the number of values, so no task's share grows with the data, and the
result is exact whatever the boundaries are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.lineage import cut

# Counted values of all groups together that one bucket holds, about.
BUCKET_ROWS = 50_000


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with their counts; NULL values are left out."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _same(groups: Sequence[str], a: str, b: str) -> Column:
    condition = F.lit(True)
    for g in groups:
        condition = condition & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return condition


def with_buckets(counts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Write a table of value counts once and add the ``bucket`` of each value.

    The boundaries, the bucket sizes and the ranking all read the counts, and none of them should
    scan the source again. The boundaries, one per ``bucket_rows`` values, come to the driver to
    become the splits of a ``Bucketizer``.
    """
    counts = cut(counts)
    rows = counts.filter(F.col("value").isNotNull()).count()
    buckets = -(-rows // bucket_rows)
    found = []
    if buckets > 1:
        steps = [i / buckets for i in range(1, buckets)]
        found = counts.agg(F.percentile_approx("value", steps, max(2000, 8 * buckets))).first()[0] or []
    inner = sorted({e for e in found if abs(e) != float("inf")}) or [0.0]  # one boundary at least
    splits = [float("-inf"), *inner, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="value", outputCol="bucket", handleInvalid="keep")
    return bucketizer.transform(counts).withColumn("bucket", F.col("bucket").cast("int"))


def _ranks(q: float, mode: str) -> dict[str, Column]:
    """Ranks of the two neighbours of a quantile, from the size ``n`` of the group."""
    position = (F.col("n") - 1) * F.lit(float(q))
    if mode == "nearest":
        return {"low": F.floor(position + 0.5), "high": F.floor(position + 0.5)}
    return {"low": F.floor(position), "high": F.ceil(position)}


def _all_ranks(wanted: Mapping[str, float], mode: str) -> dict[str, Column]:
    if mode not in ("linear", "neighbours", "nearest"):
        raise ValueError(f"unknown mode: {mode}")
    return {f"{name}__{side}": rank for name, q in wanted.items() for side, rank in _ranks(q, mode).items()}


def wanted_buckets(sizes: DataFrame, groups: Sequence[str], wanted: Mapping[str, float], mode: str) -> DataFrame:
    """The buckets that hold a wanted rank, with the group's size ``n`` and the rows ``before``.

    ``sizes`` has one row per group and bucket, with ``bucket_rows``.
    """
    whole = Window.partitionBy(*groups)
    before = F.sum("bucket_rows").over(whole.orderBy("bucket")) - F.col("bucket_rows")
    holds = F.lit(False)
    for rank in _all_ranks(wanted, mode).values():
        holds = holds | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("bucket_rows")))
    return sizes.withColumns({"n": F.sum("bucket_rows").over(whole), "before": before}).filter(holds)


def ranked_quantiles(inside: DataFrame, groups: Sequence[str], wanted: Mapping[str, float], mode: str) -> DataFrame:
    """Quantiles from the values of the wanted buckets: (groups, bucket, value, weight, n, before)."""
    ranks = _all_ranks(wanted, mode)
    within = Window.partitionBy(*groups, "bucket").orderBy("value")
    inside = inside.withColumn("upto", F.col("before") + F.sum("weight").over(within))

    def holds_rank(rank: Column) -> Column:
        return (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("weight"))

    found = inside.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(holds_rank(rank), F.col("value"))).alias(name) for name, rank in ranks.items()])
    results = []
    for name, q in wanted.items():
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        p = (F.col("n") - 1) * F.lit(float(q))
        if mode == "linear":
            value = low + (high - low) * (p - F.floor(p))
        elif mode == "neighbours":
            value = (low + high) / F.lit(2.0)
        else:
            value = low
        results.append(value.alias(name))
    return found.select(*groups, *results)


def in_buckets(counts: DataFrame, kept: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The counted values that lie in a kept bucket of their group."""
    return (
        counts.alias("v")
        .join(kept.alias("k"), _same(groups, "v", "k") & (F.col("v.bucket") == F.col("k.bucket")))
        .select(*[F.col(f"v.{g}").alias(g) for g in groups], F.col("v.bucket").alias("bucket"),
                "value", "weight", "n", "before")
    )


def weighted_quantiles(
    counts: DataFrame, groups: Sequence[str], wanted: Mapping[str, float], mode: str = "linear",
) -> DataFrame:
    """Quantiles of a (groups, value, weight, bucket) table, one column per wanted name.

    ``linear`` interpolates between the two neighbours of rank (n - 1) q, ``neighbours`` takes
    their plain mean and ``nearest`` the value at the rounded rank.
    """
    sizes = counts.groupBy(*groups, "bucket").agg(F.sum("weight").alias("bucket_rows"))
    kept = wanted_buckets(sizes, groups, wanted, mode)
    return ranked_quantiles(in_buckets(counts, kept, groups), groups, wanted, mode)


def grouped_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, wanted: Mapping[str, float], mode: str = "linear",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    counts = with_buckets(value_counts(df, groups, value), bucket_rows)
    return weighted_quantiles(counts, groups, wanted, mode)
