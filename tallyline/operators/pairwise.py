"""Work on pairs of near vectors without forming the pairs as rows.

Points are cut into blocks by their distance to one pivot vector: two points closer than a radius
differ by less than the radius in that distance, so only blocks of the same or a neighbouring bin
have to meet. A bin with many points is split by a hash of the id, so a dense bin becomes many block
pairs and no task grows with the data. A pair of blocks meets in one task, where numpy computes the
distances, and only a summary per point leaves it (nearest distances, counts, sums, spanning edges).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.lineage import cut

BLOCK_ROWS = 2048


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices, from differences (no cancellation)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy())


def pivoted(points: DataFrame) -> DataFrame:
    """Add ``_d``, the distance to the vector of the smallest id."""
    pivot = points.agg(F.min_by("vector", "id")).scalar()
    square = F.aggregate(
        F.zip_with("vector", "_pivot", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return points.withColumn("_pivot", pivot).withColumn("_d", F.sqrt(square)).drop("_pivot")


def _blocked(points: DataFrame, radius: float | None, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points with their bin and split, and the table of bins with their number of splits."""
    # A little wider than the radius: rounding must not put two points at exactly the radius two bins apart.
    bin_ = F.floor(F.col("_d") / F.lit(radius * (1 + 1e-9))) if radius else F.lit(0).cast("long")
    binned = points.withColumn("_bin", bin_)
    bins = binned.groupBy("_bin").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_splits"))
    return binned.join(bins, "_bin").withColumn(
        "_split", F.pmod(F.xxhash64("id"), F.col("_splits")).cast("int")).drop("_splits"), bins


def near_blocks(
    left: DataFrame,
    right: DataFrame,
    radius: float | None,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``fn(left block, right block)`` to every pair of blocks that may hold near points.

    Both tables need ``id``, ``vector`` and ``_d`` (see ``pivoted``). Every pair (left point, right
    point) at most ``radius`` apart occurs in exactly one call; with ``radius=None`` every pair does.
    """
    # Both sides may be the same table; fresh column ids keep the two apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    a, a_bins = _blocked(left, radius, block_rows)
    b, b_bins = _blocked(right, radius, block_rows)
    steps = F.array(*[F.lit(s).cast("long") for s in ((-1, 0, 1) if radius else (0,))])

    def spread(points: DataFrame, partner_bins: DataFrame, mine: str, theirs: str) -> DataFrame:
        partners = partner_bins.select(F.col("_bin").alias("_pbin"), F.col("_splits").alias("_psplits"))
        return (
            points.withColumn("_pbin", F.explode(F.transform(steps, lambda s: F.col("_bin") + s)))
            .join(partners, "_pbin")
            .withColumn("_psplit", F.explode(F.sequence(F.lit(0), F.col("_psplits") - 1)))
            .withColumnsRenamed({"_bin": f"{mine}_bin", "_split": f"{mine}_split",
                                 "_pbin": f"{theirs}_bin", "_psplit": f"{theirs}_split"})
            .drop("_psplits")
        )

    keys = ["l_bin", "l_split", "r_bin", "r_split"]
    lefts = spread(a, b_bins, "l", "r").groupBy(*keys)
    rights = spread(b, a_bins, "r", "l").groupBy(*keys)
    columns = [part.split()[0] for part in schema.split(",")]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({c: [] for c in columns})
        return fn(x, y)

    return lefts.cogroup(rights).applyInPandas(meet, schema)


def knn_distance(points: DataFrame, rank: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distance from every point to its ``rank``-th neighbour, the point itself being rank 0.

    The search radius starts small and doubles for the points that are not settled yet: a point is
    settled once its ``rank``-th distance does not exceed the radius, since everything within the
    radius has been seen. The last radius spans the whole table, so every point is settled.
    """
    points = cut(pivoted(points))
    low, high, n = points.agg(F.min("_d"), F.max("_d"), F.count(F.lit(1))).first()
    if n <= rank:
        return points.select("id", F.lit(None).cast("double").alias("distance"))
    span = max(high - low, 1e-12)
    radius = span / min(256, max(1, n // block_rows * 4))

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = euclidean(matrix(x["vector"]), matrix(y["vector"]))
        keep = min(rank + 1, d.shape[1])
        best = np.partition(d, keep - 1, axis=1)[:, :keep]
        return pd.DataFrame({"id": x["id"].to_numpy(), "near": list(best)})

    settled: DataFrame | None = None
    open_points = points
    while True:
        last = radius >= span
        found = near_blocks(open_points, points, radius if not last else None, nearest,
                            "id string, near array<double>", block_rows)
        merged = found.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
        distances = cut(merged.select("id", F.get("near", F.lit(rank)).alias("distance")))
        done = distances if last else distances.filter(F.col("distance") <= radius)
        settled = done if settled is None else settled.unionByName(done)
        if last:
            return settled
        open_points = open_points.join(done, "id", "left_anti")
        if open_points.isEmpty():
            return settled
        radius *= 2


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) edges as (id, component); the component is its smallest id.

    Large-star and small-star rounds (Kiveris et al., 2014). Each round is a grouped minimum and a
    join on the node; the minimum is combined map-side and a hub's join partition is split by
    adaptive execution.
    """
    def minimum(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    current = cut(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    before = signature(current)
    while True:  # the edges reach a fixed point
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(minimum(both), "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        )
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = minimum(down)
        small = (
            down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v")).distinct()
        )
        current = cut(small)
        after = signature(current)
        if after == before:
            break
        before = after
    return nodes.join(
        current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left"
    ).withColumn("component", F.coalesce("component", "id"))


def density_clusters(
    points: DataFrame, eps: float = 0.2, min_points: int = 20, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Density clusters: ``id``, ``core`` and ``component`` (smallest core id; NULL for noise).

    A core point has at least ``min_points`` points within ``eps``, itself included. Core points
    within ``eps`` of each other share a cluster; another point within ``eps`` of a core point
    joins the cluster with the smallest id among those.
    """
    points = cut(pivoted(points))

    def count_near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = euclidean(matrix(x["vector"]), matrix(y["vector"]))
        return pd.DataFrame({"id": x["id"].to_numpy(), "n": (d <= eps).sum(axis=1)})

    counted = near_blocks(points, points, eps, count_near, "id string, n long", block_rows).groupBy("id").agg(
        F.sum("n").alias("n"))
    flagged = cut(points.join(counted, "id").withColumn("core", F.col("n") >= min_points).drop("n"))
    cores = flagged.filter("core").drop("core")

    def spanning(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        # A forest over the points of the two blocks instead of all their near pairs.
        near = euclidean(matrix(x["vector"]), matrix(y["vector"])) <= eps
        xs, ys = x["id"].to_numpy(), y["id"].to_numpy()
        edges: list[tuple[str, str]] = []
        seen_x, seen_y = np.zeros(len(xs), bool), np.zeros(len(ys), bool)
        for start in range(len(xs)):
            if seen_x[start]:
                continue
            seen_x[start] = True
            front = np.array([start])
            edges.append((xs[start], xs[start]))
            while len(front):
                hit = near[front].any(axis=0) & ~seen_y
                seen_y |= hit
                new_y = np.flatnonzero(hit)
                edges += [(xs[start], v) for v in ys[new_y]]
                back = near[:, new_y].any(axis=1) & ~seen_x if len(new_y) else np.zeros(len(xs), bool)
                seen_x |= back
                front = np.flatnonzero(back)
                edges += [(xs[start], v) for v in xs[front]]
        return pd.DataFrame(edges, columns=["u", "v"])

    edges = near_blocks(cores, cores, eps, spanning, "u string, v string", block_rows)
    labelled = cut(cores.join(components(edges), "id"))

    def smallest_label(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        near = euclidean(matrix(x["vector"]), matrix(y["vector"])) <= eps
        ordered = y["component"].to_numpy()
        order = np.argsort(ordered)
        first = near[:, order].argmax(axis=1)
        hit = near.any(axis=1)
        return pd.DataFrame({"id": x["id"].to_numpy()[hit], "component": ordered[order][first][hit]})

    border = near_blocks(flagged.filter("not core").drop("core"), labelled, eps, smallest_label,
                         "id string, component string", block_rows).groupBy("id").agg(
        F.min("component").alias("component"))
    assigned = labelled.select("id", "component").unionByName(border)
    return flagged.select("id", "core").join(assigned, "id", "left")


def silhouette(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean Euclidean silhouette of points with ``id``, ``vector`` and ``cluster``; exact.

    The cost is the square of the number of points, shared by all tasks; ranking values of k uses
    Spark's linear-cost evaluator instead (see ``clusters.best_k``).
    """
    points = cut(pivoted(points))

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = euclidean(matrix(x["vector"]), matrix(y["vector"]))
        codes, names = pd.factorize(y["cluster"])
        per = np.zeros((len(x), len(names)))
        for k in range(len(names)):
            per[:, k] = d[:, codes == k].sum(axis=1)
        return pd.DataFrame({
            "id": np.repeat(x["id"].to_numpy(), len(names)),
            "mine": np.repeat(x["cluster"].to_numpy(), len(names)),
            "other": np.tile(np.asarray(names), len(x)),
            "total": per.ravel(),
        })

    totals = near_blocks(points, points, None, sums, "id string, mine string, other string, total double", block_rows)
    sizes = points.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    per_cluster = totals.groupBy("id", "mine", "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    own = F.col("mine") == F.col("other")
    scored = per_cluster.groupBy("id").agg(
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    value = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return scored.agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n_points"))
