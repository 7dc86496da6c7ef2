"""Registered queries: segmentation and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.ranking import ordered_position
from tallyline.operators import charts, clusters, lloyd, pairwise, segments
from tallyline.operators.features import MIN_LENGTH, sku_features
from tallyline.operators.windows import zscore
from tallyline.plans.catalog_series import SKU_SQL
from tallyline.plans.registry import AS_OF, query, rounded, series_sql
from tallyline.sources.tables import Tables, long_series

_CB = ["country", "franchise"]
_SKU = ["catalog_number"]


def _features(t: Tables) -> DataFrame:
    return sku_features(long_series(t, _SKU))


_BUSINESS = f"""sku AS ({SKU_SQL}), seg AS (SELECT *, CASE WHEN seasonality_strength > 0.3 THEN 'seasonal'
  WHEN growth_rate > 0.2 THEN 'growth' WHEN growth_rate < -0.2 THEN 'decline' WHEN volatility > 0.5 THEN 'volatile'
  ELSE 'stable' END || '_' || volume_category AS segment FROM sku),
  summ AS (SELECT segment, count(*) AS sku_count, avg(mean_volume) AS avg_volume, avg(cv) AS avg_cv,
    avg(seasonality_strength) AS avg_seasonality, avg(growth_rate) AS avg_growth_rate FROM seg GROUP BY 1)"""


@query("business_segments", f"WITH {_BUSINESS} SELECT unique_id, segment FROM seg")
def _(t):
    return segments.business_segments(_features(t))


@query("segment_summary", f"""WITH {_BUSINESS} SELECT segment, sku_count, round(avg_volume, 1) AS avg_volume, round(avg_cv, 6) AS avg_cv,
  round(avg_seasonality, 6) AS avg_seasonality, round(avg_growth_rate, 6) AS avg_growth_rate FROM summ""")
def _(t):
    features = _features(t)
    table = segments.segment_summary(features, segments.business_segments(features))
    return rounded(rounded(table, 1, "avg_volume"), 6, "avg_cv", "avg_seasonality", "avg_growth_rate")


@query("model_recommendation", f"""WITH {_BUSINESS}, picks AS (
    SELECT segment, unnest(['Prophet', 'SARIMA', 'Holt-Winters']) AS model FROM summ WHERE avg_seasonality > 0.3
    UNION SELECT segment, unnest(['Prophet', 'LSTM', 'Random Forest']) FROM summ WHERE avg_cv > 0.8
    UNION SELECT segment, unnest(['Prophet', 'Linear Regression with Trend']) FROM summ WHERE avg_growth_rate > 0.2
    UNION SELECT segment, unnest(['Simple Exponential Smoothing', 'Linear Regression']) FROM summ WHERE sku_count < 5)
  SELECT segment, model FROM picks
  UNION ALL SELECT segment, unnest(['ARIMA', 'Simple Exponential Smoothing']) FROM summ WHERE segment NOT IN (SELECT segment FROM picks)""")
def _(t):
    features = _features(t)
    summary = segments.segment_summary(features, segments.business_segments(features))
    return segments.model_recommendation(summary).select("segment", F.explode("models").alias("model"))


@query("segment_scatter", f"""WITH {_BUSINESS} SELECT unique_id, segment, round(mean_volume, 1) AS volume, round(cv, 6) AS cv,
  round(seasonality_strength, 6) AS seasonality, round(growth_rate, 6) AS growth FROM seg""")
def _(t):
    features = _features(t)
    table = charts.segment_scatter(features, segments.business_segments(features))
    return rounded(rounded(table, 1, "volume"), 6, "cv", "seasonality", "growth")


@query("standardise", f"""WITH sku AS ({SKU_SQL}) SELECT unique_id,
  round((cv - avg(cv) OVER ()) / stddev_pop(cv) OVER (), 6) AS cv,
  round((volatility - avg(volatility) OVER ()) / stddev_pop(volatility) OVER (), 6) AS volatility,
  round((break_points - avg(break_points) OVER ()) / stddev_pop(break_points) OVER (), 6) AS break_points FROM sku""")
def _(t):
    chosen = ("cv", "volatility", "break_points")
    return rounded(clusters.standardise(_features(t).select("unique_id", *chosen), chosen), 6, *chosen)


@query("statistical_segments")
def _(t):
    return segments.statistical_segments(_features(t))


@query("combined_segments")
def _(t):
    return segments.combined_segments(_features(t))


@query("feature_clusters")
def _(t):
    return clusters.feature_clusters(long_series(t, _CB), AS_OF)


@query("cluster_labels", f"""SELECT unique_id, count(DISTINCT ds) AS n_rows, 1 AS n_labels, true AS in_range
  FROM ({series_sql(_CB)}) GROUP BY 1""")
def _(t):
    """What SQL can state of a k-means run: history unchanged, one label of k per series."""
    labelled = clusters.shape_clusters(long_series(t, _CB), AS_OF, method="kmeans")
    return labelled.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").cast("int").alias("n_labels"),
        F.bool_and(F.col("cluster").cast("int").between(0, 5)).alias("in_range"))


@query("best_k")
def _(t):
    chosen = segments.STATISTICAL_FEATURES
    valid = clusters.finite_rows(_features(t), chosen)
    vectors = clusters.vector_table(clusters.standardise(valid, chosen), chosen)
    k, score = clusters.best_k(vectors, 9)
    return vectors.agg(F.count(F.lit(1)).alias("n_series")).select(
        "n_series", F.lit(k).alias("best_k"), F.lit(score).alias("score"))


_FINITE = " AND ".join(f"isfinite({c})" for c in segments.STATISTICAL_FEATURES)


@query("cluster_fixed_point", f"""SELECT 'features' AS method, unique_id, true AS nearest, true AS best_score
    FROM ({series_sql(_CB)}) WHERE ds <= TIMESTAMP '2001-07-15' GROUP BY unique_id HAVING count(*) >= {MIN_LENGTH}
  UNION ALL SELECT 'statistical', unique_id, true, true FROM ({SKU_SQL}) WHERE {_FINITE}""")
def _(t):
    """Every label names the nearest of the means of the labelled series, and the reported k scores best."""
    chosen = segments.STATISTICAL_FEATURES
    valid = clusters.finite_rows(_features(t), chosen)
    parts = []
    for method, points, most in (
        ("features", clusters.feature_points(long_series(t, _CB), AS_OF), 10),
        ("statistical", clusters.vector_table(clusters.standardise(valid, chosen), chosen), 9),
    ):
        run, scores = lloyd.search(points, most)
        fixed = lloyd.fixed_point(points, lloyd.labels(points, "unique_id", {"": run}), "unique_id")
        parts.append(fixed.select(F.lit(method).alias("method"), "unique_id", "nearest",
                                  F.lit(scores[run.k] >= max(scores.values())).alias("best_score")))
    return parts[0].unionByName(parts[1])


@query("segment_fixed_point", f"""WITH {_BUSINESS},
    ok AS (SELECT * FROM seg WHERE isfinite(cv) AND isfinite(trend_strength) AND isfinite(volatility)),
    n AS (SELECT segment FROM seg GROUP BY 1 HAVING count(*) > 3),
    v AS (SELECT segment FROM ok GROUP BY 1 HAVING count(*) > 1)
  SELECT segment, unique_id, true AS nearest FROM ok WHERE segment IN (FROM n) AND segment IN (FROM v)""")
def _(t):
    """The same of the rule segments that are split, all fitted at once."""
    features = _features(t)
    base = segments.business_segments(features).join(features.select("unique_id", *segments.SUB_FEATURES), "unique_id")
    points, ks = segments.rule_points(base)
    labelled = lloyd.labels(points, "unique_id", lloyd.best_fits(points, ks))
    return lloyd.fixed_point(points, labelled, "unique_id").select("segment", "unique_id", "nearest")


@query("shape_clusters")
def _(t):
    return clusters.shape_clusters(long_series(t, _CB), AS_OF)


@query("shape_kmeans")
def _(t):
    return clusters.shape_clusters(long_series(t, _CB), AS_OF, method="kmeans")


# Vectors of the pairwise queries: normalised months of every series, first two of them, or all.
_VECTORS = f"""s AS ({series_sql(_CB)}), z AS (SELECT unique_id, ds, coalesce((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 0) AS v
    FROM s WINDOW w AS (PARTITION BY unique_id)),
  cal AS (SELECT u AS unique_id, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS ds FROM
    (SELECT DISTINCT unique_id AS u FROM s), (SELECT min(ds) AS a, max(ds) AS b FROM s)),
  vec AS (SELECT unique_id AS id, list(coalesce(v, 0) ORDER BY ds) AS vector FROM cal LEFT JOIN z USING (unique_id, ds) GROUP BY 1)"""


def _points(t: Tables) -> DataFrame:
    vectors = clusters.month_vectors(zscore(long_series(t, _CB)))
    return vectors.select(F.col("unique_id").alias("id"), "vector")


@query("knn_self_join", f"""WITH {_VECTORS}, two AS (SELECT id, vector[1:2] AS vector FROM vec)
  SELECT a.id, round(list_sort(list(list_distance(a.vector, b.vector)))[5], 6) AS distance
  FROM two a CROSS JOIN two b GROUP BY 1""")
def _(t):
    two = _points(t).select("id", F.slice("vector", 1, 2).alias("vector"))
    return rounded(pairwise.knn_distance(two, 4), 6, "distance")


@query("knn_distance", f"""WITH {_VECTORS}
  SELECT a.id, round(list_sort(list(list_distance(a.vector, b.vector)))[5], 6) AS distance
  FROM vec a CROSS JOIN vec b GROUP BY 1""")
def _(t):
    return rounded(pairwise.knn_distance(_points(t), 4), 6, "distance")


@query("knn_curve", f"""WITH {_VECTORS}, k AS (SELECT a.id, round(list_sort(list(list_distance(a.vector, b.vector)))[21], 6) AS distance
    FROM vec a CROSS JOIN vec b GROUP BY 1)
  SELECT id, distance, CAST(row_number() OVER (ORDER BY distance, id) AS BIGINT) AS position FROM k""")
def _(t):
    """The sorted distances to the 20th neighbour, from which EPS below is read."""
    far = rounded(pairwise.knn_distance(_points(t), 20), 6, "distance")
    return ordered_position(far, [F.col("distance"), F.col("id")], "position").select("id", "distance", "position")


# Near the lower end of the distances to the 20th neighbour: some series are cores, some border, some noise.
EPS, MIN_POINTS = 8.5, 20


@query("density_clusters", f"""WITH RECURSIVE {_VECTORS},
  near AS (SELECT a.id AS u, b.id AS v FROM vec a CROSS JOIN vec b WHERE list_distance(a.vector, b.vector) <= {EPS}),
  core AS (SELECT u AS id FROM near GROUP BY 1 HAVING count(*) >= {MIN_POINTS}),
  e AS (SELECT u, v FROM near WHERE u IN (FROM core) AND v IN (FROM core)),
  reach(id, r) AS (SELECT id, id FROM core UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.id),
  label AS (SELECT id, min(r) AS component FROM reach GROUP BY 1)
  SELECT vec.id, vec.id IN (FROM core) AS core, coalesce(own.component, near_core.component) AS component
  FROM vec LEFT JOIN label own ON own.id = vec.id
    LEFT JOIN (SELECT near.u, min(label.component) AS component FROM near JOIN label ON label.id = near.v GROUP BY 1) near_core
      ON near_core.u = vec.id""")
def _(t):
    return pairwise.density_clusters(_points(t), EPS, MIN_POINTS)


@query("silhouette", f"""WITH {_VECTORS}, p AS (SELECT id, split_part(id, ',', 1) AS c, vector FROM vec),
  d AS (SELECT a.id, a.c AS mine, b.c AS other, sum(list_distance(a.vector, b.vector)) AS total, count(*) AS n
    FROM p a CROSS JOIN p b GROUP BY 1, 2, 3),
  ab AS (SELECT id, max(CASE WHEN mine = other AND n > 1 THEN total / (n - 1) END) AS a,
    min(CASE WHEN mine <> other THEN total / n END) AS b FROM d GROUP BY 1)
  SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette, count(*) AS n_points FROM ab""")
def _(t):
    labelled = _points(t).withColumn("cluster", F.split("id", ",")[0])
    return rounded(pairwise.silhouette(labelled), 6, "silhouette")

