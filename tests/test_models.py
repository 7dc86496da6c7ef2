"""Clustering, pairwise work and forecasts: brute force on small fixtures, and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import backtest, clusters, forecast, pairwise, segments
from tallyline.operators.features import sku_features
from tallyline.plans.forecast_cycle import forecast_merge


@pytest.fixture(scope="module")
def cloud(spark):
    """Two dense blobs (one holding a third of all points on one spot), a bridge and scattered noise."""
    rng = np.random.default_rng(11)
    xy = np.vstack([np.tile([[0.5, 0.5]], (60, 1)), rng.normal(0, 0.05, (50, 2)), rng.normal(3, 0.05, (50, 2)),
                    rng.uniform(-8, 8, (20, 2))])
    rows = [(f"p{i:03d}", [float(a), float(b)]) for i, (a, b) in enumerate(xy)]
    return xy, spark.createDataFrame(rows, "id string, vector array<double>")


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_knn_against_brute_force(cloud, block_rows):
    xy, points = cloud
    d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), axis=1)
    got = {r["id"]: r["distance"] for r in pairwise.knn_distance(points, 4, block_rows).collect()}
    assert len(got) == len(xy)
    for i in range(len(xy)):
        assert got[f"p{i:03d}"] == pytest.approx(d[i, 4], abs=1e-9)


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_density_clusters_against_brute_force(cloud, block_rows):
    xy, points = cloud
    eps, least = 0.2, 10
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = {i: i for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in label:
            low = min(label[j] for j in label if near[i, j])
            if low < label[i]:
                label[i], changed = low, True
    got = {r["id"]: r for r in pairwise.density_clusters(points, eps, least, block_rows).collect()}
    for i in range(len(xy)):
        row = got[f"p{i:03d}"]
        assert row["core"] == bool(core[i])
        around = [label[j] for j in label if near[i, j]]
        expected = label[i] if core[i] else (min(around) if around else None)
        assert row["component"] == (None if expected is None else f"p{expected:03d}"), i


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_silhouette_against_brute_force(cloud, block_rows):
    xy, points = cloud
    label = np.where(xy[:, 0] > 1.5, "b", "a")
    label[-1] = "alone"
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(xy)):
        own = (label == label[i]).sum()
        if own == 1:
            scores.append(0.0)
            continue
        a = d[i, label == label[i]].sum() / (own - 1)
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        scores.append((b - a) / max(a, b))
    marked = points.join(points.sparkSession.createDataFrame(
        [(f"p{i:03d}", str(c)) for i, c in enumerate(label)], "id string, cluster string"), "id")
    got = pairwise.silhouette(marked, block_rows).first()
    assert got["silhouette"] == pytest.approx(np.mean(scores), abs=1e-9) and got["n_points"] == len(xy)


def test_components_of_chains_and_stars(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(40)] + [("x", "x")]
    got = {r["id"]: r["component"] for r in pairwise.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"c{i:03d}"] for i in range(61)} == {"c000"}
    assert {got["hub"], *(got[f"s{i}"] for i in range(40))} == {"hub"} and got["x"] == "x"


def test_standardise(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "unique_id string, x double, y double")
    got = {r["unique_id"]: (r["x"], r["y"]) for r in clusters.standardise(df, ["x", "y"]).collect()}
    assert got == {"a": (-1.0, 0.0), "b": (1.0, 0.0)}


def test_too_few_series_stay_unlabelled(make_series):
    df = make_series({"a": range(1, 30), "b": range(30)})
    assert {r["cluster"] for r in clusters.feature_clusters(df, "2030-01-01").collect()} == {None}
    features = sku_features(make_series({"a": [0] * 12}))
    assert [r["segment"] for r in segments.statistical_segments(features).collect()] == ["single_cluster"]


def test_segments_cover_every_series(make_series):
    rng = np.random.default_rng(4)
    df = make_series({f"s{i:02d}": list(rng.gamma(2, 20 + 40 * (i % 4), 36)) for i in range(24)} | {"zero": [0] * 36})
    features = sku_features(df)
    for method in ("business_logic", "statistical", "combined"):
        rows = segments.segment_series(features, method).collect()
        assert len({r["unique_id"] for r in rows}) == len(rows) == 25
    statistical = {r["unique_id"]: r["segment"] for r in segments.segment_series(features, "statistical").collect()}
    assert statistical["zero"] == "outlier_cluster"
    again = {r["unique_id"]: r["segment"] for r in segments.segment_series(features, "statistical").collect()}
    assert again == statistical
    business = {r["unique_id"]: r["segment"] for r in segments.business_segments(features).collect()}
    for r in segments.combined_segments(features).collect():
        assert r["segment"].startswith(business[r["unique_id"]])


def test_recommendation_defaults_and_duplicates(spark):
    summary = spark.createDataFrame(
        [("quiet", 9, 0.1, 0.1, 0.0), ("busy", 2, 0.9, 0.5, 0.3)],
        "segment string, sku_count long, avg_cv double, avg_seasonality double, avg_growth_rate double")
    got = {r["segment"]: r["models"] for r in segments.model_recommendation(summary).collect()}
    assert got["quiet"] == ["ARIMA", "Simple Exponential Smoothing"]
    assert len(got["busy"]) == len(set(got["busy"])) == 8


# --- forecasts -----------------------------------------------------------------------------------

FORECASTERS = {
    "seasonal_naive": forecast.seasonal_naive, "linear_trend": forecast.linear_trend,
    "exp_smoothing": forecast.exp_smoothing, "lag_regression": forecast.lag_regression,
    "tree": forecast.tree_forecast, "voting": forecast.voting_forecast,
}


@pytest.mark.parametrize("name", FORECASTERS)
def test_horizon_and_no_duplicates(five_patterns, name):
    rows = FORECASTERS[name](five_patterns, 15).collect()
    assert len(rows) == 75 and len({(r["unique_id"], r["ds"]) for r in rows}) == 75
    assert {(r["ds"].year, r["ds"].month) for r in rows} == {((24300 + i) // 12, (24300 + i) % 12 + 1) for i in range(15)}
    assert all(r[name] is not None and np.isfinite(r[name]) for r in rows)


def test_linear_trend_continues_a_line(make_series):
    got = [r["linear_trend"] for r in forecast.linear_trend(make_series({"a": [3 + 2 * t for t in range(24)]}), 5).orderBy("ds").collect()]
    assert got == pytest.approx([3 + 2 * t for t in range(24, 29)])


def smooth(values, horizon, grid):
    """Plain additive smoothing, for comparison."""
    best = None
    for i, (a, b, g) in enumerate(grid):
        level = np.mean(values[:12])
        trend = (np.mean(values[12:24]) - level) / 12
        season = [v - level for v in values[:12]]
        error = 0.0
        for t, y in enumerate(values[12:]):
            e = y - (level + trend + season[t % 12])
            level, trend, season[t % 12] = level + trend + a * e, trend + b * a * e, season[t % 12] + g * (1 - a) * e
            error += e * e
        ahead = [level + h * trend + season[(len(values) + h - 1) % 12] for h in range(1, horizon + 1)]
        best = min(best, (error, i, ahead)) if best else (error, i, ahead)
    return best[2]


def test_exp_smoothing_against_plain_loop(make_series):
    rng = np.random.default_rng(9)
    data = {f"s{i}": [100 + 3 * t + 20 * np.sin(t / 2 + i) + rng.normal(0, 4) for t in range(n)] for i, n in enumerate((24, 31, 40))}
    rows = forecast.exp_smoothing(make_series(data), 14).orderBy("unique_id", "ds").collect()
    for name, values in data.items():
        assert [r["exp_smoothing"] for r in rows if r["unique_id"] == name] == pytest.approx(smooth(values, 14, forecast.SMOOTHING_GRID))


def test_recursive_forecast_reads_its_own_predictions(make_series):
    df = make_series({"a": [10 + t for t in range(24)], "b": [5 * t for t in range(13)]})
    got = forecast.recursive_forecast(df, lambda rows: rows.withColumn("prediction", F.col("zlag12") * 2), blocks=3)
    for name, values in (("a", [10 + t for t in range(24)]), ("b", [5 * t for t in range(13)])):
        m, s = np.mean(values), np.std(values)
        work = [(v - m) / s for v in values]
        for _ in range(36):
            work.append(work[-12] * 2)
        expected = [w * s + m for w in work[-36:]]
        mine = [r["prediction"] for r in got.filter(F.col("unique_id") == name).orderBy("ds").collect()]
        assert mine == pytest.approx(expected)


def test_short_series_do_not_break(make_series):
    df = make_series({f"n{n}": [1.0 + i for i in range(n)] for n in (1, 6, 12, 13)} | {"long": list(range(1, 40))})
    for name, model in FORECASTERS.items():
        assert model(df, 12).count() == 60, name


def test_ensemble_lies_between_its_models(five_patterns):
    joined = forecast.join_models(forecast.seasonal_naive(five_patterns, 12), forecast.linear_trend(five_patterns, 24))
    rows = forecast.ensemble_mean(joined, ["seasonal_naive", "linear_trend"]).collect()
    assert len(rows) == 120
    for r in rows:
        known = [v for v in (r["seasonal_naive"], r["linear_trend"]) if v is not None]
        assert min(known) - 1e-9 <= r["ensemble"] <= max(known) + 1e-9


def test_clusters_are_fitted_apart(make_series):
    df = make_series({"a": range(30), "b": range(30, 0, -1), "c": range(30)}).withColumn(
        "cluster", F.when(F.col("unique_id") != "c", F.col("unique_id")))
    rows = forecast.cluster_models(df, 3, lags=(1,)).collect()
    assert {(r["unique_id"], r["cluster"]) for r in rows} == {("a", "a"), ("b", "b")} and len(rows) == 6
    step = {(r["unique_id"], r["ds"].month): r["lag_regression"] for r in rows}
    assert step["a", 7] > 25 and step["b", 7] < 6


def test_lag_regression_without_complete_rows(make_series):
    rows = forecast.lag_regression(make_series({"a": range(5)}), 3).collect()
    assert [r["lag_regression"] for r in rows] == [None] * 3


def test_merge_keeps_history_unchanged(spark):
    history = spark.sql("select 'x,a' unique_id, timestamp_ntz'2024-01-01' sales_date, 1.0D v, 'k' cluster, 9.0D model "
                        "union all select 'x,b', timestamp_ntz'2024-01-01', 2.0D, null, 9.0D")
    fc = spark.sql("select 'x,a' unique_id, timestamp_ntz'2024-02-01' sales_date, 5.0D model")
    merged = forecast_merge(history, fc, ["model"])
    assert sorted((r["unique_id"], r["v"], r["model"], r["cluster"]) for r in merged.collect() if r["v"]) == [("x,a", 1.0, None, "k")]
    assert [(r["model"], r["cluster"]) for r in merged.collect() if r["model"]] == [(5.0, "k")]
    assert forecast_merge(history, fc, ["model"], keep_unforecast=True).count() == 3


def test_backtest_scores_only_the_holdout(five_patterns):
    scored = backtest.backtest(five_patterns, forecast.seasonal_naive, "2025-01-15", "seasonal_naive", origins=2)
    assert scored.count() == 60
    errors = {r["origin"]: r for r in backtest.error_metrics(scored, "actual", "forecast", ["origin"]).collect()}
    assert errors[0]["n"] == errors[1]["n"] == 30 and errors[0]["rmse"] >= errors[0]["mae"] > 0


def test_error_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 3.0), (4.0, None)], "a double, f double")
    row = backtest.error_metrics(df, "a", "f").first()
    assert (row["n"], row["mae"], row["mse"], row["mape"]) == (2, 2.0, 5.0, 1.0)


def test_robust_scale_inverts(make_series):
    df = make_series({"a": [1, 2, 3, 10], "flat": [4, 4]})
    for r in forecast.robust_scale(df).collect():
        assert r["scaled"] * r["scale"] + r["centre"] == pytest.approx(r["y"])
