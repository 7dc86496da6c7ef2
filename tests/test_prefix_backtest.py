from __future__ import annotations

import random

import pytest

from tallyline.operators import backtest, forecast, prefix_backtest
from tests.conftest import months


@pytest.fixture(scope="module")
def series(spark):
    draw = random.Random(3)
    rows = []
    for i in range(14):
        # One constant series, one short, one that ends early, one with gaps and nulls.
        length = {1: 9, 2: 40}.get(i, 60)
        for t, day in enumerate(months(length, (2018, 1))):
            if i == 3 and t % 7 == 0:
                continue
            y = 5.0 if i == 4 else 1000 * i + 100 * (t % 12) + 5 * t + draw.random() * 50
            rows.append((f"s{i}", day, None if i == 5 and t % 11 == 0 else y))
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def as_map(table):
    return {(r["origin"], r["unique_id"], r["ds"]): (r["actual"], r["forecast"]) for r in table.collect()}


@pytest.mark.parametrize("lags", [(1, 12), forecast.LAGS])
def test_equals_a_fit_per_origin(series, lags):
    refitted = as_map(backtest.backtest(
        series, lambda df, h: forecast.lag_regression(df, h, lags), "2023-01-10", "lag_regression", origins=3, pooled=True))
    table, weights = prefix_backtest.backtest_prefix(series, "2023-01-10", origins=3, lags=lags)
    found = as_map(table)
    assert found.keys() == refitted.keys() and weights.count() == 3
    for k, (actual, value) in refitted.items():
        assert found[k][0] == actual and found[k][1] == pytest.approx(value, rel=1e-9, abs=1e-7), k


def test_window_of_months_equals_a_fit_on_the_window(spark, series):
    """Without lags beyond it, a window's fit is a fit on the window's rows."""
    full = series.filter("unique_id in ('s6', 's7', 's8', 's9')")
    _, weights = prefix_backtest.backtest_prefix(full, "2023-01-10", origins=2, months=24, lags=(1,))
    import numpy as np

    rows = sorted((r["unique_id"], r["ds"], r["y"]) for r in full.collect())
    for w in weights.collect():
        last = (2022 * 12 + 6 - 6 * w["origin"]) - 1  # cut-off months: 2022-06 and 2021-12
        pairs = []
        for key in {k for k, _, _ in rows}:
            own = [(d.year * 12 + d.month - 1, y) for k, d, y in rows if k == key]
            inside = np.array([y for m, y in own if last - 24 < m <= last])
            c, s = inside.mean(), inside.std()
            by_month = dict(own)
            pairs += [((by_month[m - 1] - c) / s, (by_month[m] - c) / s) for m in range(last - 23, last + 1)]
        x, y = np.array(pairs).T
        slope = (np.mean(x * y) - x.mean() * y.mean()) / (x.var() * (1 + forecast.RIDGE))
        assert w["weights"][0] == pytest.approx(slope, rel=1e-8)
        assert w["intercept"] == pytest.approx(y.mean() - slope * x.mean(), abs=1e-8)


def test_jobs_do_not_grow_with_origins(spark, series):
    """Twelve origins read the series as often as one."""
    def jobs(origins):
        tag = f"origins{origins}"
        spark.sparkContext.setJobGroup(tag, tag)
        try:
            table, _ = prefix_backtest.backtest_prefix(series, "2023-01-10", origins=origins, step=1)
            assert table.select("origin").distinct().count() == origins
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
        finally:
            spark.sparkContext.setJobGroup("other", "other")

    assert jobs(12) <= jobs(1) + 2
