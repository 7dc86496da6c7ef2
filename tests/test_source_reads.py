"""Queries that use their history several times compute it from the order lines once."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tallyline.operators import clusters
from tallyline.plans import catalog_forecast
from tallyline.plans.registry import AS_OF
from tallyline.sources.tables import Tables, long_series

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark):
    """A function that passes a table through and counts the rows that are computed, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def passed(df):
        def count(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return df.mapInPandas(count, df.schema)

    return passed, seen


@pytest.mark.parametrize("name, source", [("forecast_cycle_scores", "_history"), ("backtest_models", "long_series")])
def test_scores_compute_the_history_once(spark, counted, monkeypatch, name, source):
    passed, seen = counted
    original, rows = getattr(catalog_forecast, source), []

    def instead(*args):
        rows.append(original(*args).count())
        return passed(original(*args))

    monkeypatch.setattr(catalog_forecast, source, instead)
    assert entry.queries()[name](spark, FOLDER).collect()
    assert seen.value == sum(rows) > 0


@pytest.mark.parametrize("label", [clusters.shape_clusters, clusters.feature_clusters])
def test_labels_compute_the_history_once(spark, counted, label):
    passed, seen = counted
    series = long_series(Tables(spark, FOLDER), ["country", "franchise"])
    rows = series.count()
    assert label(passed(series), AS_OF).count() == rows
    assert seen.value == rows
