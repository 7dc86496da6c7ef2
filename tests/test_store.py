from __future__ import annotations

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from tallyline.sources import store

SCHEMA = "sales_date timestamp_ntz, k string, v double"


def day(month: int, year: int = 2022):
    return dt.datetime(year, month, 1)


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(day(m), k, float(m)) for m in range(1, 9) for k in "ab"] + [(None, "none", 0.0)]
    store.create(spark.createDataFrame(rows, SCHEMA), path)
    return path


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def rows(spark, path, **limits):
    return sorted((str(r["sales_date"]), r["k"], r["v"]) for r in store.read(spark, path, **limits).collect())


def test_only_the_months_of_the_extract_are_rewritten(spark, stored):
    before, old = files(stored), rows(spark, stored)
    # Months 5 and 7 are new, 6 lies between them without rows, 9 did not exist.
    extract = spark.createDataFrame([(day(5), "a", 50.0), (day(7), "c", 70.0), (day(9), "a", 90.0)], SCHEMA)
    assert store.refresh(spark, stored, extract) == [202205, 202207, 202209]
    after = files(stored)
    kept = {n: t for n, t in before.items() if not any(f"=20220{m}" in n for m in (5, 6, 7, 8))}
    assert {n: t for n, t in after.items() if n in before} == kept  # same names, never written again
    assert {n.split("/")[0] for n in set(after) - set(before)} == {f"stored_month=20220{m}" for m in (5, 7, 9)}
    fresh = [(str(day(m)), k, v) for m, k, v in ((5, "a", 50.0), (7, "c", 70.0), (9, "a", 90.0))]
    assert rows(spark, stored) == sorted([r for r in old if r[0] < str(day(5)) or r[0] == "None"] + fresh)


def test_a_failed_refresh_leaves_the_old_rows(spark, stored):
    before, old = files(stored), rows(spark, stored)
    broken = spark.createDataFrame([(day(m), "a", 1.0) for m in range(3, 9)], SCHEMA).withColumn(
        "v", F.when(F.col("sales_date") == F.lit("2022-08-01").cast("timestamp_ntz"), F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        store.refresh(spark, stored, broken.repartition(6))
    assert files(stored) == before and rows(spark, stored) == old
    # Also when the writing itself fails.
    with pytest.raises(Exception, match="lost"):
        store._written(broken.repartition(6), stored, "sales_date")
    assert files(stored) == before and rows(spark, stored) == old


def test_readers_prune_by_month(spark, stored):
    some = store.read(spark, stored, first="2022-03-15", last="2022-04-01")
    assert sorted({r["sales_date"].month for r in some.collect()}) == [3, 4]
    text = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stored_month" in text
    assert store.months(spark, stored) == [202200 + m for m in range(1, 9)]


def test_empty_extract_and_rows_without_a_date(spark, stored):
    old = rows(spark, stored)
    assert store.refresh(spark, stored, spark.createDataFrame([], SCHEMA)) == []
    assert rows(spark, stored) == old
    store.refresh(spark, stored, spark.createDataFrame([(None, "other", 1.0)], SCHEMA))
    assert rows(spark, stored) == sorted([r for r in old if r[0] != "None"] + [("None", "other", 1.0)])


def test_no_store_yet(spark, tmp_path):
    path = str(tmp_path / "fresh")
    assert store.months(spark, path) == []
    assert store.refresh(spark, path, spark.createDataFrame([(day(1), "a", 1.0)], SCHEMA)) == [202201]
