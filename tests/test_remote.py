from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyline.sources import remote

PARQUET = "tallyline.sources.remote:ParquetBatches"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("remote")
    for part in range(2):
        rows = range(part * 500, part * 500 + 500)
        pq.write_table(pa.table({
            "id": pa.array(rows, pa.int64()), "day": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in rows],
            "name": [None if i % 7 == 0 else f"n{i % 5}" for i in rows], "x": [i / 3 for i in rows],
        }), path / f"{part}.parquet", row_group_size=100)
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_task_per_batch(spark, folder):
    df = remote.read_batches(spark, PARQUET, {"path": folder})
    assert df.columns == ["id", "day", "name", "x"] and df.rdd.getNumPartitions() == 10
    assert df.count() == 1000
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, spark.read.parquet(folder).collect()), key=str)


@pytest.mark.parametrize("condition", [
    "id >= 730", "day = date'2020-03-01'", "id < 120 and name = 'n3'", "name in ('n1', 'n2') and x > 300.5", "name is null",
    "id = -1", "id > 10 and id <= 20 and name is not null", "id < 5 or id > 990", "name like 'n3%'", "id <=> 7", "not (id > 100)",
])
def test_filters_equal_spark(spark, folder, condition):
    mine = remote.read_batches(spark, PARQUET, {"path": folder}, ["id", "name", "day", "x"]).filter(condition)
    other = spark.read.parquet(folder).filter(condition)
    assert sorted(r["id"] for r in mine.collect()) == sorted(r["id"] for r in other.collect())


def test_filters_reach_the_client(spark, folder):
    df = remote.read_batches(spark, PARQUET, {"path": folder}, ["id", "x"]).filter((F.col("id") >= 730) & (F.col("id") < 810))
    assert " Filter " not in plan(df)  # nothing is left for Spark to test
    described = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"Pushed.*730", described), described
    assert df.rdd.getNumPartitions() == 2 and df.columns == ["id", "x"] and df.count() == 80


class Handed(remote.BatchClient):
    """A client that says what it was asked for."""

    def schema(self):
        return pa.schema([("asked", pa.string()), ("a", pa.int64()), ("b", pa.string())])

    def batches(self, conditions):
        return [1, 2]

    def fetch(self, handle, columns, conditions):
        asked = " ".join(f"{c}{op}{v}" for c, op, v in sorted(conditions, key=str))
        whole = {"asked": [asked], "a": [handle], "b": ["x"]}
        yield pa.RecordBatch.from_pydict({c: whole[c] for c in columns}, schema=pa.schema([self.schema().field(c) for c in columns]))


def test_any_client(spark):
    df = remote.read_batches(spark, "tests.test_remote:Handed", {}, ["asked", "a"])
    assert sorted(r["a"] for r in df.collect()) == [1, 2]
    told = remote.read_batches(spark, "tests.test_remote:Handed", {}).filter("a > 0 and b in ('x', 'y') and b like '%x'")
    rows = told.collect()
    assert len(rows) == 2 and all("a>0" in r["asked"] and "bin" in r["asked"] for r in rows)


def connect():
    import duckdb

    return duckdb.connect()


def test_query_in_ranges(spark, folder):
    """An embedded database stands for the remote one: each process opens its own, over the same files."""
    options = {"connect": "tests.test_remote:connect", "split": "id", "low": "0", "high": "999", "parts": "4",
               "query": f"SELECT CASE WHEN id = 3 THEN NULL ELSE id END AS id, name, x FROM read_parquet('{folder}/*.parquet')"}
    df = remote.read_batches(spark, "tallyline.sources.remote:QueryBatches", options)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000
    assert df.filter("x < 2").count() == 6  # with the row without an id
    assert df.filter("name = 'n2' and id >= 400").count() == spark.read.parquet(folder).filter("name = 'n2' and id >= 400").count()
