from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.operators import combine, filters
from tallyline.sources import files, history
from tallyline.sources.extract import Selection, Star, extract_count, star_extract


@pytest.fixture(scope="module")
def overlap(spark):
    old = spark.sql("select 'a' k, timestamp_ntz'2024-01-01' sales_date, 1.0D v union all "
                    "select 'a', timestamp_ntz'2024-03-01', 3.0D union all select 'b', timestamp_ntz'2024-05-01', 5.0D")
    new = spark.sql("select 'a' k, timestamp_ntz'2024-03-01' sales_date, 30.0D v union all "
                    "select 'a', timestamp_ntz'2024-06-01', 60.0D")
    return old, new


def test_append_keeps_the_overlap_twice(overlap):
    got = history.history_refresh(*overlap, "2024-06-20", mode="append")
    assert sorted(r["v"] for r in got.collect()) == [1.0, 3.0, 30.0, 60.0]


def test_replace_window_takes_each_month_once(overlap):
    got = history.history_refresh(*overlap, "2024-06-20")
    assert sorted(r["v"] for r in got.collect()) == [1.0, 30.0, 60.0]


def test_replace_window_with_an_empty_extract_keeps_everything(overlap):
    old, new = overlap
    assert history.history_refresh(old, new.filter("false"), "2024-06-20").count() == 3


def test_first_refresh_is_the_extract(overlap):
    assert history.history_refresh(None, overlap[1], "2024-06-20").count() == 2
    with pytest.raises(ValueError):
        history.history_refresh(*overlap, "2024-06-20", mode="other")


def test_duplicate_hierarchy_rows_do_not_multiply(spark):
    facts = spark.createDataFrame([("p1", 1.0), ("p2", 2.0)], "catalog_number string, y double")
    levels = spark.createDataFrame([("p1", "Old name"), ("p1", "New name")], "catalog_number string, product_line string")
    got = combine.hierarchy_left_join(facts, levels)
    assert sorted((r["catalog_number"], r["product_line"]) for r in got.collect()) == [("p1", "New name"), ("p2", None)]


def test_star_leaves_out_old_versions_and_unmatched_rows(spark):
    fact = spark.sql("select 1 item_skey, 1 location_skey, 1 matrix_skey, timestamp_ntz'2024-05-01' sales_date, 2.0D m "
                     "union all select 1, 1, 9, timestamp_ntz'2024-05-01', 5.0D "
                     "union all select 1, 1, 1, timestamp_ntz'2020-05-01', 7.0D")
    product = spark.sql("select 1 product_skey, 'p' name, 'True' current union all select 1, 'old', 'False'")
    location = spark.sql("select 1 loc_skey, 'EU' region")
    star = Star(fact, product, location, spark.sql("select 1 mdp_key"))
    chosen = Selection("2024-06-15", location={"region": ["EU"]}, product={"name": ["p", "old"]})
    assert [tuple(r) for r in star_extract(star, chosen, ["name", "region"], ["m"]).collect()] == [("p", "EU", 2.0)]
    assert extract_count(star, chosen, ["name", "region"]).first()[0] == 1


def test_files_round_trip(spark, tmp_path):
    df = spark.sql("select 'x/y' k, timestamp_ntz'2024-01-01' d, 1.5D v union all select null, null, null")
    files.write_parquet(df, f"{tmp_path}/p", ["k"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    files.write_json(df, f"{tmp_path}/j")
    assert sorted(map(str, files.read_json(spark, f"{tmp_path}/j", df.schema).collect())) == sorted(map(str, df.collect()))
    files.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(str, files.read_csv(spark, f"{tmp_path}/c", df.schema).collect())) == sorted(map(str, df.collect()))


def test_remote_reader_needs_bounds(spark):
    with pytest.raises(ValueError):
        files.remote_reader(spark, {"url": "jdbc:none"}, "select 1", partition_column="k")
    assert files.remote_reader(spark, {"url": "jdbc:none"}, "select 1", "k", ("0", "9"), 4) is not None


def test_search_and_exclusion(spark):
    df = spark.createDataFrame([("a2",), ("a10",), ("B1",), (None,)], "v string")

    def found(text):
        return sorted(r["value"] for r in filters.value_search(df, "v", text).collect())

    assert found("> A2") == ["B1", "a10", "null"] and found("<=a2") == ["a2"]
    assert found("~^[ab]1") == ["B1", "a10"] and found("NUL") == ["null"] and len(found(">=")) == 4
    assert filters.exclude_values(df, {"v": ["null", "a2"]}).count() == 2
    assert filters.drill_through(df, {"v": "null"}).count() == 1


def test_derive_keeps_the_value_where_the_result_is_null(spark):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    got = filters.derive(df, {"v": F.when(F.col("v") == "x", "new")})
    assert sorted(r["v"] for r in got.collect()) == ["new", "y"]


def test_unions(spark):
    a, b = spark.sql("select 1 x, 'p' y"), spark.sql("select 2.5D x, 'q' z")
    wide = combine.union_diagonal(a, b)
    assert dict(wide.dtypes) == {"x": "double", "y": "string", "z": "string"} and wide.count() == 2
    with pytest.raises(ValueError):
        combine.union_strict(a, b)


def test_null_keys_do_not_match(spark):
    a, b = spark.sql("select cast(null as string) k, 1 l"), spark.sql("select cast(null as string) k, 2 r")
    assert combine.full_merge(a, b, ["k"]).count() == 2


def test_star_measures_are_computed_after_the_joins(spark):
    from tallyline.plans.catalog_sources import SELECTION, STAR_KEYS, STAR_MEASURES, order_star
    from tallyline.sources.extract import star_extract
    from tallyline.sources.tables import Tables

    star = order_star(Tables(spark, "/root/testdata/sf0.001"))
    assert not set(star.fact.columns) & set(STAR_MEASURES)
    assert set(STAR_MEASURES) <= set(star_extract(star, SELECTION, STAR_KEYS, STAR_MEASURES).columns)


def test_tasks_that_join_orders_hold_a_bounded_number_of_lines(spark, monkeypatch):
    from tallyline.sources import tables

    def lines(task_rows):
        monkeypatch.setattr(tables, "TASK_ROWS", task_rows, raising=False)
        return tables.sales_lines(tables.Tables(spark, "/root/testdata/sf0.001"), ["region", "franchise", "status"])

    def largest(frame):
        return frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        whole, dealt = lines(1_000_000), lines(250)  # some 6,000 lines
        assert "REPARTITION_BY_NUM" not in whole._jdf.queryExecution().executedPlan().toString()
        assert largest(dealt) < 500 < largest(whole)
        assert dealt.exceptAll(whole).count() == 0 and whole.exceptAll(dealt).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
