from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.functions import dates, numeric, text
from tallyline.names import to_display, to_internal


def values(spark, kind, items, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in frame.select("i", column.alias("o")).orderBy("i").select("o").collect()]


def test_lenient_number(spark):
    got = values(spark, "string", ["12abc", " 7", "x", None, "1e3", "-.5z", "+4.", "", "Infinityx"],
                 numeric.lenient_number("v"))
    assert got == [12.0, 7.0, None, None, 1000.0, -0.5, 4.0, None, math.inf]


def test_safe_div_and_corr_on_degenerate_input(spark):
    frame = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "a double, b double")
    row = frame.agg(numeric.safe_corr("a", "b").alias("c"), numeric.safe_corr("b", "b").alias("d")).first()
    assert row["c"] is None and row["d"] == pytest.approx(1.0)
    assert values(spark, "double", [0.0, 2.0, None], numeric.safe_div(F.lit(1.0), "v")) == [None, 0.5, None]


def test_correlation_uses_complete_pairs_only(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, 1.0), (9.0, 2.0), (None, 50.0)], "a double, b double")
    assert frame.agg(numeric.safe_corr("a", "b")).first()[0] == pytest.approx(1.0)


def test_repairs(spark):
    items = [None, float("nan"), math.inf, -math.inf, 3.0]
    assert values(spark, "double", items, numeric.finite_or_zero("v")) == [0.0, 0.0, 0.0, 0.0, 3.0]
    assert values(spark, "double", items, numeric.nan_to_zero("v")) == [None, 0.0, math.inf, -math.inf, 3.0]
    assert values(spark, "double", [None, 2.0], numeric.null_to_zero("v")) == [0.0, 2.0]


def test_bin_number_keeps_the_sign_of_the_remainder(spark):
    assert values(spark, "int", [13, -13, 0], numeric.bin_number("v", 5)) == [10, -10, 0]
    with pytest.raises(ValueError):
        numeric.bin_number("v", 0)


def test_row_mean_ignores_nulls(spark):
    frame = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in frame.select(numeric.row_mean("a", "b", "c")).collect()] == [2.0, None]


def test_score_bound_is_null_when_undefined(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (50.0, 1.0), (5.0, 10.0)], "a double, n double")
    up = [r[0] for r in frame.select(numeric.score_bound(F.col("a"), F.col("n"), True)).collect()]
    low = [r[0] for r in frame.select(numeric.score_bound(F.col("a"), F.col("n"), False)).collect()]
    assert up[0] is None and up[1] is None and low[2] < 0.5 < up[2]
    z, p, n = numeric.SCORE_Z, 0.5, 10
    expected = (z * z / (2 * n) + p + z * math.sqrt(z * z / (4 * n * n) + p * (1 - p) / n)) / (1 + z * z / n)
    assert up[2] == pytest.approx(expected, rel=1e-12)


def test_natural_order(spark):
    items = ["a2", "a10", "a02", "10", "9", None, "B1", "", "2.5", "NaN"]
    frame = spark.createDataFrame([(v,) for v in items], "v string")
    got = [r[0] for r in frame.orderBy(text.natural_key("v")).collect()]
    assert got == [None, "NaN", "", "2.5", "9", "10", "B1", "a02", "a2", "a10"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 10**12), min_size=1, max_size=20, unique=True))
def test_natural_order_of_numbered_names(spark, numbers):
    frame = spark.createDataFrame([(f"item {n} x",) for n in numbers], "v string")
    got = [r[0] for r in frame.orderBy(text.natural_key("v")).collect()]
    assert got == [f"item {n} x" for n in sorted(numbers)]


def test_custom_order(spark):
    frame = spark.createDataFrame([(v,) for v in ["red", "Blue", "GREEN", "a10", "a2", "blue"]], "v string")
    got = [r[0] for r in frame.orderBy(text.custom_order("v", ["Blue", "Red"])).collect()]
    # 'Blue' is listed; 'blue' and 'red' equal a listed value in lower case; the rest is natural.
    assert got == ["Blue", "blue", "red", "GREEN", "a2", "a10"]


def test_number_display(spark):
    items = [1234567.891, 0.125, -0.125, None, float("nan"), math.inf, 1.005]
    assert values(spark, "double", items, text.number_display("v")) == [
        "1,234,567.89", "0.13", "-0.13", "", "", "", "1.00"]
    assert values(spark, "double", [0.256], text.number_display("v", 1, 100, suffix="%")) == ["25.6%"]
    assert values(spark, "double", [1234.5], text.number_display("v", 2, thousands=".", decimal=",")) == ["1.234,50"]
    assert values(spark, "double", [2.5, -2.5], text.number_display("v", 0)) == ["3", "-3"]


def test_keys(spark):
    frame = spark.createDataFrame([("A", "x,y"), (None, "z")], "c string, k string")
    keyed = frame.select(text.key_concat("c", "k").alias("u"))
    assert [r[0] for r in keyed.collect()] == ["A,x,y", None]
    assert [tuple(r) for r in keyed.select(*text.key_split("u", ["a", "b"])).collect()] == [("A", "x,y"), (None, None)]


def test_date_tokens(spark):
    items = ["2024-02-05 07:08:09", "nonsense", None]
    got = values(spark, "string", items, dates.date_tokens("v", "%y/%m/%d %n %w %x %H:%M:%S %%z"))
    assert got == ["2024/02/05 Feb Mon 1 07:08:09 %%z", "", ""]


def test_month_functions(spark):
    frame = spark.sql("select timestamp_ntz'2024-01-31 10:00:00' d, timestamp_ntz'2024-03-01' e")
    row = frame.select(
        dates.add_months("d", 1).alias("clipped"), dates.month_start("d").alias("start"),
        F.size(dates.month_sequence(dates.month_start("d"), F.col("e"))).alias("n"),
        F.size(dates.month_sequence(F.col("e"), dates.month_start("d"))).alias("none"),
        dates.last_full_month("2024-03-15").alias("last"), dates.days_since("e").alias("days")).first()
    assert str(row["clipped"]) == "2024-02-29 00:00:00" and str(row["start"]) == "2024-01-01 00:00:00"
    assert (row["n"], row["none"], str(row["last"])) == (3, 0, "2024-02-01 00:00:00")
    assert row["days"] == 1155
    assert dict(frame.select(dates.month_start("d").alias("m")).dtypes)["m"] == "timestamp_ntz"


def test_headings_round_trip(spark):
    frame = spark.createDataFrame([(1.0, "x")], "`act_orders_rev` double, `ibp_level_5` string")
    shown = to_display(frame)
    assert shown.columns == ["`Act Orders Rev", "IBP Level 5"]
    assert to_internal(shown).columns == frame.columns


@settings(max_examples=15, deadline=None)
@given(st.floats(-1e6, 1e6, allow_nan=False))
def test_volume_band_matches_its_limits(spark, x):
    got = values(spark, "double", [x], numeric.volume_band("v"))[0]
    assert got == ("low" if x < 100 else "medium" if x < 1000 else "high")


def test_text_without_digits_compares_raw(spark):
    frame = spark.createDataFrame([("Hip2",), ("Hip system",), ("a1",), ("a!",), ("Hip10",)], "v string")
    got = [r[0] for r in frame.orderBy(text.natural_key("v")).collect()]
    assert got == ["Hip system", "Hip2", "Hip10", "a!", "a1"]
