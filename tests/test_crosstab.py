from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators.crosstab import AGGREGATORS, bar_scale, crosstab, heatmap_scale, ordered, to_wide
from tallyline.operators.quantiles import grouped_quantiles
from tallyline.operators import user_aggregates
from tallyline.operators.ranking import ordered_position
from tallyline.operators.user_aggregates import GeometricMean, Mode, UserAggregator, partial_states


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("n", "a", "12abc", 1.0, 2.0), ("n", "a", " 7", 2.0, 4.0), ("n", "b", "x", 3.0, 0.0),
            (None, "a", None, 4.0, 1.0), ("s", "b", "1e3", float("nan"), 1.0), ("s", "b", "2", None, None)]
    return spark.createDataFrame(rows, "r string, c string, t string, v double, w double")


def cells(table, value="value"):
    return {(r["r"], r["c"], r["level"]): r[value] for r in table.collect()}


def test_there_are_22_named_aggregators():
    assert len(AGGREGATORS) == 22


def test_every_cell_and_total(sales):
    got = cells(crosstab(sales, ["r"], ["c"]))
    assert got == {
        ("n", "a", 0): 2, ("n", "b", 0): 1, ("null", "a", 0): 1, ("s", "b", 0): 2,
        ("n", None, 1): 3, ("null", None, 1): 1, ("s", None, 1): 2,
        (None, "a", 2): 3, (None, "b", 2): 3, (None, None, 3): 6,
    }


def test_lenient_sum_counts_text_numbers(sales):
    got = cells(crosstab(sales, ["r"], ["c"], ["t"], "Sum"), "t")
    assert got[("n", "a", 0)] == 19.0 and got[("n", "b", 0)] == 0.0 and got[("s", "b", 0)] == 1002.0
    assert got[(None, None, 3)] == 1021.0


def test_missing_numbers(sales):
    assert cells(crosstab(sales, ["r"], ["c"], ["v"], "Average"), "v")[("s", "b", 0)] is None
    assert cells(crosstab(sales, ["r"], ["c"], ["v"], "Maximum"), "v")[(None, None, 3)] == 4.0
    median = cells(crosstab(sales, ["r"], ["c"], ["v"], "Median"), "v")
    assert median[("s", "b", 0)] is None and median[(None, None, 3)] == 2.5 and len(median) == 10
    var = cells(crosstab(sales, ["r"], ["c"], ["v"], "Sample Variance"), "v")
    assert var[("n", "b", 0)] == 0.0 and var[("s", "b", 0)] == 0.0 and var[("n", "a", 0)] == pytest.approx(0.5)


def test_unique_values_count_null_once(sales):
    got = cells(crosstab(sales, ["r"], ["c"], ["t"], "Count Unique Values"), "t")
    assert got[("null", "a", 0)] == 1 and got[(None, None, 3)] == 6
    listed = cells(crosstab(sales, ["r"], ["c"], ["t"], "List Unique Values"), "t")
    assert listed[("n", "a", 0)] == " 7, 12abc"


def test_first_and_last_follow_the_sorter(sales):
    first = cells(crosstab(sales, ["r"], [], ["t"], "First", sorters={"t": ["x", "12abc"]}).withColumn("c", F.lit(None)), "t")
    last = cells(crosstab(sales, ["r"], [], ["t"], "Last").withColumn("c", F.lit(None)), "t")
    assert first[("n", None, 1)] == "x" and last[("n", None, 1)] == "x"
    assert first[("s", None, 1)] == "2" and last[("s", None, 1)] == "1e3"


def test_shares_add_up(sales):
    for name in ("Sum as Fraction of Total", "Sum as Fraction of Rows", "Sum as Fraction of Columns"):
        got = cells(crosstab(sales, ["r"], ["c"], ["w"], name), "w")
        inside = {k: v for k, v in got.items() if k[2] == 0}
        if name.endswith("Total"):
            assert sum(inside.values()) == pytest.approx(1.0)
        elif name.endswith("Rows"):
            assert inside[("n", "a", 0)] + inside[("n", "b", 0)] == pytest.approx(1.0)
            assert got[("n", None, 1)] == 1.0 and got[(None, "a", 2)] == pytest.approx(7 / 8)
        else:
            assert inside[("n", "a", 0)] + inside[("null", "a", 0)] == pytest.approx(1.0)
            assert got[(None, "a", 2)] == 1.0


def test_totals_are_sums_of_cells(sales):
    got = cells(crosstab(sales, ["r"], ["c"], ["w"], "Sum"), "w")
    assert got[(None, None, 3)] == sum(v for k, v in got.items() if k[2] == 0)
    assert got[(None, None, 3)] == sum(v for k, v in got.items() if k[2] == 1) == sum(v for k, v in got.items() if k[2] == 2)


def test_filter_derived_and_user_aggregator(sales):
    table = crosstab(sales, ["r"], ["size"], ["w"], lambda w: F.max(w) - F.min(w),
                     predicate=F.col("r").isNotNull(), derived={"size": F.when(F.col("w") > 1, "big").otherwise("small")})
    got = {(r["r"], r["size"], r["level"]): r["value"] for r in table.collect()}
    assert got[("n", "big", 0)] == 2.0 and (("null", "big", 0) not in got)


def test_without_keys(sales):
    assert crosstab(sales).collect()[0]["value"] == 6


def test_rejects_missing_inputs(sales):
    with pytest.raises(ValueError):
        crosstab(sales, ["r"], ["c"], [], "Sum")
    with pytest.raises(ValueError):
        crosstab(sales, ["r"], ["c"], ["v"], "Sum over Sum")
    with pytest.raises(ValueError):
        crosstab(sales, ["r"], ["c"], ["v"], "No such")


def test_order_and_scales(sales):
    table = crosstab(sales, ["r"], ["c"], ["w"], "Sum")
    ranks = {r["r"]: r["row_rank"] for r in ordered(table, ["r"], ["c"], "w", "value_z_to_a").filter("level = 1").collect()}
    assert ranks == {"n": 1, "null": 2, "s": 3}
    shade = cells(heatmap_scale(table, ["r"], ["c"], "w"), "shade")
    assert shade[("n", "a", 0)] == 0 and shade[("n", "b", 0)] == 255 and shade[(None, None, 3)] is None
    by_row = cells(heatmap_scale(table, ["r"], ["c"], "w", "row"), "shade")
    assert by_row[("null", "a", 0)] is None  # one value: no range
    shifted = table.withColumn("w", F.col("w") - 2)
    bars = {(r["r"], r["c"]): (r["bar_base"], r["bar_height"]) for r in bar_scale(shifted, ["r"], ["c"], "w").filter("level = 0").collect()}
    assert bars[("n", "a")][1] == pytest.approx(100 * 4 / (1.4 * 6)) and bars[("n", "b")][0] == pytest.approx(0.0)


def test_wide_form_of_given_keys(sales):
    table = crosstab(sales, ["r"], ["c"])
    assert to_wide(table, ["r"], "c", "value", ["b", "a"]).columns == ["r", "b", "a"]


@pytest.mark.parametrize("bucket_rows", [7, 10**6])
@pytest.mark.parametrize("mode", ["linear", "neighbours", "nearest"])
def test_quantiles_against_numpy(spark, mode, bucket_rows):
    rng = np.random.default_rng(1)
    groups = {  # one hot group, one of few values, one single row
        "hot": np.round(rng.normal(0, 1, 4000), 3), "few": rng.integers(0, 3, 500).astype(float), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"q10": 0.1, "q50": 0.5, "q80": 0.8}
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", wanted, mode, bucket_rows).collect()}
    for g, values in groups.items():
        s = np.sort(values)
        for name, q in wanted.items():
            p = (len(s) - 1) * q
            low, high = s[int(np.floor(p))], s[int(np.ceil(p))]
            expected = {"linear": low + (high - low) * (p - np.floor(p)), "neighbours": (low + high) / 2,
                        "nearest": s[int(np.floor(p + 0.5))]}[mode]
            assert got[g][name] == pytest.approx(expected, abs=1e-12), (g, name)


def test_ordered_position_spans_partitions(spark):
    df = spark.range(1000).selectExpr("id", "cast((id * 7919) % 1000 as int) k").repartition(7)
    got = {r["k"]: r["p"] for r in ordered_position(df, [F.col("k")], "p").collect()}
    assert got == {k: k + 1 for k in range(1000)}


class _Spread(UserAggregator):
    """Two inputs and a state of several fields: largest difference of two columns, and rows seen."""

    inputs, state, result = 2, "top double, n long, seen array<double>", "string"

    def push(self, state, one, other):
        gaps = (one - other).dropna()
        before = state or {"top": None, "n": 0, "seen": []}
        tops = [x for x in (before["top"], gaps.max() if len(gaps) else None) if x is not None]
        return {"top": max(tops, default=None), "n": before["n"] + len(one), "seen": sorted({*before["seen"], *gaps})}

    def merge(self, a, b):
        tops = [x for x in (a["top"], b["top"]) if x is not None]
        return {"top": max(tops, default=None), "n": a["n"] + b["n"], "seen": sorted({*a["seen"], *b["seen"]})}

    def value(self, state):
        return f"{state['top']}/{state['n']}/{len(state['seen'])}"


@pytest.mark.parametrize("partitions", [1, 7])
def test_user_aggregator_with_state(sales, partitions):
    got = cells(crosstab(sales.repartition(partitions), ["r"], ["c"], ["v", "w"], _Spread()))
    assert got == {
        ("n", "a", 0): "-1.0/2/2", ("n", "b", 0): "3.0/1/1", ("null", "a", 0): "3.0/1/1", ("s", "b", 0): "None/2/0",
        ("n", None, 1): "3.0/3/3", ("null", None, 1): "3.0/1/1", ("s", None, 1): "None/2/0",
        (None, "a", 2): "3.0/3/3", (None, "b", 2): "3.0/3/1", (None, None, 3): "3.0/6/3",
    }


def test_user_aggregator_without_columns_or_rows(spark, sales):
    total = crosstab(sales, [], [], ["v"], GeometricMean()).collect()
    assert len(total) == 1 and total[0]["v"] == pytest.approx((1 * 2 * 3 * 4) ** 0.25)
    assert [r["level"] for r in crosstab(sales, ["r"], [], ["t"], Mode()).orderBy("level").collect()] == [1, 1, 1, 3]
    assert crosstab(sales.limit(0), ["r"], ["c"], ["v"], GeometricMean()).count() == 0


def test_no_group_of_rows_or_states_meets_in_one_task(spark, monkeypatch):
    """Rows become states in their partition; what is exchanged are states, under a salt first."""
    many = spark.range(0, 20_000, 1, 16).select(F.lit("a").alias("r"), F.lit("b").alias("c"), (F.col("id") + 1).cast("double").alias("v"))
    partial = partial_states(many, ["r", "c"], {"v": ["v"]}, GeometricMean())
    assert partial.count() == 16 and partial.select("_salt").distinct().count() == 16
    assert "Exchange" not in partial._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(user_aggregates, "HELD", 0)  # sent on after every batch
    got = crosstab(many, ["r"], ["c"], ["v"], GeometricMean()).collect()
    expected = float(np.exp(np.log(np.arange(1, 20_001)).mean()))
    assert len(got) == 4 and all(r["v"] == pytest.approx(expected) for r in got)


def test_batches_are_folded_together():
    import pandas as pd

    from tallyline.operators.user_aggregates import gathered

    frames = [pd.DataFrame({"x": range(3 * i, 3 * i + 3)}) for i in range(5)]
    found = list(gathered(iter(frames), 6))
    assert [len(f) for f in found] == [6, 6, 3] and pd.concat(found)["x"].tolist() == list(range(15))
    assert list(gathered(iter([]), 6)) == []


def test_first_and_last_sort_distinct_values_only(spark):
    df = spark.range(20_000).selectExpr(
        "concat('r', id % 3) AS r", "concat('c', id % 2) AS c", "cast(id % 7 AS string) AS t", "if(id % 3 = 0, null, id % 11 + 0.5D) AS x")
    table = crosstab(df, ["r"], ["c"], ["t", "x"], "Last")
    aggregates = re.findall(r"\w+Aggregate", table._jdf.queryExecution().executedPlan().toString())
    assert aggregates[-1] == "HashAggregate"  # the one that reads the source rows
    rows = {(r["r"], r["c"]): (r["t"], r["x"]) for r in table.collect()}
    assert len(rows) == 12 and rows["r0", "c1"] == ("6", None) and rows[None, None] == ("6", 10.5)
    assert [tuple(r) for r in crosstab(df, [], [], ["t", "x"], "First").select("t", "x").collect()] == [("0", 0.5)]
    assert crosstab(df.limit(0), [], [], ["t"], "First").count() == 1
