"""Windows and features against hand-worked or numpy results on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import features, rollup, windows


def by_id(frame, *columns):
    return {r["unique_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in frame.collect()}


@pytest.fixture(scope="module")
def short(make_series):
    return make_series({f"n{n:02d}": [10 + (i * 7) % 5 for i in range(n)] for n in (1, 6, 11, 12, 13, 23, 24, 25)})


def test_length_guards(short):
    ts = by_id(features.ts_features(short), "seasonal_strength", "lag12_corr")
    assert set(ts) == {"n12", "n13", "n23", "n24", "n25"}
    assert ts["n23"][0] == 0.0 and ts["n24"][0] > 0.0
    assert ts["n12"][1] is None and ts["n13"][1] is None and ts["n23"][1] is not None
    sku = by_id(features.sku_features(short), "seasonality_strength")
    assert sku["n24"] == 0.0 and sku["n25"] > 0.0
    status = by_id(features.seasonal_strength_decomp(short), "status")
    assert status["n23"] == "insufficient_data" and status["n24"] == "success"


def test_constant_and_zero_series(make_series):
    df = make_series({"constant": [5] * 24, "zero": [0] * 24})
    ts = by_id(features.ts_features(df), "cv", "trend_slope", "seasonal_strength", "lag1_corr", "recent_growth", "zero_prop")
    assert ts["constant"] == (0.0, 0.0, 0.0, None, 1.0, 0.0)
    assert ts["zero"] == (0.0, 0.0, 0.0, None, 1.0, 1.0)
    sku = by_id(features.sku_features(df), "cv", "growth_rate", "volatility", "lifecycle_stage", "break_points")
    assert sku["constant"] == (0.0, 0.0, 0.0, "stable", 0)
    assert sku["zero"] == (float("inf"), 0.0, None, "stable", 0)
    assert {r["ynorm"] for r in windows.zscore(df).collect()} == {0.0}
    assert by_id(features.seasonal_strength_decomp(df), "status", "seasonal_strength")["constant"] == ("constant_series", 0.0)


def test_ts_features_against_numpy(make_series):
    rng = np.random.default_rng(3)
    data = {f"s{i}": list(np.round(rng.gamma(2, 50, n), 2)) for i, n in enumerate((30, 36, 41))}
    got = {r["unique_id"]: r.asDict() for r in features.ts_features(make_series(data)).collect()}
    for name, values in data.items():
        v = np.array(values)
        phase = [v[i::12].mean() for i in range(12)]
        expected = {
            "mean": v.mean(), "std": v.std(), "cv": v.std() / v.mean(),
            "trend_slope": np.polyfit(np.arange(len(v)), v, 1)[0],
            "seasonal_strength": np.var(phase) / np.var(v),
            "lag1_corr": np.corrcoef(v[:-1], v[1:])[0, 1], "lag12_corr": np.corrcoef(v[:-12], v[12:])[0, 1],
            "volatility": np.diff(v).std(), "zero_prop": 0.0, "recent_growth": v[-6:].mean() / v[:6].mean(),
        }
        for k, e in expected.items():
            assert got[name][k] == pytest.approx(e, rel=1e-9), (name, k)


def test_sku_features_against_pandas(make_series):
    import pandas as pd

    rng = np.random.default_rng(5)
    data = {f"s{i}": list(np.round(rng.gamma(2, 300, n), 2)) for i, n in enumerate((12, 29, 36, 48))}
    got = {r["unique_id"]: r.asDict() for r in features.sku_features(make_series(data)).collect()}
    for name, values in data.items():
        s = pd.Series(values)
        n = len(s)
        mean, std = s.rolling(6).mean(), s.rolling(6).std()
        dm, ds = mean.diff().abs(), std.diff().abs()
        hits = sum(bool(dm[i] > dm.quantile(0.8) or ds[i] > ds.quantile(0.8)) for i in range(6, n))
        rolled = s.rolling(6, min_periods=3)
        expected = {
            "mean_volume": s.mean(), "cv": s.std() / s.mean(), "trend_strength": abs(np.corrcoef(np.arange(n), s)[0, 1]),
            "growth_rate": (s[-6:].mean() / s[:6].mean()) ** (12 / n) - 1,
            "volatility": (rolled.std() / rolled.mean()).mean(), "break_points": hits, "series_length": n,
            "seasonality_strength": abs(s.autocorr(12)) if n > 24 else 0.0,
        }
        for k, e in expected.items():
            assert got[name][k] == pytest.approx(e, rel=1e-9), (name, k)


def test_five_patterns(five_patterns):
    from tallyline.operators.segments import business_segments

    table = by_id(features.sku_features(five_patterns), "lifecycle_stage", "trend_direction")
    assert table["SKU002"] == ("growth", 1) and table["SKU005"] == ("decline", -1)
    segments = by_id(business_segments(features.sku_features(five_patterns)), "segment")
    assert segments["SKU001"] == "seasonal_low"


def test_seasonal_flags_match_the_two_metric_tables(make_series):
    rng = np.random.default_rng(8)
    df = make_series({f"s{i}": list(rng.gamma(1.5, 40, 12 + 7 * i)) for i in range(5)})
    flags = {r["unique_id"]: r.asDict() for r in features.seasonal_flags(df).collect()}
    for table in (rollup.seasonality_metrics(df), rollup.monthly_cv(df)):
        for r in table.collect():
            for k, v in r.asDict().items():
                assert flags[r["unique_id"]][k] == pytest.approx(v, rel=1e-9) if k != "unique_id" else True


def test_iqr_cap(make_series):
    values = [10 + i % 3 for i in range(20)] + [1000, -1000]
    capped = sorted(r["y"] for r in windows.iqr_cap(make_series({"a": values})).collect())
    ranked = sorted(values)
    q1, q3 = ranked[int(21 * 0.25 + 0.5)], ranked[int(21 * 0.75 + 0.5)]
    assert capped[0] == q1 - 1.5 * (q3 - q1) and capped[-1] == q3 + 1.5 * (q3 - q1)
    linear = sorted(r["y"] for r in windows.iqr_cap(make_series({"a": values}), interpolation="linear").collect())
    a, b = np.quantile(values, [0.25, 0.75])
    assert linear[-1] == pytest.approx(b + 1.5 * (b - a))


def test_lag_by_row_and_by_month(spark):
    df = spark.sql("""select 'a' unique_id, timestamp_ntz'2022-01-01' ds, 1.0D y union all
                      select 'a', timestamp_ntz'2022-03-01', 3.0D union all select 'a', timestamp_ntz'2023-01-01', 9.0D""")
    row = {str(r["ds"])[:7]: r["lag1"] for r in windows.lag_set(df, (1,), fallback=False).collect()}
    month = {str(r["ds"])[:7]: r["lag12"] for r in windows.lag_set(df, (12,), fallback=False, by="month").collect()}
    assert row == {"2022-01": None, "2022-03": 1.0, "2023-01": 3.0}
    assert month == {"2022-01": None, "2022-03": None, "2023-01": 1.0}


def test_label_fill(spark):
    df = spark.sql("""select 'a' unique_id, timestamp_ntz'2022-01-01' ds, cast(null as string) cluster union all
                      select 'a', timestamp_ntz'2022-02-01', '3' union all select 'a', timestamp_ntz'2022-03-01', null
                      union all select 'b', timestamp_ntz'2022-01-01', null""")
    assert sorted((r[0], r[2]) for r in windows.label_fill(df).collect()) == [("a", "3")] * 3 + [("b", None)]


def test_calendar_and_interpolation(make_series):
    df = make_series({"a": [1.0, None, None, 4.0, None], "b": [2.0, 5.0]}).filter("y is not null or unique_id = 'a'")
    full = features.calendar_complete(df.filter("y is not null"), bounds="table")
    assert full.count() == 8
    filled = features.linear_interpolate(df).orderBy("unique_id", "ds")
    assert [r["y"] for r in filled.collect()] == [1.0, 2.0, 3.0, 4.0, 4.0, 2.0, 5.0]


def test_decomposition_of_an_exact_pattern(make_series):
    season = [5.0, -3.0, 1.0, 0.0, 2.0, -5.0, 4.0, -4.0, 3.0, -2.0, 1.0, -2.0]
    df = make_series({"a": [10 + 2 * t + season[t % 12] for t in range(48)]})
    parts = features.decompose(df).filter("trend is not null").orderBy("ds").collect()
    assert len(parts) == 36
    for r in parts:
        assert r["trend"] == pytest.approx(10 + 2 * r["pos"]) and r["seasonal"] == pytest.approx(season[r["pos"] % 12])
        assert r["remainder"] == pytest.approx(0.0, abs=1e-9)
    assert features.seasonal_strength_alt(df).first()["seasonal_strength"] == pytest.approx(1.0)


def test_a_straight_line_has_no_seasonal_strength(make_series):
    df = make_series({"a": [85447.7211 - 1686.842154545 * t for t in range(34)]})
    assert features.seasonal_strength_decomp(df).first()["seasonal_strength"] == 0.0
    assert features.seasonal_strength_alt(df).first()["seasonal_strength"] is None


def test_eligible_and_top_products(spark):
    df = spark.sql("""select 'a' catalog_number, timestamp_ntz'2024-05-01' sales_date, 20.0D y union all
      select 'a', timestamp_ntz'2022-01-01', 1.0D union all select 'b', timestamp_ntz'2024-05-01', 99.0D union all
      select 'c', timestamp_ntz'2024-05-01', 5.0D union all select 'c', timestamp_ntz'2022-01-01', 5.0D""")
    assert [r["catalog_number"] for r in rollup.eligible_products(df, "y", "2024-06-15").collect()] == ["a"]
    assert [r["catalog_number"] for r in rollup.top_products(df, "y", 2).collect()] == ["b", "a"]


def test_date_pivot_does_not_depend_on_the_time_zone(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    df = other.sql("""select 'EU' region, timestamp_ntz'2024-01-01' sales_date, 1.0D v union all
                      select 'EU', timestamp_ntz'2024-02-01 23:30:00', 2.0D union all select 'US', null, 4.0D""")
    got = {r["region"]: r.asDict() for r in rollup.date_pivot(df, None, "v").collect()}
    assert got["EU"] == {"region": "EU", "2024-01-01": 1.0, "2024-02-01": 2.0}
    assert got["US"] == {"region": "US", "2024-01-01": None, "2024-02-01": None}


def test_rollup_levels(spark):
    df = spark.createDataFrame([("x", "EU", 1.0, 2.0)], "franchise string, region string, a double, b double").withColumn(
        "sales_date", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert rollup.level_rollup(df, "franchise", None).columns == ["sales_date", "franchise", "region", "a", "b"]
    with pytest.raises(ValueError):
        rollup.level_rollup(df, "nothing", "region")
