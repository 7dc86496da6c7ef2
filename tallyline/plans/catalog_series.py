"""Registered queries: aggregations, rankings, windows and series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import features, loess, rollup, windows
from tallyline.plans.registry import (
    AS_OF,
    query,
    rounded,
    sales_sql,
    series_sql,
)
from tallyline.sources.tables import long_series, monthly_sales

_BOTH = ("act_orders_rev", "fcst_stat_final_rev")
_CB = ["country", "franchise"]
_SKU = ["catalog_number"]
_CB_SERIES = series_sql(_CB)
_SKU_SERIES = series_sql(_SKU)

# --- roll-ups ------------------------------------------------------------------------------------


def _rollup_sql(keys, measures) -> str:
    sums = ", ".join(f"round(sum({m}), 4) AS {m}" for m in measures)
    return f"SELECT sales_date, {', '.join(keys)}, {sums} FROM ({sales_sql(['region', 'business_unit', 'franchise', 'ibp_level_6'], measures)}) GROUP BY ALL"


def _wide_sales(t):
    return monthly_sales(t, ["region", "business_unit", "franchise", "ibp_level_6"], _BOTH)


@query("level_rollup", _rollup_sql(["ibp_level_6", "region"], _BOTH))
def _(t):
    return rollup.level_rollup(_wide_sales(t), "franchise", "region", level="ibp_level_6")


@query("default_rollup", _rollup_sql(["business_unit", "region"], _BOTH))
def _(t):
    return rollup.default_rollup(_wide_sales(t))


@query("catalog_month_rollup", sales_sql(_SKU, _BOTH))
def _(t):
    return rollup.catalog_month_rollup(monthly_sales(t, ["catalog_number", "status"], _BOTH))


@query("year_month_totals", f"""SELECT CAST(year(sales_date) AS INT) AS yr, CAST(month(sales_date) AS INT) AS mon,
  count(*) AS n, round(sum(act_orders_rev), 4) AS act FROM ({sales_sql(_CB)}) GROUP BY 1, 2""")
def _(t):
    d = F.col("sales_date")
    return monthly_sales(t, _CB).groupBy(F.year(d).alias("yr"), F.month(d).alias("mon")).agg(
        F.count(F.lit(1)).alias("n"), rollup.total("act_orders_rev").alias("act"))


@query("year_month_actual_forecast", f"""SELECT CAST(year(sales_date) AS INT) AS year, CAST(month(sales_date) AS INT) AS month_number,
  strftime(sales_date, '%b') AS month, round(sum(act_orders_rev), 4) AS actual, round(sum(fcst_stat_final_rev), 4) AS forecast
  FROM ({sales_sql(_CB, _BOTH)}) GROUP BY 1, 2, 3""")
def _(t):
    return rollup.year_month_totals(monthly_sales(t, _CB, _BOTH), "act_orders_rev", "fcst_stat_final_rev")


@query("date_line", f"""SELECT sales_date, round(sum(act_orders_rev), 4) AS actual, CAST(NULL AS DOUBLE) AS forecast
  FROM ({sales_sql(_CB)}) GROUP BY 1""")
def _(t):
    return rollup.date_line(monthly_sales(t, _CB), "act_orders_rev", "absent_model")


@query("month_name_line", f"""SELECT CAST(month(sales_date) AS INT) AS month_number, strftime(sales_date, '%b') AS month,
  round(sum(act_orders_rev), 4) AS actual, round(sum(fcst_stat_final_rev), 4) AS forecast
  FROM ({sales_sql(_CB, _BOTH)}) GROUP BY 1, 2""")
def _(t):
    return rollup.month_name_line(monthly_sales(t, _CB, _BOTH), "act_orders_rev", "fcst_stat_final_rev")


_MONTHS = ", ".join(
    f"round(sum(act_orders_rev) FILTER (WHERE month(sales_date) = {m}), 4) AS m{m:02d}" for m in range(1, 13))


@query("year_by_month_matrix", f"SELECT CAST(year(sales_date) AS INT) AS year, {_MONTHS} FROM ({sales_sql(_CB)}) GROUP BY 1")
def _(t):
    return rollup.year_by_month(monthly_sales(t, _CB), "act_orders_rev")


_DATES = [f"{y}-{m:02d}-01" for y in range(1995, 2002) for m in range(1, 13) if (y, m) < (2001, 9)]
_DATE_COLUMNS = ", ".join(
    f"round(sum(act_orders_rev) FILTER (WHERE sales_date = TIMESTAMP '{d}'), 4) AS \"{d}\"" for d in _DATES)


@query("date_pivot", f"SELECT region, franchise, {_DATE_COLUMNS} FROM ({sales_sql(['region', 'franchise'])}) GROUP BY 1, 2")
def _(t):
    return rollup.date_pivot(monthly_sales(t, ["region", "franchise"]), "region", "act_orders_rev", "franchise")


@query("series_month_pivot", f"""WITH s AS ({_CB_SERIES}), z AS (SELECT unique_id, ds,
    (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) AS v FROM s WINDOW w AS (PARTITION BY unique_id)),
  cal AS (SELECT u AS unique_id, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS ds FROM
    (SELECT DISTINCT unique_id AS u FROM s), (SELECT min(ds) AS a, max(ds) AS b FROM s))
  SELECT unique_id, CAST(row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS INT) AS month_number,
    round(coalesce(v, 0), 6) AS ynorm FROM cal LEFT JOIN z USING (unique_id, ds)""")
def _(t):
    from tallyline.operators.clusters import month_vectors
    vectors = month_vectors(windows.zscore(long_series(t, _CB)))
    return rounded(vectors.select("unique_id", F.posexplode("vector").alias("month_number", "ynorm")), 6, "ynorm")


@query("seasonality_metrics", f"""SELECT unique_id, round(avg(y), 1) AS mean_sales, round(stddev_samp(y), 1) AS std_sales,
  min(y) AS min_sales, max(y) AS max_sales, count(*) AS n_months, round(stddev_samp(y) / nullif(avg(y), 0), 6) AS cv,
  round(max(y) / nullif(min(y), 0), 3) AS range_ratio, round((max(y) - min(y)) / nullif(avg(y), 0), 6) AS relative_range
  FROM ({_SKU_SERIES}) GROUP BY 1""")
def _(t):
    table = rollup.seasonality_metrics(long_series(t, _SKU))
    table = rounded(table, 1, "mean_sales", "std_sales")
    return rounded(rounded(table, 6, "cv", "relative_range"), 3, "range_ratio")


def _month_means_sql(series: str) -> str:
    return f"(SELECT unique_id, month(ds) AS m, avg(y) AS v FROM ({series}) GROUP BY 1, 2)"


@query("monthly_cv", f"""SELECT unique_id, round(avg(v), 1) AS overall_monthly_mean, round(stddev_samp(v), 1) AS monthly_std,
  round(stddev_samp(v) / nullif(avg(v), 0), 6) AS monthly_cv FROM {_month_means_sql(_SKU_SERIES)} GROUP BY 1""")
def _(t):
    table = rollup.monthly_cv(long_series(t, _SKU))
    return rounded(rounded(table, 1, "overall_monthly_mean", "monthly_std"), 6, "monthly_cv")


@query("seasonal_variance_ratio", f"""SELECT unique_id, round(sqrt(var_samp(v)), 1) AS seasonal_std, round(avg(v), 1) AS overall_mean,
  round(var_samp(v) / nullif(avg(v) * avg(v), 0), 6) AS seasonal_strength FROM {_month_means_sql(_SKU_SERIES)} GROUP BY 1""")
def _(t):
    table = rollup.seasonal_variance_ratio(long_series(t, _SKU))
    return table.select("unique_id", F.round(F.sqrt("seasonal_var"), 1).alias("seasonal_std"),
                        F.round("overall_mean", 1).alias("overall_mean"),
                        F.round("seasonal_strength", 6).alias("seasonal_strength"))


def _describe_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, count(*) - count({column}) AS null_count,
      round(avg({column}), 2) AS mean, round(stddev_samp({column}), 2) AS std, CAST(min({column}) AS DOUBLE) AS min,
      round(quantile_cont({column}, 0.25), 3) AS q1, round(quantile_cont({column}, 0.5), 3) AS median,
      round(quantile_cont({column}, 0.75), 3) AS q3, CAST(max({column}) AS DOUBLE) AS max FROM lineitem"""


@query("table_describe", " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(t):
    table = rollup.table_describe(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(rounded(table, 2, "mean", "std"), 3, "q1", "median", "q3")


_ATTRIBUTES = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query("attribute_value_counts", " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, coalesce(CAST({a} AS VARCHAR), 'null') AS value, count(*) AS n_rows FROM orders GROUP BY 2"
    for a in _ATTRIBUTES))
def _(t):
    return rollup.attribute_value_counts(t("orders"), _ATTRIBUTES)


@query("xt_cardinality_guard", " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, count(DISTINCT {a}) AS n_values, count(DISTINCT {a}) <= 500 AS listed FROM orders"
    for a in _ATTRIBUTES))
def _(t):
    return rollup.high_cardinality(t("orders"), _ATTRIBUTES)


@query("year_correlation", f"""WITH m AS (SELECT unique_id, CASE WHEN year(ds) = 2001 THEN 1998 ELSE year(ds) END AS yr,
    month(ds) AS mon, round(sum(y), 4) AS v FROM ({_CB_SERIES}) GROUP BY ALL)
  SELECT a.unique_id, CAST(a.yr AS INT) AS year_a, CAST(b.yr AS INT) AS year_b, count(*) AS n_months,
    round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 6) AS correlation
  FROM m a JOIN m b ON a.unique_id = b.unique_id AND a.mon = b.mon AND a.yr < b.yr GROUP BY 1, 2, 3""")
def _(t):
    return rounded(rollup.year_correlation(long_series(t, _CB), relabel={2001: 1998}), 6, "correlation")


# --- top-n ---------------------------------------------------------------------------------------


@query("top_products", f"""SELECT catalog_number, round(sum(act_orders_rev), 4) AS total FROM ({sales_sql(_SKU)})
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def _(t):
    return rollup.top_products(monthly_sales(t, _SKU), "act_orders_rev", 100)


@query("eligible_products", f"""SELECT catalog_number,
  round(coalesce(sum(act_orders_rev) FILTER (WHERE sales_date > TIMESTAMP '2000-07-15'), 0), 4) AS recent_total,
  round(coalesce(sum(act_orders_rev) FILTER (WHERE sales_date <= TIMESTAMP '2000-07-15'), 0), 4) AS earlier_total
  FROM ({sales_sql(_SKU)}) GROUP BY 1 HAVING recent_total > 12 AND earlier_total > 0""")
def _(t):
    return rollup.eligible_products(monthly_sales(t, _SKU), "act_orders_rev", AS_OF)


@query("top_seasonal", f"""SELECT unique_id, round(stddev_samp(v) / nullif(avg(v), 0), 6) AS monthly_cv
  FROM {_month_means_sql(_CB_SERIES)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    table = rounded(rollup.monthly_cv(long_series(t, _CB)), 6, "monthly_cv").select("unique_id", "monthly_cv")
    return rollup.top_seasonal(table, 20)


@query("date_sort", f"SELECT * FROM ({sales_sql(['region'])})")
def _(t):
    return monthly_sales(t, ["region"]).orderBy("sales_date", "region")


# --- windows -------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY unique_id ORDER BY ds)"


@query("lag12_fallback", f"SELECT *, coalesce(lag(y, 12) OVER w, y) AS lag12 FROM ({_CB_SERIES}) {_W}")
def _(t):
    return windows.lag_set(long_series(t, _CB), (12,))


def _lags(lags, fallback) -> str:
    one = "coalesce(lag(y, {k}) OVER w, y)" if fallback else "lag(y, {k}) OVER w"
    return ", ".join(one.format(k=k) + f" AS lag{k}" for k in lags)


@query("lag_set", f"SELECT *, {_lags((3, 4, 5, 6, 12), True)} FROM ({_SKU_SERIES}) {_W}")
def _(t):
    return windows.lag_set(long_series(t, _SKU))


@query("lag_set_plain", f"SELECT *, {_lags((3, 4, 5, 6, 12, 24), False)} FROM ({_SKU_SERIES}) {_W}")
def _(t):
    return windows.lag_set(long_series(t, _SKU), (3, 4, 5, 6, 12, 24), fallback=False)


@query("lag_by_month", f"""WITH s AS ({_SKU_SERIES}) SELECT s.*, p.y AS lag12 FROM s
  LEFT JOIN s p ON p.unique_id = s.unique_id AND p.ds = s.ds - INTERVAL 12 MONTH""")
def _(t):
    return windows.lag_set(long_series(t, _SKU), (12,), fallback=False, by="month")


@query("zscore_by_series", f"""SELECT *, round(coalesce((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 0), 6) AS ynorm
  FROM ({_SKU_SERIES}) WINDOW w AS (PARTITION BY unique_id)""")
def _(t):
    return rounded(windows.zscore(long_series(t, _SKU)), 6, "ynorm")


_CAPS = """CASE WHEN y < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
  WHEN y > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE y END"""


@query("iqr_cap", f"""WITH s AS ({_SKU_SERIES}), q AS (SELECT unique_id,
    list_sort(list(y))[CAST(floor((count(*) - 1) * 0.25 + 0.5) AS INT) + 1] AS q1,
    list_sort(list(y))[CAST(floor((count(*) - 1) * 0.75 + 0.5) AS INT) + 1] AS q3 FROM s GROUP BY 1)
  SELECT unique_id, ds, round({_CAPS}, 5) AS y FROM s JOIN q USING (unique_id)""")
def _(t):
    return rounded(windows.iqr_cap(long_series(t, _SKU)), 5, "y")


@query("iqr_cap_linear", f"""WITH s AS ({_CB_SERIES}), q AS (SELECT unique_id, quantile_cont(y, 0.25) AS q1,
    quantile_cont(y, 0.75) AS q3 FROM s GROUP BY 1)
  SELECT unique_id, ds, round({_CAPS}, 7) AS y FROM s JOIN q USING (unique_id)""")
def _(t):
    return rounded(windows.iqr_cap(long_series(t, _CB), interpolation="linear"), 7, "y")


@query("label_fill", f"""WITH s AS (SELECT *, CASE WHEN y > 150000 THEN CAST(month(ds) AS VARCHAR) END AS raw FROM ({_CB_SERIES}))
  SELECT unique_id, ds, y, coalesce(
    last_value(raw IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(raw IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS cluster
  FROM s""")
def _(t):
    labelled = long_series(t, _CB).withColumn(
        "cluster", F.when(F.col("y") > 150000, F.month("ds").cast("string")))
    return windows.label_fill(labelled)


@query("partition_count", f"SELECT *, count(y) OVER (PARTITION BY unique_id) AS num FROM ({_SKU_SERIES})")
def _(t):
    return windows.partition_count(long_series(t, _SKU))


@query("month_presence", f"""SELECT *, max(mc) OVER (PARTITION BY unique_id) AS mcmax FROM (SELECT *,
  CASE WHEN y > 0 THEN count(y) OVER (PARTITION BY unique_id, month(ds)) ELSE 0 END AS mc FROM ({_SKU_SERIES}))""")
def _(t):
    return windows.month_presence(long_series(t, _SKU))


_R6 = "WINDOW r AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query("rolling_mean_std", f"""SELECT unique_id, ds, CASE WHEN count(y) OVER r >= 3 THEN round(avg(y) OVER r, 1) END AS rolling_mean,
  CASE WHEN count(y) OVER r >= 3 THEN round(stddev_samp(y) OVER r, 1) END AS rolling_std,
  CASE WHEN count(y) OVER r >= 3 THEN round(stddev_samp(y) OVER r / nullif(avg(y) OVER r, 0), 6) END AS rolling_cv
  FROM ({_CB_SERIES}) {_R6}""")
def _(t):
    table = windows.rolling(long_series(t, _CB), 6, 3).drop("y")
    return rounded(rounded(table, 1, "rolling_mean", "rolling_std"), 6, "rolling_cv")


@query("rolling_change", f"""WITH r AS (SELECT unique_id, ds, CASE WHEN count(y) OVER r = 6 THEN avg(y) OVER r END AS a,
    CASE WHEN count(y) OVER r = 6 THEN stddev_samp(y) OVER r END AS s FROM ({_CB_SERIES}) {_R6})
  SELECT unique_id, ds, round(a, 1) AS rolling_mean, round(s, 1) AS rolling_std,
    round(abs(a - lag(a) OVER w), 1) AS mean_change, round(abs(s - lag(s) OVER w), 1) AS std_change FROM r {_W}""")
def _(t):
    table = windows.rolling_change(long_series(t, _CB)).drop("y")
    return rounded(table, 1, "rolling_mean", "rolling_std", "mean_change", "std_change")


@query("first_difference", f"SELECT unique_id, ds, y, round(y - lag(y) OVER w, 4) AS ydiff FROM ({_SKU_SERIES}) {_W}")
def _(t):
    return rounded(windows.first_difference(long_series(t, _SKU)), 4, "ydiff")


@query("rolling_mean3", f"""SELECT unique_id, ds, y, CASE WHEN count(y) OVER r = 3 THEN round(avg(y) OVER r, 6) END AS ymean
  FROM ({_SKU_SERIES}) WINDOW r AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t):
    return rounded(windows.rolling_mean(long_series(t, _SKU)), 6, "ymean")


@query("position_index", f"""SELECT unique_id, ds, y, CAST(p AS INT) AS pos, n, CAST(CASE WHEN p < n // 2 THEN 1 ELSE 2 END AS INT) AS half,
  CAST(CASE WHEN p < n // 3 THEN 1 WHEN p < 2 * (n // 3) THEN 2 ELSE 3 END AS INT) AS third, p < 6 AS first_six, p >= n - 6 AS last_six
  FROM (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY unique_id) AS n FROM ({_SKU_SERIES}) {_W})""")
def _(t):
    return windows.position_index(long_series(t, _SKU))


# --- series features -----------------------------------------------------------------------------

# Position, length and lags per series, for every feature query below.
_STAGED = f"""s AS ({_SKU_SERIES}), p AS (SELECT *, row_number() OVER w - 1 AS pos,
    count(*) OVER (PARTITION BY unique_id) AS n, lag(y, 1) OVER w AS l1, lag(y, 12) OVER w AS l12 FROM s {_W}),
  long AS (SELECT * FROM p WHERE n >= 12),
  phase AS (SELECT unique_id, var_pop(v) AS phase_var FROM
    (SELECT unique_id, pos % 12 AS ph, avg(y) AS v FROM long WHERE n >= 24 GROUP BY 1, 2) GROUP BY 1)"""


def _corr_sql(x: str, y: str) -> str:
    return (f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER (WHERE {y} IS NOT NULL) * "
            f"stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL), 0)")


_TS_SQL = {
    "mean": "round(avg(y), 1)",
    "std": "round(stddev_pop(y), 1)",
    "cv": "round(coalesce(stddev_pop(y) / nullif(avg(y), 0), 0), 6)",
    "trend_slope": "round(covar_pop(y, pos) / nullif(var_pop(pos), 0), 3)",
    "seasonal_strength": "round(coalesce(any_value(phase_var) / nullif(var_pop(y), 0), 0), 6)",
    "lag1_corr": f"round({_corr_sql('y', 'l1')}, 6)",
    "lag12_corr": f"round({_corr_sql('y', 'l12')}, 6)",
    "volatility": "round(stddev_pop(y - l1), 1)",
    "zero_prop": "avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END)",
    "recent_growth": "round(coalesce(avg(y) FILTER (WHERE pos >= n - 6) / nullif(avg(y) FILTER (WHERE pos < 6), 0), 1), 6)",
}
_TS_DIGITS = {"mean": 1, "std": 1, "trend_slope": 3, "volatility": 1, "cv": 6, "seasonal_strength": 6,
              "lag1_corr": 6, "lag12_corr": 6, "recent_growth": 6}


def _ts_query(name: str, chosen: tuple[str, ...]) -> None:
    columns = ", ".join(f"{_TS_SQL[c]} AS {c}" for c in chosen)
    sql = f"WITH {_STAGED} SELECT unique_id, {columns} FROM long LEFT JOIN phase USING (unique_id) GROUP BY unique_id"

    @query(name, sql)
    def _(t):
        table = features.ts_features(long_series(t, _SKU), chosen)
        for c in chosen:
            if c in _TS_DIGITS:
                table = rounded(table, _TS_DIGITS[c], c)
        return table


_ts_query("ts_basic", ("mean", "std", "cv"))
_ts_query("ts_trend_slope", ("trend_slope",))
_ts_query("ts_seasonal_strength", ("seasonal_strength",))
_ts_query("ts_lag1_corr", ("lag1_corr",))
_ts_query("ts_lag12_corr", ("lag12_corr",))
_ts_query("ts_volatility", ("volatility",))
_ts_query("ts_zero_prop", ("zero_prop",))
_ts_query("ts_recent_growth", ("recent_growth",))
_ts_query("ts_feature_table", features.TS_FEATURES)

_SKU_STAGED = f"""{_STAGED},
  roll AS (SELECT *, CASE WHEN count(y) OVER r >= 3 THEN avg(y) OVER r END AS rm,
    CASE WHEN count(y) OVER r >= 3 THEN stddev_samp(y) OVER r END AS rs FROM long {_R6}),
  chg AS (SELECT *, CASE WHEN pos >= 6 THEN abs(rm - lag(rm) OVER w) END AS mc,
    CASE WHEN pos >= 6 THEN abs(rs - lag(rs) OVER w) END AS sc FROM roll {_W}),
  lim AS (SELECT unique_id, quantile_cont(mc, 0.8) AS ml, quantile_cont(sc, 0.8) AS sl FROM chg GROUP BY 1),
  brk AS (SELECT unique_id, count(*) FILTER (WHERE mc > ml OR sc > sl) AS breaks FROM chg JOIN lim USING (unique_id) GROUP BY 1),
  thirds AS (SELECT unique_id, avg(y) FILTER (WHERE pos < n // 3) AS a,
    avg(y) FILTER (WHERE pos >= n // 3 AND pos < 2 * (n // 3)) AS b, avg(y) FILTER (WHERE pos >= 2 * (n // 3)) AS c
    FROM long GROUP BY 1),
  feat AS (SELECT unique_id, avg(y) AS mean_volume, stddev_samp(y) / avg(y) AS cv,
    abs({_corr_sql('y', 'pos')}) AS trend_strength, CAST(sign(covar_pop(y, pos)) AS INT) AS trend_direction,
    CASE WHEN max(n) > 24 THEN coalesce(abs({_corr_sql('y', 'l12')}), 0) ELSE 0 END AS seasonality_strength,
    pow(avg(y) FILTER (WHERE pos >= n - 6) / avg(y) FILTER (WHERE pos < 6), 12.0 / max(n)) - 1 AS growth_rate,
    avg(rs / nullif(rm, 0)) AS volatility, CASE WHEN avg(y) < 100 THEN 'low' WHEN avg(y) < 1000 THEN 'medium' ELSE 'high' END AS volume_category,
    max(n) AS series_length FROM roll GROUP BY 1),
  sku AS (SELECT feat.*, CASE WHEN a < b AND b < c THEN 'growth' WHEN a > b AND b > c THEN 'decline'
      WHEN a < b AND b > c THEN 'maturity' ELSE 'stable' END AS lifecycle_stage, CAST(breaks AS INT) AS break_points
    FROM feat JOIN thirds USING (unique_id) JOIN brk USING (unique_id))"""
SKU_SQL = f"WITH {_SKU_STAGED} SELECT * FROM sku"
_SKU_DIGITS = {"mean_volume": 1, "cv": 6, "trend_strength": 6, "seasonality_strength": 6, "growth_rate": 6, "volatility": 6}


def _sku_query(name: str, chosen: tuple[str, ...]) -> None:
    columns = ", ".join(
        f"round({c}, {_SKU_DIGITS[c]}) AS {c}" if c in _SKU_DIGITS else c for c in chosen)

    @query(name, f"WITH {_SKU_STAGED} SELECT unique_id, {columns} FROM sku")
    def _(t):
        table = features.sku_features(long_series(t, _SKU), chosen)
        for c in chosen:
            if c in _SKU_DIGITS:
                table = rounded(table, _SKU_DIGITS[c], c)
        return table


_sku_query("sku_trend", ("trend_strength", "trend_direction"))
_sku_query("sku_autocorr12", ("seasonality_strength",))
_sku_query("sku_cagr", ("growth_rate",))
_sku_query("sku_rolling_cv", ("volatility",))
_sku_query("sku_lifecycle", ("lifecycle_stage",))
_sku_query("sku_break_count", ("break_points",))
_sku_query("sku_feature_table", features.SKU_FEATURES)

_FLAGS_SQL = f"""WITH s AS ({_SKU_SERIES}), b AS (SELECT unique_id, stddev_samp(y) / nullif(avg(y), 0) AS cv,
    max(y) / nullif(min(y), 0) AS rr FROM s GROUP BY 1),
  m AS (SELECT unique_id, stddev_samp(v) / nullif(avg(v), 0) AS mcv FROM {_month_means_sql(_SKU_SERIES)} GROUP BY 1)"""


@query("seasonal_flags", f"""{_FLAGS_SQL} SELECT unique_id, cv >= 0.3 AS high_cv, rr >= 2 AS high_range_ratio, mcv >= 0.25 AS high_monthly_cv,
  CAST(CAST(cv >= 0.3 AS INT) + CAST(rr >= 2 AS INT) + CAST(mcv >= 0.25 AS INT) AS INT) AS seasonality_score,
  CAST(cv >= 0.3 AS INT) + CAST(rr >= 2 AS INT) + CAST(mcv >= 0.25 AS INT) >= 2 AS is_seasonal
  FROM b JOIN m USING (unique_id) WHERE mcv IS NOT NULL""")
def _(t):
    return features.seasonal_flags(long_series(t, _SKU)).select(
        "unique_id", "high_cv", "high_range_ratio", "high_monthly_cv", "seasonality_score", "is_seasonal")


@query("metrics_left_join", f"""{_FLAGS_SQL} SELECT unique_id, round(cv, 6) AS cv, round(mcv, 6) AS monthly_cv
  FROM b LEFT JOIN m USING (unique_id)""")
def _(t):
    series = long_series(t, _SKU)
    table = features.seasonal_metrics(series)  # both metrics from one aggregate
    return rounded(table.select("unique_id", "cv", "monthly_cv"), 6, "cv", "monthly_cv")


# Classical decomposition by definition: half weights at both ends of thirteen rows.
_DECOMP = """q AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY unique_id) AS n FROM {source}
    WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
  tr AS (SELECT *, CASE WHEN pos >= 6 AND pos < n - 6 THEN
    (sum(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
     + 0.5 * lag(y, 6) OVER w + 0.5 * lead(y, 6) OVER w) / 12 END AS trend FROM q WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
  ph AS (SELECT unique_id, pos % 12 AS k, avg(y - trend) AS raw FROM tr GROUP BY 1, 2),
  ce AS (SELECT unique_id, k, raw - avg(raw) OVER (PARTITION BY unique_id) AS s FROM ph),
  parts AS (SELECT tr.*, CASE WHEN trend IS NOT NULL THEN ce.s END AS seas, y - trend - ce.s AS rem
    FROM tr JOIN ce ON ce.unique_id = tr.unique_id AND ce.k = tr.pos % 12)"""


@query("seasonal_strength_decomp", f"""WITH s AS ({_SKU_SERIES}), {_DECOMP.format(source='s')}
  SELECT unique_id, CASE WHEN count(*) < 24 THEN NULL WHEN var_samp(y) = 0 OR var_pop(seas) + var_pop(rem) <= 1e-24 * avg(y * y) THEN 0.0 ELSE
    round(var_pop(seas) / (var_pop(seas) + var_pop(rem)), 6) END AS seasonal_strength, count(*) AS n_periods,
    CASE WHEN count(*) < 24 THEN 'insufficient_data' WHEN var_samp(y) = 0 THEN 'constant_series' ELSE 'success' END AS status
  FROM parts GROUP BY 1""")
def _(t):
    return rounded(features.seasonal_strength_decomp(long_series(t, _SKU)), 6, "seasonal_strength")


def _loess_sql(out: str, source: str, window: int, y: str, weight: str = "1", ends: int = 0, part: str = "unique_id") -> str:
    """A table (part, pos, v): local regression of ``y`` of ``source`` (part, pos, n) with tricube weights, straight from the definition."""
    return f"""{out}_x AS (SELECT {part}, n, unnest(range({-ends}, n + {ends})) AS x FROM (SELECT {part}, max(n) AS n FROM {source} GROUP BY {part})),
  {out}_l AS (SELECT *, greatest(0, least(x - (least({window}, n) + 1) // 2 + 1, n - least({window}, n))) AS lo FROM {out}_x),
  {out}_h AS (SELECT *, lo + least({window}, n) - 1 AS hi FROM {out}_l),
  {out}_w AS (SELECT a.*, t.pos AS j, {y} AS y, {weight} * CASE WHEN r > 0.999::DOUBLE THEN 0 WHEN r <= 0.001::DOUBLE THEN 1
      ELSE (1 - r * r * r) * (1 - r * r * r) * (1 - r * r * r) END AS w
    FROM (SELECT *, greatest(x - lo, hi - x) + greatest(0, ({window} - n) // 2) AS reach FROM {out}_h) a
    JOIN {source} t ON {' AND '.join(f't.{c.strip()} = a.{c.strip()}' for c in part.split(','))} AND t.pos BETWEEN a.lo AND a.hi
    CROSS JOIN LATERAL (SELECT abs(t.pos - a.x) / CAST(greatest(a.reach, 1) AS DOUBLE) AS r)),
  {out}_s AS (SELECT {part}, x, max(n) AS n, max(reach) AS reach, sum(w) AS w, sum(w * (j - x)) / sum(w) AS c,
      sum(w * (j - x) * (j - x)) / sum(w) AS cc, sum(w * y) / sum(w) AS l, sum(w * (j - x) * y) / sum(w) AS ly FROM {out}_w GROUP BY {part}, x),
  {out} AS (SELECT {part}, x AS pos, CASE WHEN reach > 0 AND sqrt(greatest(cc - c * c, 0)) > 0.001::DOUBLE * (n - 1)
      THEN l - (ly - c * l) / (cc - c * c) * c ELSE l END AS v FROM {out}_s)"""


def _stl_round_sql(k: int, trend: str, weight: str) -> str:
    """Season and trend tables s{k}, t{k} after one alternation from the trend and weights of ``y{k}`` (unique_id, pos, n, y)."""
    average = "SELECT unique_id, pos, v FROM (SELECT unique_id, pos, avg(v) OVER (PARTITION BY unique_id ORDER BY pos ROWS BETWEEN {0} PRECEDING AND CURRENT ROW) AS v FROM {1}) WHERE pos >= {2}"
    return f"""sub{k} AS (SELECT unique_id, pos % 12 AS phase, pos // 12 AS pos, count(*) OVER (PARTITION BY unique_id, pos % 12) AS n,
      y - {trend} AS d, {weight} AS rw FROM y{k}),
  {_loess_sql(f'c{k}', f'sub{k}', 7, 't.d', 't.rw', 1, 'unique_id, phase')},
  cyc{k} AS (SELECT unique_id, phase + 12 * (pos + 1) AS pos, v FROM c{k}),
  a{k} AS ({average.format(11, f'cyc{k}', 11)}), b{k} AS ({average.format(11, f'a{k}', 22)}), m{k} AS ({average.format(2, f'b{k}', 24)}),
  low{k}_in AS (SELECT unique_id, pos - 24 AS pos, v, count(*) OVER (PARTITION BY unique_id) AS n FROM m{k}),
  {_loess_sql(f'low{k}', f'low{k}_in', 13, 't.v')},
  s{k} AS (SELECT y.unique_id, y.pos, cyc{k}.v - low{k}.v AS s FROM y{k} y JOIN cyc{k} ON cyc{k}.unique_id = y.unique_id AND cyc{k}.pos = y.pos + 12
    JOIN low{k} ON low{k}.unique_id = y.unique_id AND low{k}.pos = y.pos),
  de{k} AS (SELECT y.*, y - s AS de FROM y{k} y JOIN s{k} USING (unique_id, pos)),
  {_loess_sql(f't{k}', f'de{k}', 23, 't.de', f't.{weight}' if weight != '1' else '1')}"""


# One alternation, one robust repetition: season, trend and weights of the second pass start from those of the first.
_LOESS_SQL = f"""WITH s AS ({{series}}),
  num AS (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS pos, count(*) OVER (PARTITION BY unique_id) AS n,
    var_samp(y) OVER (PARTITION BY unique_id) AS variance, avg(y * y) OVER (PARTITION BY unique_id) AS square FROM s),
  y1 AS (SELECT unique_id, pos, n, y FROM num WHERE n >= 24 AND variance > 0),
  {_stl_round_sql(1, '0', '1')},
  res AS (SELECT y1.unique_id, y1.pos, y1.n, y1.y, t1.v AS trend, abs(y1.y - s1.s - t1.v) AS r FROM y1
    JOIN s1 USING (unique_id, pos) JOIN t1 USING (unique_id, pos)),
  med AS (SELECT unique_id, 6 * median(r) AS h FROM res GROUP BY 1),
  y2 AS (SELECT unique_id, pos, n, y, trend, CASE WHEN r <= 0.001::DOUBLE * h THEN 1 WHEN r > 0.999::DOUBLE * h THEN 0
    ELSE (1 - (r / h) * (r / h)) * (1 - (r / h) * (r / h)) END AS rw FROM res JOIN med USING (unique_id)),
  {_stl_round_sql(2, 'trend', 'rw')},
  v AS (SELECT unique_id, var_pop(s) AS vs, var_pop(y - s - v) AS vr FROM y2 JOIN s2 USING (unique_id, pos) JOIN t2 USING (unique_id, pos) GROUP BY 1)
  SELECT unique_id, CASE WHEN max(n) < 24 THEN NULL WHEN max(variance) = 0 THEN 0.0
      WHEN max(vs) + max(vr) <= 1e-24 * max(square) THEN 0.0 ELSE round(max(vs) / (max(vs) + max(vr)), 6) END AS seasonal_strength,
    count(*) AS n_periods, CASE WHEN count(*) < 24 THEN 'insufficient_data' WHEN max(variance) = 0 THEN 'constant_series' ELSE 'success' END AS status
  FROM num LEFT JOIN v USING (unique_id) GROUP BY 1"""


@query("seasonal_strength_loess", _LOESS_SQL.replace("{series}", _CB_SERIES))
def _(t):
    """Decomposition by local regression, one alternation and one robust repetition."""
    table = loess.seasonal_strength_loess(long_series(t, _CB), inner=1, outer=1)
    return rounded(table, 6, "seasonal_strength")


_CALENDAR = """cal AS (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds FROM s GROUP BY 1),
  full_s AS (SELECT cal.unique_id, cal.ds, y FROM cal LEFT JOIN s ON s.unique_id = cal.unique_id AND s.ds = cal.ds)"""
_FILLED = f"""{_CALENDAR},
  num AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS i FROM full_s),
  known AS (SELECT unique_id, i, y, lead(i) OVER (PARTITION BY unique_id ORDER BY i) AS i2,
    lead(y) OVER (PARTITION BY unique_id ORDER BY i) AS y2 FROM num WHERE y IS NOT NULL),
  filled AS (SELECT num.unique_id, num.ds, k.y + coalesce((k.y2 - k.y) * ((num.i - k.i) / (k.i2 - k.i)), 0) AS y
    FROM num JOIN known k ON k.unique_id = num.unique_id AND num.i >= k.i AND (num.i < k.i2 OR k.i2 IS NULL))"""


@query("seasonal_strength_alt", f"""WITH s AS ({_CB_SERIES}), {_FILLED}, {_DECOMP.format(source='filled')}
  SELECT unique_id, CASE WHEN count(*) >= 24 AND var_samp(seas + rem) > 1e-24 * avg(y * y) THEN round(1 - var_samp(rem) / nullif(var_samp(seas + rem), 0), 6) END AS seasonal_strength
  FROM parts GROUP BY 1""")
def _(t):
    return rounded(features.seasonal_strength_alt(long_series(t, _CB)), 6, "seasonal_strength")


@query("calendar_complete", f"WITH s AS ({_SKU_SERIES}), {_CALENDAR} SELECT * FROM full_s")
def _(t):
    return features.calendar_complete(long_series(t, _SKU))


@query("linear_interpolate", f"WITH s AS ({_SKU_SERIES}), {_FILLED} SELECT unique_id, ds, y FROM filled")
def _(t):
    return features.linear_interpolate(features.calendar_complete(long_series(t, _SKU)))


@query("season_overlay", f"""WITH top AS (SELECT unique_id, round(stddev_samp(v) / nullif(avg(v), 0), 6) AS monthly_cv
    FROM {_month_means_sql(_CB_SERIES)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12),
  c AS (SELECT unique_id, round(stddev_samp(y) / nullif(avg(y), 0), 6) AS cv FROM ({_CB_SERIES}) GROUP BY 1)
  SELECT unique_id, CAST(year(ds) AS INT) AS year, CAST(month(ds) AS INT) AS month, y AS sales, cv
  FROM ({_CB_SERIES}) JOIN c USING (unique_id) WHERE unique_id IN (SELECT unique_id FROM top)""")
def _(t):
    from tallyline.operators.charts import season_overlay
    return rounded(season_overlay(long_series(t, _CB), 12), 6, "cv")

