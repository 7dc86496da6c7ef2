"""Registered queries: model preparation, forecasts, merge and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import key_concat
from tallyline.lineage import cut
from tallyline.operators import arima, backtest, forecast, prefix_backtest
from tallyline.plans import forecast_cycle
from tallyline.functions.numeric import is_finite
from tallyline.plans.registry import QUERIES, AS_OF, query, rounded, sales_sql, series_sql
from tallyline.sources.tables import Tables, long_series, location_hierarchy, monthly_sales

_CB = ["country", "franchise"]
_SKU = ["catalog_number"]
_CB_SERIES = series_sql(_CB)
_SKU_SERIES = series_sql(_SKU)
# Dense at every scale, so that fitted values are no short decimals and rounding has no ties.
_RB = ["region", "franchise"]
_RB_SERIES = series_sql(_RB)
_W = "WINDOW w AS (PARTITION BY unique_id ORDER BY ds)"


def _history(t: Tables) -> DataFrame:
    """Country x franchise history, the franchise standing for the catalog number."""
    sales = monthly_sales(t, _CB, ["act_orders_rev", "act_orders_rev_val"])
    return sales.withColumnRenamed("franchise", "catalog_number").withColumn(
        "unique_id", key_concat("country", "catalog_number"))


def _brand_levels(t: Tables) -> DataFrame:
    """One hierarchy row per franchise."""
    return t("part").groupBy(F.col("p_brand").alias("catalog_number")).agg(
        F.min("p_type").alias("business_unit"), F.min("p_name").alias("product_line"))


_HISTORY_SQL = f"""SELECT country, franchise AS catalog_number, sales_date, act_orders_rev, act_orders_rev_val,
  country || ',' || franchise AS unique_id FROM ({sales_sql(_CB, ['act_orders_rev', 'act_orders_rev_val'])})"""


def _capped_sql(source: str) -> str:
    low, high = "q1 - (q3 - q1) * 1.5::DOUBLE", "q3 + (q3 - q1) * 1.5::DOUBLE"
    return f"""SELECT unique_id, ds, round(CASE WHEN y < {low} THEN {low} WHEN y > {high} THEN {high} ELSE y END, 5) AS y
      FROM (SELECT *, list_sort(list(y) OVER p)[CAST(floor((count(*) OVER p - 1) * 0.25 + 0.5) AS INT) + 1] AS q1,
        list_sort(list(y) OVER p)[CAST(floor((count(*) OVER p - 1) * 0.75 + 0.5) AS INT) + 1] AS q3
        FROM ({source}) WHERE ds BETWEEN TIMESTAMP '1998-08-01' AND TIMESTAMP '2001-07-01' WINDOW p AS (PARTITION BY unique_id))"""


@query("model_input", _capped_sql(_CB_SERIES))
def _(t):
    return rounded(forecast.model_input(_history(t), AS_OF), 5, "y")


@query("future_frame", f"""SELECT unique_id, ds, CAST(month(ds) AS INT) AS month,
  CAST(date_diff('day', DATE '2021-01-01', CAST(ds AS DATE)) AS INT) AS days FROM (SELECT unique_id,
    unnest(generate_series(max(ds) + INTERVAL 1 MONTH, max(ds) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS ds
    FROM ({_SKU_SERIES}) GROUP BY 1)""")
def _(t):
    return forecast.future_frame(long_series(t, _SKU), 12)


@query("train_features", f"""SELECT *, CAST(month(ds) AS INT) AS month,
  CAST(date_diff('day', DATE '2021-01-01', CAST(ds AS DATE)) AS INT) AS days, coalesce(lag(y, 12) OVER w, y) AS lag12
  FROM ({_SKU_SERIES}) {_W}""")
def _(t):
    return forecast.train_features(long_series(t, _SKU))


def _naive_sql(source: str, horizon: int) -> str:
    return f"""SELECT e.unique_id, e.last + h * INTERVAL 1 MONTH AS ds, v.y AS seasonal_naive
      FROM (SELECT unique_id, max(ds) AS last, count(*) AS n FROM ({source}) GROUP BY 1) e
      CROSS JOIN (SELECT unnest(range(1, {horizon + 1})) AS h)
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS i FROM ({source})) v
        ON v.unique_id = e.unique_id AND v.i = e.n - 11 + (h - 1) % 12"""


@query("seasonal_naive", _naive_sql(_SKU_SERIES, 60))
def _(t):
    return forecast.seasonal_naive(long_series(t, _SKU), 60)


def _trend_sql(source: str, horizon: int) -> str:
    axis = "(year({0}) * 12 + month({0}) - 1)"
    return f"""SELECT f.unique_id, f.ds, a + b * {axis.format('f.ds')} + coalesce(o, 0) AS linear_trend
      FROM (SELECT unique_id, unnest(generate_series(max(ds) + INTERVAL 1 MONTH, max(ds) + INTERVAL {horizon} MONTH, INTERVAL 1 MONTH)) AS ds
        FROM ({source}) GROUP BY 1) f
      JOIN (SELECT unique_id, coalesce(covar_pop(y, {axis.format('ds')}) / nullif(var_pop({axis.format('ds')}), 0), 0) AS b,
        avg(y) - coalesce(covar_pop(y, {axis.format('ds')}) / nullif(var_pop({axis.format('ds')}), 0), 0) * avg({axis.format('ds')}) AS a
        FROM ({source}) GROUP BY 1) l ON l.unique_id = f.unique_id
      LEFT JOIN (SELECT s.unique_id, month(s.ds) AS m, avg(s.y - a - b * {axis.format('s.ds')}) AS o FROM ({source}) s
        JOIN (SELECT unique_id, coalesce(covar_pop(y, {axis.format('ds')}) / nullif(var_pop({axis.format('ds')}), 0), 0) AS b,
          avg(y) - coalesce(covar_pop(y, {axis.format('ds')}) / nullif(var_pop({axis.format('ds')}), 0), 0) * avg({axis.format('ds')}) AS a
          FROM ({source}) GROUP BY 1) r ON r.unique_id = s.unique_id GROUP BY 1, 2) p
        ON p.unique_id = f.unique_id AND p.m = month(f.ds)"""


@query("linear_trend_fc", f"SELECT unique_id, ds, round(linear_trend, 1) AS linear_trend FROM ({_trend_sql(_RB_SERIES, 60)})")
def _(t):
    return rounded(forecast.linear_trend(long_series(t, _RB), 60), 1, "linear_trend")


_BOTH_SQL = f"""SELECT * FROM ({_naive_sql(_RB_SERIES, 24)}) FULL JOIN
  (SELECT unique_id, ds, linear_trend FROM ({_trend_sql(_RB_SERIES, 36)})) USING (unique_id, ds)"""


def _both(t: Tables) -> DataFrame:
    series = long_series(t, _RB)
    return forecast.join_models(forecast.seasonal_naive(series, 24), forecast.linear_trend(series, 36))


@query("model_full_join", f"SELECT unique_id, ds, seasonal_naive, round(linear_trend, 1) AS linear_trend FROM ({_BOTH_SQL})")
def _(t):
    return rounded(_both(t), 1, "linear_trend")


@query("ensemble_mean", f"""SELECT unique_id, ds, round(CASE WHEN seasonal_naive IS NULL THEN linear_trend
  WHEN linear_trend IS NULL THEN seasonal_naive ELSE (seasonal_naive + linear_trend) / 2 END, 1) AS ensemble FROM ({_BOTH_SQL})""")
def _(t):
    table = forecast.ensemble_mean(_both(t), ["seasonal_naive", "linear_trend"])
    return rounded(table.select("unique_id", "ds", "ensemble"), 1, "ensemble")


@query("robust_scale", f"""WITH s AS ({_SKU_SERIES}), q AS (SELECT unique_id, quantile_cont(y, 0.5) AS centre,
    quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM s GROUP BY 1)
  SELECT unique_id, ds, y, round(centre, 5) AS centre, round(CASE WHEN iqr > 0 THEN iqr ELSE 1 END, 6) AS scale,
    round((y - centre) / CASE WHEN iqr > 0 THEN iqr ELSE 1 END, 6) AS scaled FROM s JOIN q USING (unique_id)""")
def _(t):
    return rounded(rounded(forecast.robust_scale(long_series(t, _SKU)), 5, "centre"), 6, "scale", "scaled")


# --- enrich and merge ----------------------------------------------------------------------------

_BRAND_SQL = "SELECT p_brand AS catalog_number, min(p_type) AS business_unit, min(p_name) AS product_line FROM part GROUP BY 1"
_PLACE_SQL = """SELECT DISTINCT n_name AS country, r_name AS group_region, r_name AS area, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey"""
_ENRICHED_SQL = f"""SELECT unique_id, ds AS sales_date, seasonal_naive, country, catalog_number, business_unit, product_line,
    group_region, area, region
  FROM (SELECT *, split_part(unique_id, ',', 1) AS country, split_part(unique_id, ',', 2) AS catalog_number
    FROM ({_naive_sql(_CB_SERIES, 12)}))
  LEFT JOIN ({_BRAND_SQL}) USING (catalog_number) LEFT JOIN ({_PLACE_SQL}) USING (country)"""


def _enriched(t: Tables, group_region: str | None = None) -> DataFrame:
    fc = forecast.seasonal_naive(long_series(t, _CB), 12)
    return forecast_cycle.forecast_enrich(fc, _brand_levels(t), location_hierarchy(t), group_region)


@query("forecast_enrich", f"SELECT * FROM ({_ENRICHED_SQL}) WHERE group_region = 'EUROPE'")
def _(t):
    return _enriched(t, "EUROPE")


_MERGED_COLUMNS = "unique_id, sales_date, country, catalog_number, act_orders_rev, act_orders_rev_val, seasonal_naive"


@query("forecast_merge", f"""WITH h AS ({_HISTORY_SQL}), f AS (SELECT * FROM ({_ENRICHED_SQL}) WHERE group_region = 'EUROPE')
  SELECT {_MERGED_COLUMNS}, business_unit, region FROM (SELECT * FROM h WHERE unique_id IN (SELECT unique_id FROM f))
  FULL JOIN f USING (unique_id, sales_date, country, catalog_number)""")
def _(t):
    merged = forecast_cycle.forecast_merge(_history(t), _enriched(t, "EUROPE"), ["seasonal_naive"])
    return merged.select(*_MERGED_COLUMNS.split(", "), "business_unit", "region")


@query("forecast_merge_all", f"""WITH h AS (SELECT *, CASE WHEN month(sales_date) = 1 THEN catalog_number END AS raw FROM ({_HISTORY_SQL})),
  f AS (SELECT * FROM ({_ENRICHED_SQL}) WHERE group_region = 'EUROPE'),
  m AS (SELECT {_MERGED_COLUMNS}, raw FROM (SELECT * FROM h WHERE unique_id IN (SELECT unique_id FROM f))
    FULL JOIN f USING (unique_id, sales_date, country, catalog_number)
    UNION ALL SELECT unique_id, sales_date, country, catalog_number, act_orders_rev, act_orders_rev_val, NULL, raw
    FROM h WHERE unique_id NOT IN (SELECT unique_id FROM f))
  SELECT {_MERGED_COLUMNS}, max(raw) OVER (PARTITION BY unique_id) AS cluster FROM m""")
def _(t):
    history = _history(t).withColumn(
        "cluster", F.when(F.month("sales_date") == 1, F.col("catalog_number")))
    merged = forecast_cycle.forecast_merge(history, _enriched(t, "EUROPE"), ["seasonal_naive"], keep_unforecast=True)
    return merged.select(*_MERGED_COLUMNS.split(", "), "cluster")


@query("forecast_vs_published", f"""WITH s AS ({sales_sql(['country'], ['act_orders_rev', 'fcst_df_final_rev', 'fcst_stat_final_rev'])}),
  n AS (SELECT * FROM s WHERE sales_date >= TIMESTAMP '2000-08-01' AND sales_date < TIMESTAMP '2001-08-01')
  SELECT 'DF' AS name, 'line' AS kind, CAST(month(sales_date) AS INT) AS month, round(sum(fcst_df_final_rev), 4) AS value,
    TIMESTAMP '2000-10-01' AS marker FROM n GROUP BY 3
  UNION ALL SELECT 'Stat', 'line', CAST(month(sales_date) AS INT), round(sum(fcst_stat_final_rev), 4), TIMESTAMP '2000-10-01' FROM n GROUP BY 3
  UNION ALL SELECT CAST(year(sales_date) AS VARCHAR), 'bar', CAST(month(sales_date) AS INT), round(sum(act_orders_rev), 4),
    TIMESTAMP '2000-10-01' FROM s GROUP BY 1, 3""")
def _(t):
    sales = monthly_sales(t, ["country"], ["act_orders_rev", "fcst_df_final_rev", "fcst_stat_final_rev"])
    return forecast_cycle.forecast_vs_published(
        sales, "2000-08-15", "act_orders_rev", [("fcst_df_final_rev", "DF"), ("fcst_stat_final_rev", "Stat")])


# --- validation ----------------------------------------------------------------------------------


def _errors_sql(source: str, actual: str, model: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}count(*) AS n, round(avg(abs({actual} - {model})), 1) AS mae,
      round(sqrt(avg(({actual} - {model}) * ({actual} - {model}))), 1) AS rmse,
      round(avg(abs({actual} - {model}) / nullif(abs({actual}), 0)), 6) AS mape
      FROM ({source}) WHERE {actual} IS NOT NULL AND {model} IS NOT NULL {'GROUP BY ' + by if by else ''}"""


def _errors(table: DataFrame) -> DataFrame:
    return rounded(rounded(table.drop("mse"), 1, "mae", "rmse"), 6, "mape")


@query("error_metrics", _errors_sql(
    f"SELECT * FROM ({sales_sql(_CB, ['act_orders_rev', 'fcst_stat_final_rev'])})", "act_orders_rev", "fcst_stat_final_rev", "country"))
def _(t):
    sales = monthly_sales(t, _CB, ["act_orders_rev", "fcst_stat_final_rev"])
    return _errors(backtest.error_metrics(sales, "act_orders_rev", "fcst_stat_final_rev", ["country"]))


def _origin_sql(origin: int, last_train: str, last_test: str) -> str:
    train = f"SELECT * FROM ({_CB_SERIES}) WHERE ds <= TIMESTAMP '{last_train}'"
    return f"""SELECT CAST({origin} AS INT) AS origin, a.unique_id, a.ds, a.y AS actual, p.seasonal_naive AS forecast FROM
      (SELECT * FROM ({_CB_SERIES}) WHERE ds > TIMESTAMP '{last_train}' AND ds <= TIMESTAMP '{last_test}') a
      JOIN ({_naive_sql(train, 6)}) p ON p.unique_id = a.unique_id AND p.ds = a.ds"""


_BACKTEST_SQL = " UNION ALL ".join([
    _origin_sql(0, "2001-01-01", "2001-07-01"), _origin_sql(1, "2000-07-01", "2001-01-01"),
    _origin_sql(2, "2000-01-01", "2000-07-01")])


@query("backtest", _BACKTEST_SQL)
def _(t):
    return backtest.backtest(
        long_series(t, _CB), forecast.seasonal_naive, AS_OF, "seasonal_naive", origins=3)


@query("backtest_errors", _errors_sql(_BACKTEST_SQL, "actual", "forecast", "origin"))
def _(t):
    table = backtest.backtest(long_series(t, _CB), forecast.seasonal_naive, AS_OF, "seasonal_naive", origins=3)
    return _errors(backtest.error_metrics(table, "actual", "forecast", ["origin"]))


@query("backtest_models")
def _(t):
    # Written once, or each of the four back-tests would join and sum the order lines again.
    series = cut(long_series(t, _CB))
    parts = [
        backtest.error_metrics(
            backtest.backtest(series, model, AS_OF, name, origins=2),
            "actual", "forecast", ["origin"]).withColumn("model", F.lit(name))
        for name, model in (
            ("seasonal_naive", forecast.seasonal_naive),
            ("linear_trend", forecast.linear_trend),
            ("exp_smoothing", forecast.exp_smoothing),
        )
    ]
    pooled, _ = prefix_backtest.backtest_prefix(series, AS_OF, origins=2)
    parts.append(backtest.error_metrics(pooled, "actual", "forecast", ["origin"]).withColumn("model", F.lit("lag_regression")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# The pooled regression on the lags 1 and 12 at four origins: each origin's equations of two unknowns in closed form.
_PREFIX_SQL = f"""WITH RECURSIVE s AS ({_RB_SERIES}),
  o(origin, cut) AS (VALUES (0, TIMESTAMP '2001-01-01'), (1, TIMESTAMP '2000-10-01'), (2, TIMESTAMP '2000-07-01'), (3, TIMESTAMP '2000-04-01')),
  tr AS (SELECT origin, cut, unique_id, ds, y, avg(y) OVER p AS c, stddev_pop(y) OVER p AS sd FROM s JOIN o ON ds <= cut
    WINDOW p AS (PARTITION BY origin, unique_id)),
  z AS (SELECT *, CASE WHEN sd > 0 THEN sd ELSE 1 END AS sc, (y - c) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM tr),
  l AS (SELECT *, lag(z, 1) OVER w AS a, lag(z, 12) OVER w AS b FROM z WINDOW w AS (PARTITION BY origin, unique_id ORDER BY ds)),
  m AS (SELECT origin, avg(a) AS ma, avg(b) AS mb, avg(z) AS mz, avg(a * a) - avg(a) * avg(a) AS va, avg(b * b) - avg(b) * avg(b) AS vb,
    avg(a * b) - avg(a) * avg(b) AS ab, avg(a * z) - avg(a) * avg(z) AS az, avg(b * z) - avg(b) * avg(z) AS bz
    FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
  w AS (SELECT origin, mz, ma, mb, (az * vb * 1.01::DOUBLE - bz * ab) / (va * vb * 1.01::DOUBLE * 1.01::DOUBLE - ab * ab) AS w1,
    (bz * va * 1.01::DOUBLE - az * ab) / (va * vb * 1.01::DOUBLE * 1.01::DOUBLE - ab * ab) AS w12 FROM m)"""


@query("backtest_prefix_weights", f"""{_PREFIX_SQL} SELECT CAST(origin AS INT) AS origin, round(w1, 7) AS w1, round(w12, 7) AS w12,
  round(mz - w1 * ma - w12 * mb, 7) AS intercept FROM w""")
def _(t):
    _, weights = prefix_backtest.backtest_prefix(long_series(t, _RB), AS_OF, origins=4, step=3, lags=(1, 12))
    table = weights.select("origin", F.get("weights", F.lit(0)).alias("w1"), F.get("weights", F.lit(1)).alias("w12"), "intercept")
    return rounded(table, 7, "w1", "w12", "intercept")


@query("backtest_prefix", f"""{_PREFIX_SQL},
  f(origin, unique_id, cut, last, c, sc, zs, h) AS (
    SELECT origin, unique_id, max(cut), max(ds), max(c), max(sc), list(z ORDER BY ds), 0 FROM z GROUP BY 1, 2
    UNION ALL SELECT f.origin, f.unique_id, cut, last, c, sc, list_append(zs, mz - w1 * ma - w12 * mb + w1 * zs[-1]
      + w12 * CASE WHEN len(zs) >= 12 THEN zs[-12] ELSE 0 END), h + 1 FROM f JOIN w ON w.origin = f.origin WHERE h < 6)
  SELECT CAST(origin AS INT) AS origin, f.unique_id, ds, y AS actual, round(zs[-1] * sc + c, 3) AS forecast
  FROM f JOIN s ON s.unique_id = f.unique_id AND ds > cut AND ds <= cut + INTERVAL 6 MONTH
    AND ds = last + to_months(CAST(h AS INT)) WHERE h > 0""")
def _(t):
    """Every held-out month of every origin, all origins from the same running sums."""
    table, _ = prefix_backtest.backtest_prefix(long_series(t, _RB), AS_OF, origins=4, step=3, lags=(1, 12))
    return rounded(table, 3, "forecast")


# --- models checked by rows and by the invariants in the tests -----------------------------------


@query("tree_fc")
def _(t):
    return forecast.tree_forecast(long_series(t, _CB), 12)


@query("forest_fc")
def _(t):
    return forecast.tree_forecast(long_series(t, _CB), 12, "forest", name="forest")


@query("voting_fc")
def _(t):
    return forecast.voting_forecast(long_series(t, _CB), 12)


@query("recursive_fc")
def _(t):
    series = long_series(t, _CB)
    return forecast.recursive_forecast(series, forecast.tree_predictor(forecast.fit_trees(series)))


@query("lag_regression_fc")
def _(t):
    return forecast.lag_regression(long_series(t, _CB), 56)


_GRID_SQL = ", ".join(f"({i}, {a}, {b}, {g})" for i, (a, b, g) in enumerate(forecast.SMOOTHING_GRID))


@query("exp_smoothing_fc", f"""WITH RECURSIVE s AS ({_CB_SERIES}),
  h AS (SELECT unique_id, max(ds) AS last, list(coalesce(y, 0) ORDER BY ds) AS ys FROM s GROUP BY 1),
  st AS (SELECT *, len(ys) >= 24 AS ok, list_sum(ys[1:12]) / len(ys[1:12]) AS m1, list_sum(ys[13:24]) / len(ys[13:24]) AS m2 FROM h),
  grid(i, a, b, g) AS (VALUES {_GRID_SQL}),
  fold(unique_id, i, a, b, g, rest, level, trend, season, sse, last) AS (
    SELECT unique_id, i, a, CASE WHEN ok THEN b ELSE 0 END, CASE WHEN ok THEN g ELSE 0 END,
      CASE WHEN ok THEN ys[13:] ELSE ys END, CASE WHEN ok THEN m1 ELSE ys[1] END,
      CASE WHEN ok THEN (m2 - m1) / 12 ELSE 0 END,
      CASE WHEN ok THEN list_transform(ys[1:12], lambda y: y - m1) ELSE list_transform(range(12), lambda z: CAST(0 AS DOUBLE)) END,
      CAST(0 AS DOUBLE), last FROM st, grid
    UNION ALL SELECT unique_id, i, a, b, g, rest[2:], level + trend + a * e, trend + b * a * e,
      list_append(season[2:12], season[1] + g * (1 - a) * e), sse + e * e, last
    FROM (SELECT *, rest[1] - (level + trend + season[1]) AS e FROM fold WHERE len(rest) > 0)),
  best AS (SELECT * FROM fold WHERE len(rest) = 0 QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY sse, i) = 1)
  SELECT unique_id, CAST(last + to_months(CAST(k AS INT)) AS TIMESTAMP) AS ds,
    round(level + k * trend + season[(k - 1) % 12 + 1], 3) AS exp_smoothing
  FROM (SELECT *, unnest(range(1, 61)) AS k FROM best)""")
def _(t):
    return rounded(forecast.exp_smoothing(long_series(t, _CB), 60), 3, "exp_smoothing")


_ARIMA_PAIR = """CASE WHEN {a}{a} * {b}{b} - {x} * {x} > 1e-9::DOUBLE * {a}{a} * {b}{b}
  THEN ({a}w * {b}{b} - {b}w * {x}) / ({a}{a} * {b}{b} - {x} * {x}) ELSE 0 END"""


def _arima_candidate(place: int, order: str, one: str = "", two: str = "", cross: str = "") -> str:
    """A row per series with an order's coefficients (a: autoregression, m: innovation, s: a season before) and AICc."""
    weights = {"a": "CAST(0 AS DOUBLE)", "m": "CAST(0 AS DOUBLE)", "s": "CAST(0 AS DOUBLE)"}
    if two:
        weights[one] = _ARIMA_PAIR.format(a=one, b=two, x=cross)
        weights[two] = _ARIMA_PAIR.format(a=two, b=one, x=cross)
    elif one:
        weights[one] = f"CASE WHEN {one}{one} > 0 THEN {one}w / {one}{one} ELSE 0 END"
    k = 1 + bool(one) + bool(two)
    return f"""SELECT unique_id, place, ord, wa, wm, wsm, n * ln(greatest(ww - wa * aw - wm * mw - wsm * sw, 1e-9::DOUBLE * ww) / n)
        + {2 * k} + {2.0 * k * (k + 1)}::DOUBLE / (n - {k} - 1) AS aicc
      FROM (SELECT *, {place} AS place, '{order}' AS ord, {weights['a']} AS wa, {weights['m']} AS wm, {weights['s']} AS wsm FROM sums)
      WHERE n >= 12 + {k} AND ww > 0"""


_ARIMA_SQL = f"""WITH RECURSIVE s AS ({_CB_SERIES}),
  d AS (SELECT *, y - lag(y, 12) OVER w AS w FROM s {_W}),
  l AS (SELECT *, lag(w, 1) OVER w AS w1, lag(w, 2) OVER w AS w2 FROM d {_W}),
  g AS (SELECT unique_id, coalesce(sum(w1 * w1) FILTER (WHERE w2 IS NOT NULL), 0) AS aa, coalesce(sum(w2 * w2), 0) AS bb,
    coalesce(sum(w1 * w2), 0) AS ab, coalesce(sum(w1 * w) FILTER (WHERE w2 IS NOT NULL), 0) AS aw, coalesce(sum(w2 * w), 0) AS bw FROM l GROUP BY 1),
  e AS (SELECT l.*, w - w1 * {_ARIMA_PAIR.format(a='a', b='b', x='ab')} - w2 * {_ARIMA_PAIR.format(a='b', b='a', x='ab')} AS e FROM l JOIN g USING (unique_id)),
  r AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 12) OVER w AS e12 FROM e {_W}),
  sums AS (SELECT unique_id, CAST(count(*) AS DOUBLE) AS n, sum(w * w) AS ww, sum(w1 * w) AS aw, sum(e1 * w) AS mw, sum(e12 * w) AS sw, sum(w1 * w1) AS aa,
    sum(e1 * e1) AS mm, sum(e12 * e12) AS ss, sum(w1 * e1) AS am, sum(w1 * e12) AS xs, sum(e1 * e12) AS ms FROM r
    WHERE w1 IS NOT NULL AND e1 IS NOT NULL AND e12 IS NOT NULL AND e IS NOT NULL GROUP BY 1),
  c AS ({' UNION ALL '.join([
      _arima_candidate(0, '(0,0,0)(0,1,0)'), _arima_candidate(1, '(1,0,0)(0,1,0)', 'a'), _arima_candidate(2, '(0,0,1)(0,1,0)', 'm'),
      _arima_candidate(3, '(0,0,0)(0,1,1)', 's'), _arima_candidate(4, '(1,0,1)(0,1,0)', 'a', 'm', 'am'),
      _arima_candidate(5, '(1,0,0)(0,1,1)', 'a', 's', 'xs'), _arima_candidate(6, '(0,0,1)(0,1,1)', 'm', 's', 'ms')])}),
  best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY round(aicc, 9), place) = 1)"""


@query("arima_orders", f"""{_ARIMA_SQL} SELECT sums.unique_id, ord AS "order", round(wa, 6) AS ar1, round(wm, 6) AS ma1, round(wsm, 6) AS sma1
  FROM sums LEFT JOIN best USING (unique_id)""")
def _(t):
    return rounded(arima.fit(long_series(t, _CB)), 6, "ar1", "ma1", "sma1")


@query("arima_fc", f"""{_ARIMA_SQL},
  h AS (SELECT unique_id, max(ds) AS last, list(y ORDER BY ds) AS ys, list(coalesce(w, 0) ORDER BY ds) AS ws, list(coalesce(e, 0) ORDER BY ds) AS es FROM r GROUP BY 1),
  f(unique_id, k, ys, ws, es, wa, wm, wsm, last) AS (
    SELECT h.unique_id, 0, ys, ws, es, coalesce(wa, 0), coalesce(wm, 0), coalesce(wsm, 0), last FROM h LEFT JOIN best ON best.unique_id = h.unique_id
    UNION ALL SELECT unique_id, k + 1, list_append(ys, CASE WHEN len(ys) >= 12 THEN ys[-12] + x END), list_append(ws, x), list_append(es, CAST(0 AS DOUBLE)), wa, wm, wsm, last
    FROM (SELECT *, wa * ws[-1] + wm * es[-1] + wsm * CASE WHEN len(es) >= 12 THEN es[-12] ELSE 0 END AS x FROM f WHERE k < 36))
  SELECT unique_id, CAST(last + to_months(k) AS TIMESTAMP) AS ds, round(ys[-1], 3) AS arima FROM f WHERE k > 0""")
def _(t):
    return rounded(arima.arima(long_series(t, _CB), 36), 3, "arima")


_BOOST_STEP = "{w} - coalesce(0.5::DOUBLE * ({s} * b + {g1} * w1 + {g2} * w2 + {g3} * w3 - {c}) / nullif({g}, 0), 0)"


@query("linear_boost_fc", f"""WITH RECURSIVE s AS ({_RB_SERIES}),
  f AS (SELECT unique_id, ds, y, CAST(month(ds) AS DOUBLE) AS m, CAST(date_diff('day', DATE '2021-01-01', CAST(ds AS DATE)) AS DOUBLE) AS d,
    coalesce(lag(y, 12) OVER w, y) AS l, avg(y) OVER (PARTITION BY unique_id) AS base FROM s {_W}),
  g AS (SELECT unique_id, max(ds) AS last, max(base) AS base, count(*) AS n, sum(m) AS sm, sum(d) AS sd, sum(l) AS sl,
    sum(m * (y - base)) AS cm, sum(d * (y - base)) AS cd, sum(l * (y - base)) AS cl, sum(m * m) AS mm, sum(m * d) AS md,
    sum(m * l) AS ml, sum(d * d) AS dd, sum(d * l) AS dl, sum(l * l) AS ll, list(y ORDER BY ds) AS ys FROM f GROUP BY 1),
  r(unique_id, k, b, w1, w2, w3) AS (
    SELECT unique_id, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM g
    UNION ALL SELECT unique_id, k, b, w1, w2, {_BOOST_STEP.format(w='w3', s='sl', g1='ml', g2='dl', g3='ll', c='cl', g='ll')} FROM (
      SELECT * REPLACE ({_BOOST_STEP.format(w='w2', s='sd', g1='md', g2='dd', g3='dl', c='cd', g='dd')} AS w2) FROM (
        SELECT * REPLACE ({_BOOST_STEP.format(w='w1', s='sm', g1='mm', g2='md', g3='ml', c='cm', g='mm')} AS w1) FROM (
          SELECT g.*, k + 1 AS k, b - 0.5::DOUBLE * (b + (sm * w1 + sd * w2 + sl * w3) / n) AS b, w1, w2, w3
          FROM r JOIN g ON g.unique_id = r.unique_id WHERE k < 100)))),
  p(unique_id, h, zs) AS (SELECT unique_id, 0, ys FROM g
    UNION ALL SELECT p.unique_id, h + 1, list_append(zs, base + b + w1 * month(last + to_months(h + 1))
      + w2 * date_diff('day', DATE '2021-01-01', CAST(last + to_months(h + 1) AS DATE)) + w3 * CASE WHEN len(zs) >= 12 THEN zs[-12] ELSE base END)
    FROM p JOIN g ON g.unique_id = p.unique_id JOIN r ON r.unique_id = p.unique_id AND r.k = 100 WHERE h < 60)
  SELECT p.unique_id, CAST(last + to_months(h) AS TIMESTAMP) AS ds, round(zs[-1], 2) AS linear_boost
  FROM p JOIN g ON g.unique_id = p.unique_id WHERE h > 0""")
def _(t):
    return rounded(forecast.linear_boost(long_series(t, _RB), 60), 2, "linear_boost")


@query("cluster_models")
def _(t):
    # One brand has no label, to show that it is left out.
    series = long_series(t, _CB).withColumn("cluster", F.substring_index("unique_id", ",", -1)).withColumn(
        "cluster", F.when(F.col("cluster") != "Brand#7", F.col("cluster")))
    return forecast.cluster_models(series, 12)


def _frame_sql(horizon: int, where: str = "", label: str = "") -> str:
    """What SQL can state of a fitted model: a row for each series and month of the horizon, with a finite value."""
    return f"""SELECT unique_id, {label} CAST(unnest(generate_series(max(ds) + INTERVAL 1 MONTH,
      max(ds) + INTERVAL {horizon} MONTH, INTERVAL 1 MONTH)) AS TIMESTAMP) AS ds, true AS finite
      FROM ({_CB_SERIES}) {where} GROUP BY unique_id"""


def _frame(table: DataFrame, name: str) -> DataFrame:
    return table.withColumn("finite", is_finite(name)).drop(name)


@query("lag_regression_frame", _frame_sql(56))
def _(t):
    return _frame(forecast.lag_regression(long_series(t, _CB), 56), "lag_regression")


@query("cluster_models_frame", _frame_sql(
    12, "WHERE unique_id NOT LIKE '%,Brand#7'", "split_part(unique_id, ',', 2) AS cluster,"))
def _(t):
    return _frame(QUERIES["cluster_models"](t.spark, t.folder), "lag_regression")


@query("tree_frame", _frame_sql(12))
def _(t):
    return _frame(forecast.tree_forecast(long_series(t, _CB), 12), "tree")


@query("forecast_cycle")
def _(t):
    merged, _ = forecast_cycle.run_cycle(_history(t), _brand_levels(t), location_hierarchy(t), AS_OF, validate=False)
    return merged


@query("forecast_cycle_scores")
def _(t):
    """The validation half of the same run."""
    _, scores = forecast_cycle.run_cycle(_history(t), _brand_levels(t), location_hierarchy(t), AS_OF)
    return scores

