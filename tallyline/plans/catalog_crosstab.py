"""Registered queries: cross-tab aggregators, totals, order and scales; chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators import charts
from tallyline.operators.crosstab import bar_scale, crosstab, heatmap_scale, ordered
from tallyline.operators.user_aggregates import GeometricMean, Mode
from tallyline.plans.registry import lines_sql, query, rounded, sales_sql
from tallyline.sources.tables import monthly_sales, sales_lines

ROWS, COLS = ["region", "franchise"], ["status"]
_KEYS = ["region", "franchise", "status"]
_LINES = f"({lines_sql([*_KEYS, 'priority', 'return_flag'])})"
_SETS = "GROUP BY GROUPING SETS ((region, franchise, status), (region, franchise), (status), ())"
_LEVEL = "CAST(2 * grouping(region) + grouping(status) AS INT) AS level"
_HEAD = f"region, franchise, status, {_LEVEL}"


def _lines(t):
    return sales_lines(t, [*_KEYS, "priority", "return_flag"])


def _xt(name: str, aggregator: str, vals: list[str], sql: str, digits: int | None = None, **options) -> None:
    """Register one aggregator over the order lines; ``sql`` lists the aggregated columns."""
    columns = vals if aggregator in _ONE_INPUT else ["value"]

    @query(name, f"SELECT {_HEAD}, {sql} FROM {_LINES} {_SETS}")
    def _(t):
        table = crosstab(_lines(t), ROWS, COLS, vals, aggregator, **options)
        return table if digits is None else rounded(table, digits, *columns)


_ONE_INPUT = {
    "Count Unique Values", "List Unique Values", "Sum", "Integer Sum", "Average", "Median", "Quantile",
    "Sample Variance", "Sample Standard Deviation", "Minimum", "Maximum", "First", "Last",
    "Sum as Fraction of Total", "Sum as Fraction of Rows", "Sum as Fraction of Columns",
}
_Q, _P = "act_orders_rev_val", "fcst_stat_final_rev"

_xt("xt_count", "Count", [], "count(*) AS value")
_xt("xt_count_unique", "Count Unique Values", ["priority", "act_orders_rev_val"],
    "count(DISTINCT priority) AS priority, count(DISTINCT act_orders_rev_val) AS act_orders_rev_val")
_xt("xt_list_unique", "List Unique Values", ["priority", "return_flag"],
    "string_agg(DISTINCT priority, ', ' ORDER BY priority) AS priority, "
    "string_agg(DISTINCT return_flag, ', ' ORDER BY return_flag) AS return_flag")
_xt("xt_sum", "Sum", ["priority", "act_orders_rev_val"],
    "sum(CAST(substr(priority, 1, 1) AS DOUBLE)) AS priority, sum(act_orders_rev_val) AS act_orders_rev_val")
_xt("xt_int_sum", "Integer Sum", [_Q], f"sum({_Q}) AS {_Q}")
_xt("xt_average", "Average", [_Q], f"round(avg({_Q}), 9) AS {_Q}", 9)
_xt("xt_median", "Median", [_Q, _P], f"median({_Q}) AS {_Q}, round(median({_P}), 3) AS {_P}", 3)
_xt("xt_sample_variance", "Sample Variance", [_Q],
    f"CASE WHEN count(*) <= 1 THEN 0 ELSE round(var_samp({_Q}), 7) END AS {_Q}", 7)
_xt("xt_sample_stdev", "Sample Standard Deviation", [_Q],
    f"CASE WHEN count(*) <= 1 THEN 0 ELSE round(stddev_samp({_Q}), 7) END AS {_Q}", 7)
_xt("xt_min", "Minimum", [_P], f"min({_P}) AS {_P}")
_xt("xt_max", "Maximum", [_P], f"max({_P}) AS {_P}")
_xt("xt_first", "First", ["priority", _Q], f"min(priority) AS priority, min({_Q}) AS {_Q}")
_xt("xt_last", "Last", ["priority", _Q], f"max(priority) AS priority, max({_Q}) AS {_Q}")
_xt("xt_sum_over_sum", "Sum over Sum", ["act_orders_rev", _P],
    f"round(sum(act_orders_rev) / nullif(sum({_P}), 0), 9) AS value", 9)


def _bound_sql(sign: str) -> str:
    # Score interval of p = a / n with z = 1.2815515655446004.
    z = "1.2815515655446004::DOUBLE"
    p, n = f"(sum(act_orders_rev) / sum({_P}))", f"sum({_P})"
    return (f"round(({z} * {z} / (2 * {n}) + {p} {sign} {z} * sqrt({z} * {z} / (4 * {n} * {n}) + "
            f"{p} * (1 - {p}) / {n})) / (1 + {z} * {z} / {n}), 9) AS value")


_xt("xt_upper80", "80% Upper Bound", ["act_orders_rev", _P], _bound_sql("+"), 9)
_xt("xt_lower80", "80% Lower Bound", ["act_orders_rev", _P], _bound_sql("-"), 9)


@query("xt_quantile", f"""SELECT {_HEAD}, (list_sort(list({_Q}))[CAST(floor((count(*) - 1) * 0.8) AS BIGINT) + 1]
  + list_sort(list({_Q}))[CAST(ceil((count(*) - 1) * 0.8) AS BIGINT) + 1]) / 2 AS {_Q} FROM {_LINES} {_SETS}""")
def _(t):
    return crosstab(_lines(t), ROWS, COLS, [_Q], "Quantile", q=0.8)


def _share(name: str, aggregator: str, vals: list[str], inner: str, partition: str) -> None:
    column = vals[0] if vals else "value"
    over = {"total": "CASE WHEN level = 3 THEN v END) OVER ()",
            "row": "CASE WHEN level IN (1, 3) THEN v END) OVER (PARTITION BY region, franchise)",
            "col": "CASE WHEN level IN (2, 3) THEN v END) OVER (PARTITION BY status)"}[partition]

    @query(name, f"""SELECT region, franchise, status, level, round(v / nullif(max({over}, 0), 9) AS {column}
      FROM (SELECT {_HEAD}, {inner} AS v FROM {_LINES} {_SETS})""")
    def _(t):
        return rounded(crosstab(_lines(t), ROWS, COLS, vals, aggregator), 9, column)


for _scope, _word in (("total", "Total"), ("row", "Rows"), ("col", "Columns")):
    _share(f"xt_sum_frac_{_scope}", f"Sum as Fraction of {_word}", [_Q], f"sum({_Q})", _scope)
    _share(f"xt_count_frac_{_scope}", f"Count as Fraction of {_word}", [], "count(*)", _scope)


@query("xt_totals", f"""SELECT region, status, CAST(2 * grouping(region) + grouping(status) AS INT) AS level,
  sum({_Q}) AS {_Q} FROM {_LINES} GROUP BY CUBE (region, status)""")
def _(t):
    return crosstab(_lines(t), ["region"], ["status"], [_Q], "Sum")


@query("xt_null_keys", f"""SELECT region, status, CAST(2 * grouping(region) + grouping(status) AS INT) AS level, count(*) AS value
  FROM (SELECT region, CASE WHEN status = 'P' THEN 'null' ELSE status END AS status FROM {_LINES}) GROUP BY CUBE (region, status)""")
def _(t):
    return crosstab(_lines(t).withColumn("status", F.when(F.col("status") != "P", F.col("status"))),
                    ["region"], ["status"], [], "Count")


_CELLS = f"""(SELECT franchise, status, CAST(2 * grouping(franchise) + grouping(status) AS INT) AS level, sum({_Q}) AS {_Q}
  FROM {_LINES} GROUP BY CUBE (franchise, status))"""


def _small(t):
    return crosstab(_lines(t), ["franchise"], ["status"], [_Q], "Sum")


@query("xt_order_by_key", f"""SELECT c.*, row_rank, col_rank FROM {_CELLS} c
  LEFT JOIN (SELECT franchise, CAST(row_number() OVER (ORDER BY CAST(replace(franchise, 'Brand#', '') AS INT)) AS BIGINT) AS row_rank
    FROM {_CELLS} WHERE level = 1) r USING (franchise)
  LEFT JOIN (SELECT status, CAST(row_number() OVER (ORDER BY CASE status WHEN 'P' THEN 0 ELSE 1 END, status) AS BIGINT) AS col_rank
    FROM {_CELLS} WHERE level = 2) k USING (status)""")
def _(t):
    return ordered(_small(t), ["franchise"], ["status"], sorters={"status": ["P"]})


@query("xt_order_by_value", f"""SELECT c.*, row_rank, col_rank FROM {_CELLS} c
  LEFT JOIN (SELECT franchise, CAST(row_number() OVER (ORDER BY {_Q} DESC, CAST(replace(franchise, 'Brand#', '') AS INT)) AS BIGINT) AS row_rank
    FROM {_CELLS} WHERE level = 1) r USING (franchise)
  LEFT JOIN (SELECT status, CAST(row_number() OVER (ORDER BY {_Q}, status) AS BIGINT) AS col_rank
    FROM {_CELLS} WHERE level = 2) k USING (status)""")
def _(t):
    return ordered(_small(t), ["franchise"], ["status"], _Q, "value_z_to_a", "value_a_to_z")


@query("xt_multi_value", f"""SELECT {_HEAD}, sum({_Q}) AS {_Q}, round(sum({_P}), 4) AS {_P},
  round(sum(act_orders_rev), 4) AS act_orders_rev FROM {_LINES} {_SETS}""")
def _(t):
    return rounded(crosstab(_lines(t), ROWS, COLS, [_Q, _P, "act_orders_rev"], "Sum"), 4, _P, "act_orders_rev")


def _heat_sql(scope: str) -> str:
    keys = {"table": "level", "row": "level, CASE WHEN level = 0 THEN franchise END",
            "col": "level, CASE WHEN level = 0 THEN status END"}[scope]
    x = f"({_Q} - min({_Q}) OVER p) / nullif(max({_Q}) OVER p - min({_Q}) OVER p, 0)"
    return f"""SELECT *, CASE WHEN level < 3 THEN CAST(255 - floor(255 * {x} + 0.5) AS INT) END AS shade
      FROM {_CELLS} WINDOW p AS (PARTITION BY {keys})"""


for _name, _where in (("xt_heatmap_scale", "table"), ("xt_heatmap_row", "row"), ("xt_heatmap_col", "col")):
    def _register(name=_name, where=_where):
        @query(name, _heat_sql(where))
        def _(t):
            return heatmap_scale(_small(t), ["franchise"], ["status"], _Q, where)

    _register()


@query("xt_bar_scale", f"""WITH c AS (SELECT franchise, status, level, {_Q} - 500 AS v FROM {_CELLS}),
  b AS (SELECT *, greatest(max(v) OVER p, 0) AS hi, min(v) OVER p AS lo FROM c
    WINDOW p AS (PARTITION BY level, CASE WHEN level = 0 THEN franchise END)),
  r AS (SELECT *, CASE WHEN lo < 0 THEN hi - lo ELSE hi END AS span FROM b)
  SELECT franchise, status, level, v,
    CASE WHEN level IN (0, 2) THEN round(CASE WHEN lo < 0 THEN -lo * 100 / nullif(span * 1.4::DOUBLE, 0) ELSE 0 END
      + CASE WHEN v < 0 THEN v * 100 / nullif(span * 1.4::DOUBLE, 0) ELSE 0 END, 6) END AS bar_base,
    CASE WHEN level IN (0, 2) THEN round(abs(v) * 100 / nullif(span * 1.4::DOUBLE, 0), 6) END AS bar_height FROM r""")
def _(t):
    cells = _small(t).select("franchise", "status", "level", (F.col(_Q) - 500).alias("v"))
    return rounded(bar_scale(cells, ["franchise"], ["status"], "v"), 6, "bar_base", "bar_height")


@query("xt_user_aggregator", f"SELECT {_HEAD}, max({_Q}) - min({_Q}) AS value FROM {_LINES} {_SETS}")
def _(t):
    return crosstab(_lines(t), ROWS, COLS, [_Q], lambda v: F.max(v) - F.min(v))


@query("xt_user_state", f"""SELECT {_HEAD}, round(exp(avg(ln({_Q}))), 6) AS {_Q}, round(exp(avg(ln({_P}))), 6) AS {_P}
  FROM {_LINES} {_SETS}""")
def _(t):
    """A caller's aggregator with a state: geometric means of two measures."""
    return rounded(crosstab(_lines(t), ROWS, COLS, [_Q, _P], GeometricMean()), 6, _Q, _P)


@query("xt_user_mode", f"""WITH c AS (SELECT {_HEAD}, CAST({_Q} AS BIGINT) AS v, count(*) AS n FROM {_LINES}
    GROUP BY GROUPING SETS ((region, franchise, status, {_Q}), (region, franchise, {_Q}), (status, {_Q}), ({_Q})))
  SELECT region, franchise, status, level, CAST(v AS VARCHAR) AS quantity FROM c
  QUALIFY row_number() OVER (PARTITION BY region, franchise, status, level ORDER BY n DESC, CAST(v AS VARCHAR)) = 1""")
def _(t):
    lines = _lines(t).withColumn("quantity", F.col(_Q).cast("bigint").cast("string"))
    return crosstab(lines, ROWS, COLS, ["quantity"], Mode())


# --- chart tables --------------------------------------------------------------------------------

_CB = sales_sql(["country"], ["act_orders_rev", "fcst_stat_final_rev"])


@query("column_chart_series", f"""WITH s AS (SELECT year(sales_date) AS y, month(sales_date) AS m, round(sum(act_orders_rev), 4) AS a,
    round(sum(fcst_stat_final_rev) FILTER (WHERE sales_date >= TIMESTAMP '2000-01-01'), 4) AS f FROM ({_CB}) GROUP BY 1, 2),
  g AS (SELECT y, m, CAST((dense_rank() OVER (ORDER BY y) - 1) % 8 AS INT) AS colour FROM
    (SELECT DISTINCT y FROM s), (SELECT unnest(range(1, 13)) AS m)),
  k AS (SELECT y, count(f) AS nf FROM s GROUP BY 1)
  SELECT CAST(g.y AS VARCHAR) || ' - Actual' AS name, 'Actual' AS kind, CAST(g.m AS INT) AS month_number, a AS value, colour
    FROM g LEFT JOIN s ON s.y = g.y AND s.m = g.m
  UNION ALL SELECT CAST(g.y AS VARCHAR) || ' - Forecast', 'Forecast', CAST(g.m AS INT), f, colour
    FROM g JOIN k ON k.y = g.y AND nf > 0 LEFT JOIN s ON s.y = g.y AND s.m = g.m""")
def _(t):
    sales = monthly_sales(t, ["country"], ["act_orders_rev", "fcst_stat_final_rev"])
    recent = F.col("sales_date") >= F.lit("2000-01-01").cast("timestamp_ntz")
    sales = sales.withColumn("model", F.when(recent, F.col("fcst_stat_final_rev")))
    return charts.column_chart_series(sales, "act_orders_rev", "model")


@query("line_chart_series", f"""SELECT sales_date, round(sum(act_orders_rev), 4) AS actual, round(sum(fcst_stat_final_rev), 4) AS forecast
  FROM ({_CB}) GROUP BY 1""")
def _(t):
    return charts.line_chart_series(
        monthly_sales(t, ["country"], ["act_orders_rev", "fcst_stat_final_rev"]), "act_orders_rev", "fcst_stat_final_rev")
