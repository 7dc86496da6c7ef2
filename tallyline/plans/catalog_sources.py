"""Registered queries: extraction, refresh, files, filters, joins, unions and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import dates, numeric, text
from tallyline.lineage import scratch_path
from tallyline.operators import combine, filters
from tallyline.plans.registry import AS_OF, LINES_SQL, lines_sql, query, sales_sql
from tallyline.sources import files, history, remote, store
from tallyline.sources.extract import Selection, Star, extract_count, star_extract
from tallyline.sources.tables import (
    Tables,
    locations,
    long_series,
    location_hierarchy,
    monthly_sales,
    product_hierarchy,
    sales_lines,
)

# --- extraction ----------------------------------------------------------------------------------

STAR_KEYS = (
    "selling_division", "area", "group_region", "region", "country", "catalog_number",
    "business_sector", "business_unit", "franchise", "product_line", "ibp_level_5", "ibp_level_6",
    "ibp_level_7", "sales_date", "uom", "pack_content",
)
STAR_MEASURES = (
    "l0_asp_final_rev", "act_orders_rev", "act_orders_rev_val", "l2_df_final_rev", "l1_df_final_rev",
    "l0_df_final_rev", "l2_stat_final_rev", "fcst_df_final_rev", "fcst_stat_final_rev",
    "fcst_stat_prelim_rev", "fcst_df_final_rev_val",
)
SELECTION = Selection(
    as_of=AS_OF, past_months=36, next_months=24,
    location={"region": ["ASIA", "EUROPE"]},
    product={"franchise": ["Brand#1", "Brand#2", "Brand#11"]},
)

_STAR_MEASURE_TEXT = {
    "l0_asp_final_rev": "l_extendedprice + l_quantity",
    "act_orders_rev": "l_extendedprice * (1 - l_discount)",
    "act_orders_rev_val": "l_quantity",
    "l2_df_final_rev": "l_extendedprice * (1 + l_tax)",
    "l1_df_final_rev": "l_extendedprice - l_quantity",
    "l0_df_final_rev": "l_extendedprice * l_discount",
    "l2_stat_final_rev": "l_extendedprice * l_tax",
    "fcst_df_final_rev": "l_quantity * (1 + l_tax)",
    "fcst_stat_final_rev": "l_extendedprice",
    "fcst_stat_prelim_rev": "l_quantity * (1 - l_discount)",
    "fcst_df_final_rev_val": "l_quantity * l_discount",
}


def _star_months():
    now = dates.stamp(SELECTION.as_of)
    return dates.add_months(now, -SELECTION.past_months), dates.add_months(now, SELECTION.next_months)


def order_star(t: Tables, months=None) -> Star:
    """The order tables as a star; ``months`` bounds the fact side at the scan.

    The product dimension gets a superseded version of every row, as a versioned dimension has;
    the join has to leave those out.
    """
    part = t("part").select(
        F.col("p_partkey").alias("product_skey"),
        F.col("p_partkey").cast("string").alias("catalog_number"),
        F.col("p_type").alias("business_sector"), F.col("p_type").alias("business_unit"),
        F.col("p_brand").alias("franchise"), F.col("p_name").alias("product_line"),
        F.col("p_type").alias("ibp_level_5"), F.col("p_size").cast("string").alias("ibp_level_6"),
        F.col("p_name").alias("ibp_level_7"), F.col("p_retailprice").alias("uom"),
        F.col("p_size").cast("string").alias("pack_content"))
    versions = part.withColumn("current", F.lit("True")).unionByName(
        part.withColumn("current", F.lit("False")))
    places = locations(t).select(
        F.col("c_custkey").alias("loc_skey"), F.col("c_mktsegment").alias("selling_division"),
        F.col("r_name").alias("area"), F.col("r_name").alias("group_region"),
        F.col("r_name").alias("region"), F.col("n_name").alias("country"))
    orders = t("orders").filter(dates.in_months("o_orderdate", *months)) if months else t("orders")
    fact = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("item_skey"), F.col("o_custkey").alias("location_skey"),
        F.col("l_suppkey").alias("matrix_skey"), dates.month_start("o_orderdate").alias("sales_date"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    matrix = t("supplier").select(F.col("s_suppkey").alias("mdp_key"))
    measures = {m: F.expr(sql) for m, sql in _STAR_MEASURE_TEXT.items()}
    return Star(fact=fact, product=versions, location=places, matrix=matrix, derived=measures)


_STAR_FROM = """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey
WHERE date_trunc('month', o_orderdate) BETWEEN TIMESTAMP '2001-08-15' - INTERVAL 36 MONTH
      AND TIMESTAMP '2001-08-15' + INTERVAL 24 MONTH
  AND r_name IN ('ASIA', 'EUROPE') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#11')"""
_STAR_KEYS_SQL = """c_mktsegment AS selling_division, r_name AS area, r_name AS group_region,
  r_name AS region, n_name AS country, CAST(p_partkey AS VARCHAR) AS catalog_number,
  p_type AS business_sector, p_type AS business_unit, p_brand AS franchise, p_name AS product_line,
  p_type AS ibp_level_5, CAST(p_size AS VARCHAR) AS ibp_level_6, p_name AS ibp_level_7,
  CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS sales_date, p_retailprice AS uom,
  CAST(p_size AS VARCHAR) AS pack_content"""
_STAR_SQL = f"""SELECT {_STAR_KEYS_SQL},
  {', '.join(f'CAST(sum(CAST({sql} AS DECIMAL(18, 4))) AS DOUBLE) AS {m}' for m, sql in _STAR_MEASURE_TEXT.items())}
  {_STAR_FROM} GROUP BY ALL"""


@query("star_extract", _STAR_SQL)
def _(t):
    return star_extract(order_star(t, _star_months()), SELECTION, STAR_KEYS, STAR_MEASURES)


@query("extract_count", f"SELECT count(*) AS n_rows FROM (SELECT DISTINCT {_STAR_KEYS_SQL} {_STAR_FROM})")
def _(t):
    return extract_count(order_star(t, _star_months()), SELECTION, STAR_KEYS)


@query("product_hierarchy", """SELECT DISTINCT p_type AS business_sector, p_brand AS franchise,
  p_type AS business_unit, p_name AS product_line, p_type AS ibp_level_5,
  CAST(p_size AS VARCHAR) AS ibp_level_6, p_name AS ibp_level_7,
  CAST(p_partkey AS VARCHAR) AS catalog_number FROM part""")
def _(t):
    return product_hierarchy(t)


_LOCATION_SQL = """SELECT DISTINCT c_mktsegment AS selling_division, r_name AS group_region,
  r_name AS area, r_name AS region, n_name AS country FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query("location_hierarchy", _LOCATION_SQL)
def _(t):
    return location_hierarchy(t)


# --- files ---------------------------------------------------------------------------------------


@query("scan_parquet_typed", """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS FLOAT) AS price,
  CAST(l_discount AS FLOAT) AS discount FROM lineitem""")
def _(t):
    raw = files.scan_parquet_typed(
        t.spark, f"{t.folder}/lineitem.parquet", ("l_extendedprice", "l_discount", "not_there"))
    return raw.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"),
                      F.col("l_discount").alias("discount"))


_REGION_MONTH = sales_sql(["region", "franchise"])


@query("parquet_sink", _REGION_MONTH)
def _(t):
    path = scratch_path(t.spark, "parquet")
    files.write_parquet(monthly_sales(t, ["region", "franchise"]), path, ["region"])
    return t.spark.read.parquet(path).select("region", "franchise", "sales_date", "act_orders_rev")


@query("csv_export", f"""SELECT * FROM ({_REGION_MONTH}) WHERE region = 'ASIA'
  AND sales_date >= TIMESTAMP '1996-01-01' AND sales_date < TIMESTAMP '2000-01-01'""")
def _(t):
    path = scratch_path(t.spark, "csv")
    table = filters.level_filter(monthly_sales(t, ["region", "franchise"]), ("region", "ASIA"))
    table = filters.date_range(table, "1996-01-01", "1999-12-31")
    files.write_csv(table, path)
    return files.read_csv(t.spark, path, table.schema)


@query("json_roundtrip", _REGION_MONTH)
def _(t):
    path = scratch_path(t.spark, "json")
    table = monthly_sales(t, ["region", "franchise"])
    files.write_json(table, path)
    return files.read_json(t.spark, path, table.schema)


@query("batch_append", f"SELECT return_flag, count(*) AS n, sum(act_orders_rev_val) AS quantity FROM ({lines_sql(['return_flag'])}) GROUP BY ALL")
def _(t):
    """Record batches of the order lines, appended as they arrive."""
    lines = remote.read_batches(t.spark, PARQUET_BATCHES, {"path": f"{t.folder}/lineitem.parquet"}, ["l_returnflag", "l_quantity"])
    return lines.groupBy(F.col("l_returnflag").alias("return_flag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


PARQUET_BATCHES = "tallyline.sources.remote:ParquetBatches"


@query("remote_batches", """SELECT l_returnflag AS return_flag, l_linestatus AS line_status, count(*) AS n, sum(l_quantity) AS quantity
  FROM lineitem WHERE l_quantity >= 20 AND l_returnflag IN ('A', 'R') GROUP BY ALL""")
def _(t):
    """A remote table in batches, with filters that the remote side applies."""
    columns = ["l_returnflag", "l_linestatus", "l_quantity"]
    lines = remote.read_batches(t.spark, PARQUET_BATCHES, {"path": f"{t.folder}/lineitem.parquet"}, columns)
    wanted = lines.filter((F.col("l_quantity") >= 20) & F.col("l_returnflag").isin("A", "R"))
    return wanted.groupBy(F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def _stored_and_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    sales = monthly_sales(t, ["region", "franchise"])
    stored = filters.training_cutoff(sales, AS_OF, 1)
    new = filters.last_months(sales, AS_OF, 6).withColumn("act_orders_rev", F.col("act_orders_rev") * 2)
    return stored, new


_NEW_SQL = f"""SELECT region, franchise, sales_date, act_orders_rev * 2 AS act_orders_rev FROM sales
  WHERE sales_date BETWEEN TIMESTAMP '2001-02-01' AND TIMESTAMP '2001-07-01'"""


@query("history_refresh", f"""WITH sales AS ({_REGION_MONTH})
  SELECT * FROM sales WHERE sales_date < TIMESTAMP '2001-02-01' UNION ALL {_NEW_SQL}""")
def _(t):
    stored, new = _stored_and_new(t)
    return history.history_refresh(stored, new, AS_OF)


@query("history_refresh_store", f"""WITH sales AS ({_REGION_MONTH})
  SELECT * FROM sales WHERE sales_date < TIMESTAMP '2001-02-01' UNION ALL {_NEW_SQL}""")
def _(t):
    """The same refresh of a store by month, which rewrites the extract's months only."""
    stored, new = _stored_and_new(t)
    path = scratch_path(t.spark, "store")
    store.create(stored, path)
    store.refresh(t.spark, path, new)
    return store.read(t.spark, path)


@query("history_refresh_append", f"""WITH sales AS ({_REGION_MONTH})
  SELECT * FROM sales WHERE sales_date <= TIMESTAMP '2001-05-01' UNION ALL {_NEW_SQL}""")
def _(t):
    stored, new = _stored_and_new(t)
    return history.history_refresh(stored, new, AS_OF, mode="append")


@query("hierarchy_upsert", _LOCATION_SQL)
def _(t):
    levels = location_hierarchy(t)
    return history.hierarchy_upsert(
        levels.filter(F.col("region") != "ASIA"), levels.filter(F.col("region").isin("ASIA", "EUROPE")))


@query("level_options", f"""SELECT DISTINCT 'franchise' AS level, franchise AS value FROM ({_REGION_MONTH})
  UNION ALL SELECT DISTINCT 'region', region FROM ({_REGION_MONTH})""")
def _(t):
    sales = monthly_sales(t, ["region", "franchise"])
    return combine.union_strict(*[
        sales.select(F.lit(level).alias("level"), F.col(level).alias("value")).distinct()
        for level in ("franchise", "region")])


# --- filters and projections ---------------------------------------------------------------------

_CRB = ["country", "franchise"]
_CRB_SQL = sales_sql(_CRB)


@query("level_filter", f"SELECT * FROM ({_CRB_SQL}) WHERE country = 'NATION_3' AND franchise = 'Brand#7'")
def _(t):
    return filters.level_filter(monthly_sales(t, _CRB), ("country", "NATION_3"), ("franchise", "Brand#7"))


@query("in_list_filter", f"SELECT * FROM ({_CRB_SQL}) WHERE country IN ('NATION_1', 'NATION_2', 'NATION_20')")
def _(t):
    return filters.in_list(monthly_sales(t, _CRB), "country", ["NATION_1", "NATION_2", "NATION_20"])


@query("relative_month_range", f"""SELECT * FROM ({_CRB_SQL})
  WHERE sales_date BETWEEN TIMESTAMP '2001-02-15' AND TIMESTAMP '2002-02-15'""")
def _(t):
    from tallyline.sources.extract import month_window
    now = dates.stamp(AS_OF)
    sales = monthly_sales(t, _CRB, months=(dates.add_months(now, -6), dates.add_months(now, 6)))
    return sales.filter(month_window(F.col("sales_date"), AS_OF, 6, 6))


@query("last_36_months", f"""SELECT * FROM ({_CRB_SQL})
  WHERE sales_date BETWEEN TIMESTAMP '1998-08-01' AND TIMESTAMP '2001-07-01'""")
def _(t):
    last = dates.last_full_month(AS_OF)
    return filters.last_months(monthly_sales(t, _CRB, months=(dates.add_months(last, -35), last)), AS_OF, 36)


@query("training_cutoff", f"SELECT * FROM ({_CRB_SQL}) WHERE sales_date <= TIMESTAMP '2001-07-15'")
def _(t):
    limit = dates.add_months(dates.stamp(AS_OF), -1)
    return filters.training_cutoff(monthly_sales(t, _CRB, months=(None, limit)), AS_OF)


@query("trailing_window", f"""SELECT 'recent' AS side, * FROM ({_CRB_SQL}) WHERE sales_date > TIMESTAMP '2000-07-15'
  UNION ALL SELECT 'earlier', * FROM ({_CRB_SQL}) WHERE sales_date <= TIMESTAMP '2000-07-15'""")
def _(t):
    sales = monthly_sales(t, _CRB)
    recent = filters.trailing_window(sales, AS_OF, 13).select(F.lit("recent").alias("side"), "*")
    earlier = filters.training_cutoff(sales, AS_OF, 13).select(F.lit("earlier").alias("side"), "*")
    return combine.union_strict(recent, earlier)


@query("date_range_halfopen", f"""SELECT o_orderkey, o_orderdate FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-03-05' AND o_orderdate < TIMESTAMP '1998-02-11'""")
def _(t):
    return filters.date_range(t("orders"), "1997-03-05", "1998-02-10", "o_orderdate").select(
        "o_orderkey", "o_orderdate")


@query("date_bounds", "SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date FROM orders")
def _(t):
    return filters.date_bounds(t("orders"), "o_orderdate")


@query("include_exclude_filter", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
  WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def _(t):
    return filters.exclude_values(
        t("orders"), {"o_orderstatus": ["P", "null"], "o_orderpriority": ["1-URGENT", "5-LOW"]},
        F.col("o_totalprice") > 1000,
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("value_search", """
  SELECT '>= brand#3' AS search, p_brand AS value FROM (SELECT DISTINCT p_brand FROM part)
  WHERE CAST(replace(p_brand, 'Brand#', '') AS INT) >= 3
  UNION ALL SELECT '< brand#12', p_brand FROM (SELECT DISTINCT p_brand FROM part)
  WHERE CAST(replace(p_brand, 'Brand#', '') AS INT) < 12
  UNION ALL SELECT '~#1.$', p_brand FROM (SELECT DISTINCT p_brand FROM part) WHERE regexp_matches(lower(p_brand), '#1.$')
  UNION ALL SELECT 'AND#2', p_brand FROM (SELECT DISTINCT p_brand FROM part) WHERE contains(lower(p_brand), 'and#2')""")
def _(t):
    return combine.union_strict(*[
        filters.value_search(t("part"), "p_brand", search).select(F.lit(search).alias("search"), "value")
        for search in (">= brand#3", "< brand#12", "~#1.$", "AND#2")])


@query("drill_through", f"""SELECT country, franchise, sales_date, act_orders_rev_val AS quantity FROM ({lines_sql(_CRB)})
  WHERE country = 'NATION_5' AND franchise = 'Brand#4'""")
def _(t):
    return filters.drill_through(sales_lines(t, _CRB), {"country": "NATION_5", "franchise": "Brand#4"}).select(
        "country", "franchise", "sales_date", F.col("act_orders_rev_val").alias("quantity"))


@query("row_click_filter", f"SELECT * FROM ({sales_sql(['region', 'catalog_number'])}) WHERE catalog_number = '42'")
def _(t):
    # The typed key reaches the scan; the filter on the text form stays the definition.
    sales = monthly_sales(t, ["region", "catalog_number"], keys={"catalog_number": "42"})
    return filters.row_click_filter(sales, "42")


@query("drop_if_present", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def _(t):
    return filters.drop_if_present(t("part"), ["p_retailprice", "npi_flag", "pack_content"])


@query("rename_select", f"SELECT catalog_number AS unique_id, sales_date AS ds, act_orders_rev AS y, 0 AS model FROM ({sales_sql(['catalog_number'])})")
def _(t):
    return monthly_sales(t, ["catalog_number"]).withColumnsRenamed(
        {"sales_date": "ds", "act_orders_rev": "y", "catalog_number": "unique_id"}
    ).select("unique_id", "ds", "y", F.lit(0).alias("model"))


@query("conditional_value", """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small'
  WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS kind FROM orders""")
def _(t):
    kind = filters.conditional_value(
        [(F.col("o_totalprice") < 50000, "small"), (F.col("o_orderpriority") == "1-URGENT", "urgent")], "other")
    return t("orders").select("o_orderkey", kind.alias("kind"))


@query("derived_attribute", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'BIG' ELSE o_orderstatus END
  AS o_orderstatus, CAST(year(o_orderdate) AS INT) AS order_year FROM orders""")
def _(t):
    return filters.derive(t("orders"), {
        "o_orderstatus": lambda: F.when(F.col("o_totalprice") > 200000, "BIG"),
        "order_year": F.year("o_orderdate"),
    }).select("o_orderkey", "o_orderstatus", "order_year")


# --- joins ---------------------------------------------------------------------------------------


@query("star_join", f"""SELECT country, franchise, count(*) AS n, sum(act_orders_rev_val) AS quantity
  FROM ({lines_sql(_CRB)}) GROUP BY ALL""")
def _(t):
    from tallyline.sources.extract import star_join
    joined = star_join(order_star(t), Selection(as_of=AS_OF, past_months=120, next_months=24))
    return joined.groupBy("country", "franchise").agg(
        F.count(F.lit(1)).alias("n"), F.sum("act_orders_rev_val").alias("quantity"))


def naive_values(t: Tables) -> DataFrame:
    """A forecast-like table: each product's average month, placed in the following month."""
    return monthly_sales(t, ["catalog_number"]).groupBy("catalog_number").agg(
        dates.add_months(F.max("sales_date"), 1).alias("sales_date"),
        F.max("act_orders_rev").alias("forecast"))


_NAIVE_SQL = f"""SELECT catalog_number, max(sales_date) + INTERVAL 1 MONTH AS sales_date,
  max(act_orders_rev) AS forecast FROM ({sales_sql(['catalog_number'])}) GROUP BY ALL"""


@query("hierarchy_left_join", f"""SELECT f.*, p_type AS business_sector, p_brand AS franchise,
  p_type AS business_unit, p_name AS product_line, p_type AS ibp_level_5,
  CAST(p_size AS VARCHAR) AS ibp_level_6, p_name AS ibp_level_7
  FROM ({_NAIVE_SQL}) f LEFT JOIN part ON catalog_number = CAST(p_partkey AS VARCHAR)""")
def _(t):
    return combine.hierarchy_left_join(naive_values(t), product_hierarchy(t))


_LABEL_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS unique_id, p_type AS cluster FROM part WHERE p_size > 10"


def _labels(t: Tables) -> DataFrame:
    return t("part").filter(F.col("p_size") > 10).select(
        F.col("p_partkey").cast("string").alias("unique_id"), F.col("p_type").alias("cluster"))


_SKU = ["catalog_number"]


def _sku_series_sql() -> str:
    return f"SELECT catalog_number AS unique_id, sales_date AS ds, act_orders_rev AS y FROM ({sales_sql(_SKU)})"


@query("cluster_left_join", f"""SELECT s.*, cluster FROM ({_sku_series_sql()}) s
  LEFT JOIN ({_LABEL_SQL}) USING (unique_id)""")
def _(t):
    return combine.label_join(long_series(t, _SKU), _labels(t))


@query("cluster_inner_join", f"""SELECT s.*, cluster FROM ({_sku_series_sql()}) s
  JOIN ({_LABEL_SQL}) USING (unique_id)""")
def _(t):
    return combine.label_join(long_series(t, _SKU), _labels(t), how="inner")


@query("forecast_full_merge", f"""SELECT catalog_number, sales_date, act_orders_rev, forecast
  FROM ({sales_sql(_SKU)}) FULL JOIN ({_NAIVE_SQL}) USING (catalog_number, sales_date)""")
def _(t):
    return combine.full_merge(monthly_sales(t, _SKU), naive_values(t), ["catalog_number", "sales_date"])


@query("actual_forecast_full_join", f"""WITH s AS ({sales_sql(_SKU)}), f AS ({_NAIVE_SQL})
  SELECT sales_date, actual, forecast
  FROM (SELECT sales_date, round(sum(act_orders_rev), 4) AS actual FROM s GROUP BY ALL)
  FULL JOIN (SELECT sales_date, round(sum(forecast), 4) AS forecast FROM f GROUP BY ALL) USING (sales_date)""")
def _(t):
    actual = monthly_sales(t, _SKU).groupBy("sales_date").agg(F.round(F.sum("act_orders_rev"), 4).alias("actual"))
    forecast = naive_values(t).groupBy("sales_date").agg(F.round(F.sum("forecast"), 4).alias("forecast"))
    return combine.full_merge(actual, forecast, ["sales_date"])


@query("calendar_cross_join", """SELECT CAST(p_partkey AS VARCHAR) AS catalog_number, m AS sales_date
  FROM part, (SELECT unnest(generate_series(TIMESTAMP '2001-08-01', TIMESTAMP '2002-07-01', INTERVAL 1 MONTH)) AS m)""")
def _(t):
    months = dates.month_sequence(dates.month_start(dates.stamp(AS_OF)), dates.stamp("2002-07-01"))
    return t("part").select(
        F.col("p_partkey").cast("string").alias("catalog_number"),
        F.explode(months).alias("sales_date"))


@query("eligible_inner_join", f"""SELECT catalog_number FROM ({sales_sql(_SKU)}) WHERE sales_date > TIMESTAMP '2000-07-15'
  GROUP BY 1 HAVING sum(act_orders_rev) > 12 INTERSECT
  SELECT catalog_number FROM ({sales_sql(_SKU)}) WHERE sales_date <= TIMESTAMP '2000-07-15'
  GROUP BY 1 HAVING sum(act_orders_rev) > 0""")
def _(t):
    sales = monthly_sales(t, _SKU)

    def active(part: DataFrame, above: float) -> DataFrame:
        return part.groupBy("catalog_number").agg(F.sum("act_orders_rev").alias("total")).filter(
            F.col("total") > above).select("catalog_number")

    return active(filters.trailing_window(sales, AS_OF, 13), 12).join(
        active(filters.training_cutoff(sales, AS_OF, 13), 0), "catalog_number")


@query("series_semi_join", f"""SELECT * FROM ({_sku_series_sql()}) WHERE unique_id IN
  (SELECT unique_id FROM ({_LABEL_SQL}))""")
def _(t):
    return combine.keep_series(long_series(t, _SKU), _labels(t))


@query("series_anti_join", f"""SELECT * FROM ({_sku_series_sql()}) WHERE unique_id NOT IN
  (SELECT unique_id FROM ({_LABEL_SQL}))""")
def _(t):
    return combine.without_series(long_series(t, _SKU), _labels(t))


# --- unions --------------------------------------------------------------------------------------


@query("union_strict", f"SELECT * FROM ({_REGION_MONTH}) UNION ALL SELECT * FROM ({_REGION_MONTH}) WHERE region = 'ASIA'")
def _(t):
    sales = monthly_sales(t, ["region", "franchise"])
    return combine.union_strict(sales, filters.level_filter(sales, ("region", "ASIA")))


@query("union_diagonal", f"""SELECT region, sales_date, CAST(act_orders_rev AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS country
  FROM ({sales_sql(['region'])}) UNION ALL
  SELECT NULL, sales_date, CAST(act_orders_rev_val AS INT), country
  FROM ({sales_sql(['country'], ['act_orders_rev_val'])})""")
def _(t):
    a = monthly_sales(t, ["region"]).withColumnRenamed("act_orders_rev", "value")
    b = monthly_sales(t, ["country"], ["act_orders_rev_val"]).select(
        "country", "sales_date", F.col("act_orders_rev_val").cast("int").alias("value"))
    return combine.union_diagonal(a, b)


@query("union_distinct", "SELECT p_brand AS value FROM part UNION SELECT p_type FROM part")
def _(t):
    part = t("part")
    return combine.union_distinct(
        part.select(F.col("p_brand").alias("value")), part.select(F.col("p_type").alias("value")))


# --- scalar functions ----------------------------------------------------------------------------


@query("date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  strftime(o_orderdate, '%b') AS month_name FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"),
                              F.month("o_orderdate").alias("month"),
                              dates.month_name("o_orderdate").alias("month_name"))


@query("days_since_epoch", """SELECT o_orderkey, CAST(date_diff('day', DATE '2021-01-01', CAST(o_orderdate AS DATE)) AS INT)
  AS days FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", dates.days_since("o_orderdate").alias("days"))


@query("month_order", "SELECT o_orderkey, CAST(month(o_orderdate) - 1 AS INT) AS month_order FROM orders")
def _(t):
    return t("orders").select(
        "o_orderkey", dates.month_position(dates.month_name("o_orderdate")).alias("month_order"))


@query("month_sequence", """SELECT c_custkey, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS month FROM
  (SELECT o_custkey AS c_custkey, CAST(date_trunc('month', min(o_orderdate)) AS TIMESTAMP) AS a,
   CAST(date_trunc('month', max(o_orderdate)) AS TIMESTAMP) AS b FROM orders GROUP BY 1)""")
def _(t):
    spans = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        dates.month_start(F.min("o_orderdate")).alias("a"), dates.month_start(F.max("o_orderdate")).alias("b"))
    return spans.select("c_custkey", F.explode(dates.month_sequence(F.col("a"), F.col("b"))).alias("month"))


@query("month_arithmetic", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS first_day,
  CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) - INTERVAL 3 MONTH AS three_back,
  CAST(o_orderdate + INTERVAL 1 MONTH AS TIMESTAMP) AS next_month FROM orders""")
def _(t):
    first = dates.month_start("o_orderdate")
    return t("orders").select("o_orderkey", first.alias("first_day"), dates.add_months(first, -3).alias("three_back"),
                              dates.add_months("o_orderdate", 1).alias("next_month"))


@query("null_nan_repair", """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS nan_fixed,
  CASE WHEN o_orderstatus = 'P' OR o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS all_fixed FROM orders""")
def _(t):
    broken = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(
        F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    infinite = F.when(F.col("o_orderstatus") == "F", F.lit(float("inf"))).otherwise(broken)
    return t("orders").select("o_orderkey", numeric.nan_to_zero(broken).alias("nan_fixed"),
                              numeric.finite_or_zero(infinite).alias("all_fixed"))


@query("key_concat", """SELECT c_custkey, n_name || ',' || c_mktsegment AS unique_id FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "c_custkey", text.key_concat("n_name", "c_mktsegment").alias("unique_id"))


@query("key_split", f"""SELECT DISTINCT n_name AS country, p_brand AS catalog_number FROM {LINES_SQL}""")
def _(t):
    keys = long_series(t, _CRB).select("unique_id").distinct()
    return keys.select(*text.key_split("unique_id", ["country", "catalog_number"]))


@query("string_replace", "SELECT o_orderkey, replace(o_orderpriority, '-', '/') AS priority FROM orders")
def _(t):
    return t("orders").select("o_orderkey", text.replace_text("o_orderpriority", "-", "/").alias("priority"))


@query("bin_number", """SELECT c_custkey, c_nationkey - c_nationkey % 7 AS nation_bin,
  CAST(trunc(c_acctbal / 250) * 250 AS DOUBLE) AS balance_bin FROM customer""")
def _(t):
    return t("customer").select(
        "c_custkey", numeric.bin_number("c_nationkey", 7).alias("nation_bin"),
        F.round(numeric.bin_number("c_acctbal", 250), 2).alias("balance_bin"))


@query("date_format_tokens", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m/%b %d ') || strftime(o_orderdate, '%a(%w) %H:%M:%S') ||
  ' %q' AS shown, '' AS bad FROM orders""")
def _(t):
    return t("orders").select(
        "o_orderkey", dates.date_tokens(F.col("o_orderdate").cast("string"), "%y-%m/%n %d %w(%x) %H:%M:%S %q").alias("shown"),
        dates.date_tokens("o_orderpriority", "%y").alias("bad"))


@query("lenient_number", """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS leading,
  CAST(NULL AS DOUBLE) AS none FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", numeric.lenient_number("o_orderpriority").alias("leading"),
                              numeric.lenient_number("o_orderstatus").alias("none"))


@query("natural_sort_key", """SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY regexp_extract(p_brand, '^[^0-9]+'),
  CAST(regexp_extract(p_brand, '[0-9]+$') AS INT)) AS BIGINT) AS place FROM (SELECT DISTINCT p_brand FROM part)""")
def _(t):
    from tallyline.operators.ranking import ordered_position
    values = t("part").select(F.col("p_brand").alias("value")).distinct()
    return ordered_position(values, [text.natural_key("value")], "place")


@query("custom_order", """SELECT p_type AS value, CAST(row_number() OVER (ORDER BY CASE p_type WHEN 'STANDARD' THEN 0
  WHEN 'ECONOMY' THEN 1 ELSE 2 END, p_type) AS BIGINT) AS place FROM (SELECT DISTINCT p_type FROM part)""")
def _(t):
    from tallyline.operators.ranking import ordered_position
    values = t("part").select(F.col("p_type").alias("value")).distinct()
    return ordered_position(values, [text.custom_order("value", ["STANDARD", "ECONOMY"])], "place")


@query("number_display", """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS shown,
  format('{:,.1f}', CASE WHEN (o_totalprice / 1000 * 4) % 2 = 1 THEN o_totalprice / 1000 + 0.0001 ELSE o_totalprice / 1000 END) || ' k'
  AS thousands, '' AS blank FROM orders""")
def _(t):
    return t("orders").select(
        "o_orderkey", text.number_display("o_totalprice").alias("shown"),
        text.number_display(numeric.safe_div("o_totalprice", F.lit(1000)), 1, suffix=" k").alias("thousands"),
        text.number_display(F.lit(float("nan"))).alias("blank"))


@query("volume_band", """SELECT c_custkey, CASE WHEN c_acctbal < 100 THEN 'low' WHEN c_acctbal < 1000 THEN 'medium'
  ELSE 'high' END AS band FROM customer""")
def _(t):
    return t("customer").select("c_custkey", numeric.volume_band("c_acctbal").alias("band"))


@query("row_list_mean", """SELECT o_orderkey, (o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 100.0 END) /
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS mean FROM orders""")
def _(t):
    other = F.when(F.col("o_orderstatus") != "F", F.lit(100.0))
    return t("orders").select("o_orderkey", numeric.row_mean("o_totalprice", other, F.lit(None)).alias("mean"))


@query("year_relabel", """SELECT o_orderkey, CAST(CASE WHEN year(o_orderdate) = 2001 THEN 1998 ELSE year(o_orderdate) END AS INT)
  AS year FROM orders""")
def _(t):
    from tallyline.operators.rollup import relabel_year
    return t("orders").select("o_orderkey", relabel_year(F.year("o_orderdate"), {2001: 1998}).alias("year"))


@query("casts", """SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS price, CAST(o_orderkey AS VARCHAR) AS key_text,
  CAST(o_orderdate AS TIMESTAMP) AS stamp, CAST(NULL AS DOUBLE) AS bad FROM orders""")
def _(t):
    return t("orders").select(
        "o_orderkey", F.col("o_totalprice").cast("float").alias("price"),
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_orderdate").cast("date").cast(dates.NTZ).alias("stamp"),
        F.col("o_orderpriority").try_cast("double").alias("bad"))

