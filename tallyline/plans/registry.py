"""Registration of queries over the order tables, each with the SQL it must agree with.

The SQL is written from the definition of the result, not from the Spark code. Rounding for the
comparison happens here and not in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources.tables import Tables

AS_OF = "2001-08-15"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables)`` under ``name``; without SQL the driver checks rows only."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# --- building blocks of the SQL side -------------------------------------------------------------

LEVELS_SQL = {
    "franchise": "p_brand", "business_unit": "p_type", "ibp_level_5": "p_type",
    "ibp_level_6": "CAST(p_size AS VARCHAR)", "ibp_level_7": "p_name",
    "area": "r_name", "region": "r_name", "group_region": "r_name", "country": "n_name",
    "selling_division": "c_mktsegment",
    "catalog_number": "CAST(l_partkey AS VARCHAR)", "status": "o_orderstatus",
    "priority": "o_orderpriority", "return_flag": "l_returnflag",
}
MEASURES_SQL = {
    "act_orders_rev": "l_extendedprice * (1 - l_discount)",
    "act_orders_rev_val": "l_quantity",
    "fcst_stat_final_rev": "l_extendedprice",
    "fcst_df_final_rev": "l_extendedprice * (1 + l_tax)",
}
LINES_SQL = """lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
MONTH_SQL = "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"


def sales_sql(levels, measures=("act_orders_rev",)) -> str:
    """One row per level combination and month."""
    columns = [f"{LEVELS_SQL[level]} AS {level}" for level in levels]
    sums = [f"CAST(sum(CAST({MEASURES_SQL[m]} AS DECIMAL(18, 4))) AS DOUBLE) AS {m}" for m in measures]
    return f"SELECT {', '.join([*columns, MONTH_SQL + ' AS sales_date', *sums])} FROM {LINES_SQL} GROUP BY ALL"


def lines_sql(levels) -> str:
    """Order lines with levels, month and all measures."""
    columns = [f"{LEVELS_SQL[level]} AS {level}" for level in levels]
    values = [f"{sql} AS {m}" for m, sql in MEASURES_SQL.items()]
    return f"SELECT {', '.join([*columns, MONTH_SQL + ' AS sales_date', *values])} FROM {LINES_SQL}"


def series_sql(levels, measure="act_orders_rev") -> str:
    """unique_id, ds, y with one row per series and month."""
    key = " || ',' || ".join(LEVELS_SQL[level] for level in levels)
    return (f"SELECT {key} AS unique_id, {MONTH_SQL} AS ds, "
            f"CAST(sum(CAST({MEASURES_SQL[measure]} AS DECIMAL(18, 4))) AS DOUBLE) AS y FROM {LINES_SQL} GROUP BY ALL")
