"""The order tables as sales history: lines, monthly sales, series, hierarchies.

Only the dimensions a level list asks for are joined. No join is hinted: Catalyst broadcasts a
side whose estimated size is below ``spark.sql.autoBroadcastJoinThreshold``, adaptive execution
re-checks with the real size, and everything larger is a sort-merge join with skew handling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.dates import in_months, month_start
from tallyline.functions.numeric import as_column
from tallyline.functions.text import key_concat

MONEY_DIGITS = 4
# Order lines that one task joins with their orders, about.
TASK_ROWS = 1_000_000

_PRODUCT = {
    "franchise": "p_brand", "business_unit": "p_type", "ibp_level_5": "p_type",
    "ibp_level_6": "p_size", "ibp_level_7": "p_name",
}
_LOCATION = {
    "area": "r_name", "region": "r_name", "group_region": "r_name", "country": "n_name",
    "selling_division": "c_mktsegment",
}
_ORDER = {"status": "o_orderstatus", "priority": "o_orderpriority"}
_LINE = {"catalog_number": "l_partkey", "return_flag": "l_returnflag"}
LEVELS = {**_PRODUCT, **_LOCATION, **_ORDER, **_LINE}

MEASURES = {
    "act_orders_rev": lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")),
    "act_orders_rev_val": lambda: F.col("l_quantity"),
    "fcst_stat_final_rev": lambda: F.col("l_extendedprice"),
    "fcst_df_final_rev": lambda: F.col("l_extendedprice") * (1 + F.col("l_tax")),
}


# Declared, so that opening a table starts no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


class Tables:
    """Parquet tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._rows: dict[str, int] = {}

    def __call__(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        return reader.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Number of rows of a table, from the file footers; read once."""
        if name not in self._rows:
            self._rows[name] = self(name).count()
        return self._rows[name]


def locations(t: Tables) -> DataFrame:
    """Customers with their nation and region."""
    return (
        t("customer")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


Months = tuple[Column | None, Column | None]


def _dealt(lines: DataFrame, rows: int, key: str, task_rows: int) -> DataFrame:
    """``lines`` in tasks of about ``task_rows`` where the session's number of partitions would make them larger.

    What a task sorts and aggregates then does not grow with the table. For keys that few lines share, as adaptive
    execution does not split a partition that was asked for.
    """
    parts = -(-rows // task_rows)
    return lines.repartition(parts, key) if parts > int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) else lines


def _raw_lines(t: Tables, levels: Sequence[str], months: Months | None = None, keys: Mapping[str, object] | None = None) -> DataFrame:
    """Order lines with the asked levels as stored, the month and the measures.

    ``months`` keeps the months between two stamps, as a range on the order day that reaches the
    scan; ``keys`` keeps line keys that equal a value of their stored type.

    Levels and the month are computed on the dimension and order side, before the join multiplies
    their rows. Products are joined first, while lines are narrow: that join may be skewed and is left to
    adaptive execution. The join with the orders, whose tasks also hold the caller's aggregate, has tasks of a
    bounded number of lines.
    """
    for level in levels:
        if level not in LEVELS:
            raise ValueError(f"unknown level: {level}")

    def wanted(source: dict[str, str]) -> list[Column]:
        return [F.col(source[level]).alias(level) for level in levels if level in source]

    stored = t("orders")
    if months:
        stored = stored.filter(in_months("o_orderdate", *months))
    orders = stored.select(
        "o_orderkey", "o_custkey", month_start("o_orderdate").alias("sales_date"), *wanted(_ORDER))
    places = wanted(_LOCATION)
    if places:
        orders = orders.join(locations(t).select("c_custkey", *places), F.col("o_custkey") == F.col("c_custkey"))
    facts = t("lineitem")
    for level, wanted_value in (keys or {}).items():
        column = _LINE[level]
        facts = facts.filter(F.col(column) == F.lit(wanted_value).cast(facts.schema[column].dataType))
    products = wanted(_PRODUCT)
    if products:
        facts = facts.join(t("part").select("p_partkey", *products), F.col("l_partkey") == F.col("p_partkey"))
    if not keys:
        facts = _dealt(facts, t.rows("lineitem"), "l_orderkey", TASK_ROWS)
    lines = facts.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.withColumns({level: F.col(_LINE[level]) for level in levels if level in _LINE}).select(
        *levels, "sales_date", *[measure().alias(name) for name, measure in MEASURES.items()])


def _as_text(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({level: F.col(level).cast("string") for level in levels if types[level] != "string"})


def sales_lines(t: Tables, levels: Sequence[str]) -> DataFrame:
    """Order lines with the asked levels as text, ``sales_date`` (month) and the measures."""
    return _as_text(_raw_lines(t, levels), levels)


def money_sum(c: Column | str) -> Column:
    """Sum of a money amount as a decimal with four digits: exact, so the order of rows cannot show."""
    return F.sum(as_column(c).cast(f"decimal(18,{MONEY_DIGITS})")).cast("double")


def monthly_sales(
    t: Tables,
    levels: Sequence[str],
    measures: Sequence[str] = ("act_orders_rev",),
    months: Months | None = None,
    keys: Mapping[str, object] | None = None,
) -> DataFrame:
    """One row per level combination and month; keys become text after they are grouped."""
    grouped = _raw_lines(t, levels, months, keys).groupBy(*levels, "sales_date").agg(*[money_sum(m).alias(m) for m in measures])
    return _as_text(grouped, levels)


def long_series(t: Tables, levels: Sequence[str], measure: str = "act_orders_rev") -> DataFrame:
    """The model-side form: ``unique_id``, ``ds``, ``y``; one row per series and month."""
    lines = _raw_lines(t, levels)
    key = F.col(levels[0]) if len(levels) == 1 else key_concat(*levels)
    grouped = lines.groupBy(key.alias("unique_id"), F.col("sales_date").alias("ds")).agg(
        money_sum(measure).alias("y"))
    return _as_text(grouped, ["unique_id"])


def product_hierarchy(t: Tables) -> DataFrame:
    """Distinct product levels."""
    return t("part").select(
        F.col("p_type").alias("business_sector"),
        F.col("p_brand").alias("franchise"),
        F.col("p_type").alias("business_unit"),
        F.col("p_name").alias("product_line"),
        F.col("p_type").alias("ibp_level_5"),
        F.col("p_size").cast("string").alias("ibp_level_6"),
        F.col("p_name").alias("ibp_level_7"),
        F.col("p_partkey").cast("string").alias("catalog_number"),
    ).distinct()


def location_hierarchy(t: Tables) -> DataFrame:
    """Distinct location levels, with the selling division."""
    return locations(t).select(
        F.col("c_mktsegment").alias("selling_division"),
        F.col("r_name").alias("group_region"),
        F.col("r_name").alias("area"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
    ).distinct()
