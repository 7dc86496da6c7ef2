"""Level lists, measures and the display names used at sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Business levels, coarse to fine.
PRODUCT_LEVELS = ("franchise", "ibp_level_5", "ibp_level_6", "catalog_number")
LOCATION_LEVELS = ("area", "region", "country")

# Keys on which history and forecast are merged, besides the series id and the date.
HIERARCHY_LEVELS = (
    "area", "group_region", "region", "country",
    "business_sector", "business_unit", "franchise", "product_line",
    "ibp_level_5", "ibp_level_6", "ibp_level_7", "catalog_number",
)

# Columns that are not needed once a series is prepared for a model.
NON_MODEL_COLUMNS = (
    "uom", "npi_flag", "pack_content", "l0_asp_final_rev", "act_orders_rev_val",
    "l2_df_final_rev", "l1_df_final_rev", "l0_df_final_rev", "l2_stat_final_rev",
    "fcst_df_final_rev", "fcst_stat_final_rev", "fcst_stat_prelim_rev", "fcst_df_final_rev_val",
)

# Measures read as 32-bit floats at the source and computed as doubles.
FLOAT_MEASURES = (
    "act_orders_rev", "fcst_stat_prelim_rev", "fcst_stat_final_rev",
    "l2_stat_final_rev", "fcst_df_final_rev", "l2_df_final_rev",
)

DISPLAY_NAMES = {
    "sales_date": "SALES_DATE",
    "catalog_number": "CatalogNumber",
    "ibp_level_5": "IBP Level 5",
    "ibp_level_6": "IBP Level 6",
    "ibp_level_7": "IBP Level 7",
    "uom": "UOM",
    "act_orders_rev": "`Act Orders Rev",
    "act_orders_rev_val": "Act Orders Rev Val",
    "l0_asp_final_rev": "`L0 ASP Final Rev",
    "l2_df_final_rev": "L2 DF Final Rev",
    "l1_df_final_rev": "L1 DF Final Rev",
    "l0_df_final_rev": "L0 DF Final Rev",
    "l2_stat_final_rev": "L2 Stat Final Rev",
    "fcst_df_final_rev": "`Fcst DF Final Rev",
    "fcst_stat_final_rev": "`Fcst Stat Final Rev",
    "fcst_stat_prelim_rev": "`Fcst Stat Prelim Rev",
    "fcst_df_final_rev_val": "Fcst DF Final Rev Val",
}


def display_name(column: str) -> str:
    """The heading a column carries in files read by people."""
    return DISPLAY_NAMES.get(column, column.replace("_", " ").title())


def to_display(df: DataFrame) -> DataFrame:
    """Rename every column to its heading (for sinks)."""
    return df.toDF(*[display_name(c) for c in df.columns])


def to_internal(df: DataFrame) -> DataFrame:
    """Rename headings to snake_case at the source boundary.

    Headings hold blanks and a leading backtick, which would have to be escaped in every
    reference; positional renaming avoids naming them at all.
    """
    known = {heading: column for column, heading in DISPLAY_NAMES.items()}
    return df.toDF(*[
        known.get(c, c.strip("` ").lower().replace(" ", "_").replace("-", "_")) for c in df.columns
    ])
