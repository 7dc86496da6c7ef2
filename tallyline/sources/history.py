"""Keeping the stored history and hierarchies up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.dates import add_months, month_start, stamp
from tallyline.lineage import cut


def history_refresh(
    stored: DataFrame | None,
    extract: DataFrame,
    as_of,
    mode: str = "replace_window",
    date: str = "sales_date",
    keep_back: int = 3,
) -> DataFrame:
    """Stored history brought up to date with a new extract.

    ``append`` keeps stored rows up to ``keep_back`` months before the current month and appends
    the extract; months both hold are stored twice. ``replace_window`` keeps only stored rows
    outside the month range of the extract, so each month comes from one side.
    """
    if stored is None:
        return extract
    if mode == "append":
        limit = add_months(month_start(stamp(as_of)), -keep_back)
        kept = stored.filter(F.col(date) <= limit)
    elif mode == "replace_window":
        # Written once: two reads of a live source may disagree. The bounds are one row.
        extract = cut(extract)
        span = extract.agg(F.struct(F.min(date).alias("first"), F.max(date).alias("last"))).scalar()
        kept = stored.filter(
            F.col(date).isNull() | span["first"].isNull()
            | (F.col(date) < span["first"]) | (F.col(date) > span["last"]))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return kept.unionByName(extract)


def hierarchy_upsert(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Stored and new levels together, each combination once."""
    return new.distinct() if stored is None else stored.unionByName(new).distinct()
