"""Row filters and column selection."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.dates import add_months, last_full_month, stamp
from tallyline.functions.text import custom_order, natural_key, null_text


def level_filter(
    df: DataFrame,
    location: tuple[str, str] | None = None,
    product: tuple[str, str] | None = None,
) -> DataFrame:
    """Equality on a caller-named location level and product level; either may be absent."""
    for choice in (location, product):
        if choice is not None and choice[0] and choice[1]:
            df = df.filter(F.col(choice[0]) == F.lit(choice[1]))
    return df


def in_list(df: DataFrame, level: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(level).isin(list(values)))


def last_months(df: DataFrame, as_of, months: int = 36, date: str = "sales_date") -> DataFrame:
    """The last ``months`` full months before ``as_of``."""
    last = last_full_month(as_of)
    return df.filter(F.col(date).between(add_months(last, 1 - months), last))


def training_cutoff(
    df: DataFrame, as_of, months: int = 1, strict: bool = False, date: str = "sales_date",
) -> DataFrame:
    """Rows up to ``months`` months before ``as_of``."""
    limit = add_months(stamp(as_of), -months)
    return df.filter(F.col(date) < limit if strict else F.col(date) <= limit)


def trailing_window(df: DataFrame, as_of, months: int = 13, date: str = "sales_date") -> DataFrame:
    """Rows later than ``months`` months ago; ``training_cutoff`` is the other side."""
    return df.filter(F.col(date) > add_months(stamp(as_of), -months))


def date_range(df: DataFrame, start: str, end: str, date: str = "sales_date") -> DataFrame:
    """From the start day through the whole end day."""
    return df.filter(
        (F.col(date) >= stamp(start)) & (F.col(date) < stamp(end) + F.expr("interval 1 day")))


def date_bounds(df: DataFrame, date: str = "sales_date") -> DataFrame:
    return df.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def exclude_values(
    df: DataFrame, excluded: Mapping[str, Sequence[str]], predicate: Column | None = None,
) -> DataFrame:
    """Drop rows whose attribute is in its excluded list; NULL compares as the text 'null'."""
    if predicate is not None:
        df = df.filter(predicate)
    for attribute, values in excluded.items():
        if values:
            df = df.filter(~null_text(attribute).isin([str(v) for v in values]))
    return df


def value_search(
    df: DataFrame, attribute: str, text: str, order: Sequence[str] | None = None,
) -> DataFrame:
    """Distinct values of an attribute that match a search text.

    ``>=``, ``<=``, ``>`` and ``<`` compare in natural (or custom) order, ``~`` is a regular
    expression, anything else is contained; letter case does not matter.
    """
    values = df.select(null_text(attribute).alias("value")).distinct()
    wanted = text.lower().strip()
    operator = re.match(r">=|<=|>|<|~|", wanted).group(0)
    operand = wanted[len(operator):].strip()
    folded = F.lower("value")
    if not operand:
        return values
    if operator == "~":
        return values.filter(folded.rlike(wanted[1:]))
    if operator == "":
        return values.filter(folded.contains(operand))

    def key(c: Column) -> Column:
        return custom_order(c, order) if order else natural_key(c)

    left, right = key(folded), key(F.lit(operand))
    compare = {">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}
    return values.filter(compare[operator])


def drill_through(df: DataFrame, cell: Mapping[str, str], predicate: Column | None = None) -> DataFrame:
    """Source rows behind one cross-tab cell, given its key map ('null' matches NULL)."""
    if predicate is not None:
        df = df.filter(predicate)
    conditions = [null_text(k) == F.lit(str(v)) for k, v in cell.items()]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def row_click_filter(df: DataFrame, catalog_number: str, location: tuple[str, str] | None = None) -> DataFrame:
    """Re-filter on the catalog number of a chosen row."""
    return level_filter(df, location, ("catalog_number", catalog_number))


def drop_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def derive(df: DataFrame, attributes: Mapping[str, Callable[[], Column] | Column]) -> DataFrame:
    """Add computed attributes; a NULL result keeps the value the column already had."""
    for name, expression in attributes.items():
        value = expression() if callable(expression) and not isinstance(expression, Column) else expression
        df = df.withColumn(name, F.coalesce(value, F.col(name)) if name in df.columns else value)
    return df


def conditional_value(cases: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """First matching case, else the default."""
    if not cases:
        return F.lit(otherwise)
    chain = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)
