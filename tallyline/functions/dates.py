"""Month arithmetic on timestamps without a time zone.

``trunc`` and ``add_months`` leave the type family (they give ``date``),
so results are cast back to ``timestamp_ntz``, the type of every month stamp in the library.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.numeric import as_column

NTZ = "timestamp_ntz"
EPOCH = "2021-01-01"


def stamp(value: str | dt.date | dt.datetime | Column) -> Column:
    """A literal month or day as timestamp_ntz."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast(NTZ)


def month_start(c: Column | str) -> Column:
    """First day of the month; truncated as a date, which needs no time zone arithmetic."""
    return F.trunc(as_column(c).cast("date"), "MM").cast(NTZ)


def add_months(c: Column | str, n: int | Column) -> Column:
    """Shift by whole months; the day is clipped to the end of the month."""
    return F.add_months(as_column(c).cast("date"), n).cast(NTZ)


def in_months(day: Column | str, first: Column | None = None, last: Column | None = None) -> Column:
    """Whether a raw day lies in a month between two stamps, as a range on the day itself.

    Equal to comparing the start of the day's month with the stamps, but it reaches the scan.
    """
    day, inside = as_column(day), F.lit(True)
    if first is not None:  # months that start before ``first`` are out
        start = month_start(first)
        inside = inside & (day >= F.when(start < first, add_months(start, 1)).otherwise(start))
    if last is not None:
        inside = inside & (day < add_months(month_start(last), 1))
    return inside


def last_full_month(as_of) -> Column:
    return add_months(month_start(stamp(as_of)), -1)


def month_index(c: Column | str) -> Column:
    """Months since year 0: a dense integer axis for gaps and joins."""
    c = as_column(c)
    return F.year(c) * 12 + F.month(c) - 1


def month_name(c: Column | str) -> Column:
    return F.date_format(as_column(c).cast("date"), "MMM")


def days_since(c: Column | str, epoch: str = EPOCH) -> Column:
    return F.datediff(as_column(c).cast("date"), F.lit(epoch).cast("date"))


def month_position(name: Column | str) -> Column:
    """Abbreviated English month name to 0..11."""
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    return (F.array_position(F.array(*[F.lit(n) for n in names]), as_column(name)) - 1).cast("int")


def month_sequence(first: Column, last: Column) -> Column:
    """All month starts from first to last, as an array (empty when last is before first)."""
    months = F.sequence(first, F.greatest(last, first), F.expr("interval 1 month"))
    return F.when(last >= first, months).otherwise(F.array().cast("array<timestamp_ntz>"))


def date_tokens(c: Column | str, pattern: str) -> Column:
    """Format a date with %-tokens; text that is no date gives ''.

    %y year, %m month, %n month name, %d day, %w day name, %x day of week (Sunday 0),
    %H hour, %M minute, %S second; any other token is kept as written.
    """
    when = as_column(c).try_cast("timestamp")
    tokens = {
        "y": F.year(when).cast("string"),
        "m": F.date_format(when, "MM"),
        "n": F.date_format(when, "MMM"),
        "d": F.date_format(when, "dd"),
        "w": F.date_format(when, "EEE"),
        "x": (F.dayofweek(when) - 1).cast("string"),
        "H": F.date_format(when, "HH"),
        "M": F.date_format(when, "mm"),
        "S": F.date_format(when, "ss"),
    }
    pieces = [
        tokens[p[1]] if len(p) == 2 and p[0] == "%" and p[1] in tokens else F.lit(p)
        for p in re.findall(r"%.|[^%]+|%$", pattern, flags=re.S)
    ]
    return F.coalesce(F.concat(F.lit(""), *pieces), F.lit(""))
