"""Text keys, natural order and number display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.numeric import as_column, is_finite

_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_STOP = "\u0001"


def key_concat(*parts: Column | str, separator: str = ",") -> Column:
    """Join parts to one key; a NULL part makes the key NULL (``concat_ws`` would skip it)."""
    cols: list[Column] = []
    for part in parts:
        if cols:
            cols.append(F.lit(separator))
        cols.append(as_column(part).cast("string"))
    return F.concat(*cols)


def key_split(c: Column | str, names: Sequence[str], separator: str = ",") -> list[Column]:
    """Split a key into as many parts as there are names; the last part keeps the rest."""
    parts = F.split(as_column(c), separator, len(names))
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def replace_text(c: Column | str, old: str, new: str) -> Column:
    return F.replace(as_column(c), F.lit(old), F.lit(new))


def null_text(c: Column | str) -> Column:
    """The value as text, NULL as 'null'."""
    return F.coalesce(as_column(c).cast("string"), F.lit("null"))


def _chunk_key(chunk: Column) -> Column:
    # A run of digits sorts by value: its length, then its digits. A run that begins with 0
    # counts as a fraction below 1, so it sorts before all others, digit by digit. Other text
    # stays as it is, so it compares with text that has no digit in raw order.
    return (
        F.when(chunk.rlike("^0"), F.concat(F.lit("0"), chunk, F.lit(_STOP)))
        .when(chunk.rlike("^[0-9]"),
              F.concat(F.lit("1"), F.lpad(F.length(chunk).cast("string"), 10, "0"), chunk))
        .otherwise(chunk)
    )


def natural_key(c: Column | str) -> Column:
    """Sort key of natural order: NULL, NaN, numbers (also as text) by value, other text.

    Text is cut into runs of digits and runs of other characters; digit runs compare by value.
    Text without any digit compares with all other text in raw order up to its first difference.
    A total order cannot compare raw texts in every such pair and chunks in all others: where a
    digit run meets a character that sorts among the digits' keys, the key decides.
    """
    text = as_column(c).cast("string")
    blank = F.trim(text) == ""
    number = F.when(blank, F.lit(0.0)).when(
        text.rlike(_NUMERIC) | text.isin("Infinity", "-Infinity"),
        F.trim(text).try_cast("double"))
    chunks = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    rank = (
        F.when(text.isNull(), 0).when(text == "NaN", 1).when(number.isNotNull(), 2).otherwise(3)
    )
    return F.struct(
        rank.alias("rank"),
        F.coalesce(number, F.lit(0.0)).alias("number"),
        F.when(rank == 3, F.array_join(F.transform(chunks, _chunk_key), "")).alias("chunks"),
        text.alias("text"),
    )


def custom_order(c: Column | str, values: Sequence[str]) -> Column:
    """Sort key: listed values in list order, then values that equal a listed one in lower case,
    then natural order."""
    text = as_column(c).cast("string")
    first = F.array_position(F.array(*[F.lit(v) for v in values]), text)
    second = F.array_position(F.array(*[F.lit(v.lower()) for v in values]), text)
    tier = F.when(first > 0, 0).when(second > 0, 1).otherwise(2)
    place = F.when(first > 0, first).when(second > 0, second).otherwise(F.lit(0))
    return F.struct(tier.alias("tier"), place.alias("place"), natural_key(text).alias("natural"))


def number_display(
    c: Column | str,
    digits: int = 2,
    scaler: float = 1.0,
    prefix: str = "",
    suffix: str = "",
    thousands: str = ",",
    decimal: str = ".",
) -> Column:
    """Fixed digits with thousands separators; not finite gives ''.

    Exact ties are rounded away from zero. A double is an exact tie at ``digits`` only if it is
    an odd multiple of 2^-(digits + 1), which multiplication by a power of two tests exactly.
    """
    value = as_column(c).cast("double") * F.lit(float(scaler))
    tie = F.abs(value * F.lit(float(2 ** (digits + 1)))) % 2 == 1
    nudged = F.when(tie, value + F.signum(value) * F.lit(10.0 ** -(digits + 3))).otherwise(value)
    shown = F.format_number(nudged, digits)
    if (thousands, decimal) != (",", "."):
        shown = F.replace(F.replace(F.replace(
            shown, F.lit(","), F.lit(_STOP)), F.lit("."), F.lit(decimal)), F.lit(_STOP), F.lit(thousands))
    return F.when(is_finite(value), F.concat(F.lit(prefix), shown, F.lit(suffix))).otherwise("")
