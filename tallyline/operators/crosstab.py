"""Cross-tabulation: row keys x column keys with totals, in long form.

The result has one row per cell, row total, column total and the grand total, told apart by
``level`` (0 cell, 1 row total, 2 column total, 3 grand total; a key that is summed over is NULL,
a NULL key of the data reads 'null').

Totals are grouping sets. Expanding the source rows to four grouping sets would multiply the input,
so aggregators whose parts can be merged are computed per cell first and only the cells are
expanded. Distinct counts expand a table of distinct values; quantiles roll up bucket sizes and
expand values only against the buckets that a total needs; variances merge from cells. Only a
caller's own aggregate is applied to source rows for every grouping set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.numeric import is_finite, number_of, safe_div, score_bound
from tallyline.functions.text import custom_order, natural_key, null_text
from tallyline.lineage import cut
from tallyline.operators.filters import derive
from tallyline.operators.quantiles import in_buckets, ranked_quantiles, wanted_buckets, with_buckets
from tallyline.operators.ranking import ordered_position
from tallyline.operators.user_aggregates import UserAggregator, stateful

Sorter = Sequence[str] | Callable[[Column], Column]

CELL, ROW_TOTAL, COLUMN_TOTAL, GRAND_TOTAL = 0, 1, 2, 3


def sort_key(attribute: Column, sorter: Sorter | None = None) -> Column:
    """Sort key of an attribute: natural order, a listed order, or the caller's own key."""
    if sorter is None:
        return natural_key(attribute)
    return sorter(attribute) if callable(sorter) else custom_order(attribute, sorter)


# --- aggregators ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Merged:
    """An aggregator made of parts that merge: aggregate, merge aggregate, and the final value."""

    inputs: int
    parts: Callable[[list["Value"]], dict[str, tuple[Column, Callable[[Column], Column]]]]
    finish: Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class Direct:
    """An aggregator applied to source rows for every grouping set."""

    inputs: int
    column: Callable[[list["Value"]], Column]


@dataclass(frozen=True)
class Quantile:
    """Mean of the two neighbours of rank (n - 1) q."""

    q: float
    inputs: int = 1


@dataclass(frozen=True)
class Distinct:
    """An aggregate over the distinct values (NULL is one of them)."""

    column: Callable[[Column, Column], Column]
    inputs: int = 1


@dataclass(frozen=True)
class Share:
    """A merged aggregator as a share of its total, row total or column total."""

    of: Merged
    scope: str

    @property
    def inputs(self) -> int:
        return self.of.inputs


@dataclass(frozen=True)
class Value:
    """A value attribute: the column as it is, as a number, and its sort key."""

    raw: Column
    number: Column
    key: Column


def _sum_parts(values: list[Value]):
    return {f"s{i}": (F.sum(v.number), F.sum) for i, v in enumerate(values)}


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


@dataclass(frozen=True)
class Extreme:
    """The first or last value in the order of the sort key."""

    pick: Callable[[Column], Column]
    inputs: int = 1


COUNT = Merged(0, lambda v: {"n": (F.count(F.lit(1)), F.sum)}, lambda p: p["n"])
SUM = Merged(1, _sum_parts, lambda p: _zero(p["s0"]))
AVERAGE = Merged(
    1,
    lambda v: {"s0": (F.sum(v[0].number), F.sum), "n": (F.count(v[0].number), F.sum)},
    lambda p: safe_div(p["s0"], p["n"]),
)


@dataclass(frozen=True)
class Spread:
    """A function of the sample variance, merged from the size, mean and squared deviations of cells."""

    finish: Callable[[Column], Column]
    inputs: int = 1


def _bound(upper: bool) -> Merged:
    return Merged(2, _sum_parts, lambda p: score_bound(_zero(p["s0"]), _zero(p["s1"]), upper))


AGGREGATORS = {
    "Count": COUNT,
    "Count Unique Values": Distinct(
        lambda value, key: F.count(value) + F.max(F.when(value.isNull(), 1).otherwise(0))),
    "List Unique Values": Distinct(
        lambda value, key: F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(key.alias("key"), F.coalesce(value, F.lit("")).alias("value")))),
            lambda e: e["value"]), ", ")),
    "Sum": SUM,
    "Integer Sum": SUM,  # another display of the same value
    "Average": AVERAGE,
    "Median": Quantile(0.5),
    "Sample Variance": Spread(lambda variance: variance),
    "Sample Standard Deviation": Spread(F.sqrt),
    "Minimum": Merged(1, lambda v: {"e": (F.min(v[0].number), F.min)}, lambda p: p["e"]),
    "Maximum": Merged(1, lambda v: {"e": (F.max(v[0].number), F.max)}, lambda p: p["e"]),
    "First": Extreme(F.min),
    "Last": Extreme(F.max),
    "Sum over Sum": Merged(2, _sum_parts, lambda p: safe_div(_zero(p["s0"]), _zero(p["s1"]))),
    "80% Upper Bound": _bound(True),
    "80% Lower Bound": _bound(False),
    "Sum as Fraction of Total": Share(SUM, "total"),
    "Sum as Fraction of Rows": Share(SUM, "row"),
    "Sum as Fraction of Columns": Share(SUM, "col"),
    "Count as Fraction of Total": Share(COUNT, "total"),
    "Count as Fraction of Rows": Share(COUNT, "row"),
    "Count as Fraction of Columns": Share(COUNT, "col"),
}


# --- the operator --------------------------------------------------------------------------------


class _Frame:
    """Keys of a cross-tab under internal names, so that a key may also be a value attribute."""

    def __init__(self, rows: Sequence[str], cols: Sequence[str]):
        self.names = [*rows, *cols]
        self.rows = [f"_r{i}" for i in range(len(rows))]
        self.cols = [f"_c{i}" for i in range(len(cols))]
        self.keys = [*self.rows, *self.cols]

    def key_columns(self) -> list[Column]:
        return [null_text(name).alias(key) for name, key in zip(self.names, self.keys)]

    def level(self) -> Column:
        rows = F.grouping(self.rows[0]) if self.rows else F.lit(1)
        cols = F.grouping(self.cols[0]) if self.cols else F.lit(1)
        return (rows * 2 + cols).cast("int").alias("level")

    def levels(self) -> list[tuple[int, list[str]]]:
        """The grouping sets as (level, keys kept)."""
        sets = {CELL: self.keys, ROW_TOTAL: self.rows, COLUMN_TOTAL: self.cols, GRAND_TOTAL: []}
        if not self.cols:
            return [(ROW_TOTAL, sets[ROW_TOTAL]), (GRAND_TOTAL, [])]
        if not self.rows:
            return [(COLUMN_TOTAL, sets[COLUMN_TOTAL]), (GRAND_TOTAL, [])]
        return list(sets.items())

    def grouped(self, df: DataFrame, extra: Sequence[str] = ()):
        """Grouping sets (rows, cols), (rows), (cols), (), each with the extra keys."""
        sets = {tuple([*r, *c]) for r in (self.rows, []) for c in (self.cols, [])}
        columns = [[F.col(k) for k in [*s, *extra]] for s in sorted(sets)]
        return df.groupingSets(columns, *[F.col(k) for k in [*self.keys, *extra]])

    def renamed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(self.keys, self.names)],
                         *[c for c in df.columns if c not in self.keys])


def _merged(frame: _Frame, source: DataFrame, sets: Mapping[str, tuple[Merged, list[Value]]]) -> DataFrame:
    parts = {
        f"{name}__{part}": (aggregate, merge)
        for name, (aggregator, values) in sets.items()
        for part, (aggregate, merge) in aggregator.parts(values).items()
    }
    cells = source.groupBy(*frame.keys).agg(*[a.alias(n) for n, (a, _) in parts.items()])
    if not frame.keys:
        total = cells.withColumn("level", F.lit(GRAND_TOTAL))
    else:
        total = frame.grouped(cells).agg(frame.level(), *[m(F.col(n)).alias(n) for n, (_, m) in parts.items()])
    columns = []
    for name, (aggregator, values) in sets.items():
        own = {p: F.col(f"{name}__{p}") for p in aggregator.parts(values)}
        columns.append(aggregator.finish(own).alias(name))
    return total.select(*frame.keys, "level", *columns)


def _shared(frame: _Frame, table: DataFrame, names: Sequence[str], scope: str) -> DataFrame:
    if scope == "total":
        grand = table.filter(F.col("level") == GRAND_TOTAL)
        return table.withColumns({n: safe_div(n, grand.select(n).scalar()) for n in names})
    keys, whole = (frame.rows, (ROW_TOTAL, GRAND_TOTAL)) if scope == "row" else (frame.cols, (COLUMN_TOTAL, GRAND_TOTAL))
    # One total per key of the axis, joined back: a row with very many cells is not one window.
    sums = table.filter(F.col("level").isin(*whole)).select(
        *[F.col(k).alias(f"{k}_total") for k in keys], *[F.col(n).alias(f"{n}_total") for n in names])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_total"))
    return table.join(sums, on, "left").select(
        *frame.keys, "level", *[safe_div(n, f"{n}_total").alias(n) for n in names])


def _unpivoted(frame: _Frame, source: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(keys, name, value) rows, one per value attribute."""
    wide = source.select(*frame.keys, *[c.alias(n) for n, c in columns.items()])
    return wide.unpivot(frame.keys, list(columns), "_name", "_value")


def _by_name(frame: _Frame, table: DataFrame, names: Sequence[str]) -> DataFrame:
    return table.groupBy(*frame.keys, "level").agg(*[
        F.max(F.when(F.col("_name") == n, F.col("_result"))).alias(n) for n in names])


def _distinct(frame: _Frame, source: DataFrame, aggregator: Distinct, values: Mapping[str, Value]) -> DataFrame:
    pairs = _unpivoted(frame, source, {n: v.raw.cast("string") for n, v in values.items()})
    # Distinct per cell, then distinct per grouping set: a value is counted once in every total.
    seen = pairs.groupBy(*frame.keys, "_name", "_value").agg(F.lit(1).alias("_one"))
    spread = frame.grouped(seen, ("_name", "_value")).agg(frame.level())
    value = F.col("_value")
    result = spread.groupBy(*frame.keys, "level", "_name").agg(
        aggregator.column(value, natural_key(value)).alias("_result"))
    return _by_name(frame, result, list(values))


def _extremes(frame: _Frame, source: DataFrame, pick: Callable[[Column], Column], values: Mapping[str, Value]) -> DataFrame:
    """First or last values. Sort keys are structs, which are aggregated by sorting, so only distinct values get one."""
    names = [f"_v_{n}" for n in values]
    sets = [[*map(F.col, frame.keys), F.col(n)] for n in names]
    # The count is read, or else Spark would see that a minimum needs no distinct values and sort all rows after all.
    seen = source.groupingSets(sets, *frame.keys, *names).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
    best = [pick(F.when(v.raw.isNotNull(), F.struct(v.key.alias("key"), v.raw.alias("value")))).alias(n) for n, v in values.items()]
    cells = (seen.groupBy(*frame.keys) if frame.keys else seen.groupBy()).agg(*best)
    if frame.keys:
        total = frame.grouped(cells).agg(frame.level(), *[pick(F.col(n)).alias(n) for n in values])
    else:
        total = cells.withColumn("level", F.lit(GRAND_TOTAL))
    return total.select(*frame.keys, "level", *[F.col(n)["value"].alias(n) for n in values])


def _quantile(frame: _Frame, source: DataFrame, q: float, values: Mapping[str, Value]) -> DataFrame:
    pairs = _unpivoted(frame, source, {n: v.number for n, v in values.items()})
    # Counts of distinct values per cell, NULL included: a cell without numbers still is a cell.
    counts = with_buckets(pairs.groupBy(*frame.keys, "_name", F.col("_value").alias("value")).agg(
        F.count(F.lit(1)).alias("_n")))
    known, wanted = counts.filter(F.col("value").isNotNull()), {"_result": q}
    # Only bucket sizes are rolled up to the totals; a total then meets the values of its bucket alone.
    cells = known.groupBy(*frame.keys, "_name", "bucket").agg(F.sum("_n").alias("_n"))
    sizes = frame.grouped(cells, ("_name", "bucket")).agg(frame.level(), F.sum("_n").alias("bucket_rows"))
    groups = [*frame.keys, "level", "_name"]
    kept = cut(wanted_buckets(sizes, groups, wanted, "neighbours"))
    inside = in_buckets(_expanded(frame, known.withColumnRenamed("_n", "weight")), kept, groups)
    inside = inside.groupBy(*groups, "bucket", "value", "n", "before").agg(F.sum("weight").alias("weight"))
    found = ranked_quantiles(inside, groups, wanted, "neighbours")
    every = frame.grouped(counts.select(*frame.keys).distinct()).agg(frame.level())
    wide = _by_name(frame, found, list(values))
    on = every["level"] == wide["level"]
    for k in frame.keys:
        on = on & every[k].eqNullSafe(wide[k])
    return every.join(wide, on, "left").select(
        *[every[k] for k in frame.keys], every["level"], *[wide[n] for n in values])


def _expanded(frame: _Frame, df: DataFrame) -> DataFrame:
    """Rows of cells once per grouping set, with the keys that the set sums over as NULL."""
    parts = [
        df.withColumns({k: F.lit(None).cast("string") for k in frame.keys if k not in keys}).withColumn("level", F.lit(level).cast("int"))
        for level, keys in frame.levels()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _spreads(frame: _Frame, source: DataFrame, finish: Callable[[Column], Column], values: Mapping[str, Value]) -> DataFrame:
    """Sample variances: deviations within each cell plus those of the cell's mean from the total's mean.

    Source rows are aggregated once; both terms are differences from a mean, so nothing cancels.
    """
    cells = cut(source.groupBy(*frame.keys).agg(*[c for n, v in values.items() for c in (
        F.count(v.number).alias(f"{n}__n"), F.coalesce(F.avg(v.number), F.lit(0.0)).alias(f"{n}__mean"),
        F.coalesce(F.var_pop(v.number) * F.count(v.number), F.lit(0.0)).alias(f"{n}__within"))]))
    rows = _expanded(frame, cells) if frame.keys else cells.withColumn("level", F.lit(GRAND_TOTAL))
    keys = [*frame.keys, "level"]
    means = rows.groupBy(*keys).agg(*[c for n in values for c in (
        F.sum(f"{n}__n").alias(f"{n}__all"),
        safe_div(F.sum(F.col(f"{n}__n") * F.col(f"{n}__mean")), F.sum(f"{n}__n")).alias(f"{n}__centre"))])
    means = means.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in means.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    def squared(n: str) -> Column:
        off = F.col(f"{n}__mean") - F.col(f"{n}__centre")
        return F.sum(F.col(f"{n}__within") + F.col(f"{n}__n") * off * off)

    summed = rows.join(means, on).groupBy(*keys).agg(*[c for n in values for c in (
        F.max(f"{n}__all").alias(f"{n}__all"), squared(n).alias(f"{n}__squares"))])
    return summed.select(*keys, *[
        F.when(F.col(f"{n}__all") <= 1, F.lit(0.0)).otherwise(
            finish(safe_div(f"{n}__squares", F.col(f"{n}__all") - 1))).alias(n) for n in values])


def crosstab(
    df: DataFrame,
    rows: Sequence[str] = (),
    cols: Sequence[str] = (),
    vals: Sequence[str] = (),
    aggregator: str | Callable[..., Column] | UserAggregator = "Count",
    *,
    q: float | None = None,
    predicate: Column | None = None,
    derived: Mapping[str, Callable[[], Column] | Column] | None = None,
    sorters: Mapping[str, Sorter] | None = None,
    totals: bool = True,
) -> DataFrame:
    """Cross-tabulate ``vals`` by ``rows`` and ``cols``.

    ``aggregator`` is a name of ``AGGREGATORS``, ``"Quantile"`` (with ``q``), a callable that
    gets one column per input and returns an aggregate column, or a ``UserAggregator`` with a state of
    its own. An aggregator with one input makes one result column per value attribute, any other makes
    the column ``value``.
    """
    sorters = sorters or {}
    if derived:
        df = derive(df, derived)
    if predicate is not None:
        df = df.filter(predicate)
    if isinstance(aggregator, UserAggregator):
        chosen = aggregator
    elif callable(aggregator):
        chosen = Direct(len(vals), lambda v: aggregator(*[x.raw for x in v]))
    elif aggregator == "Quantile":
        if q is None:
            raise ValueError("Quantile needs q")
        chosen = Quantile(q)
    elif aggregator in AGGREGATORS:
        chosen = AGGREGATORS[aggregator]
    else:
        raise ValueError(f"unknown aggregator: {aggregator}")
    one_input = chosen.inputs == 1 and not callable(aggregator)
    if one_input and not vals or not one_input and len(vals) < chosen.inputs:
        raise ValueError(f"aggregator needs {chosen.inputs} value attribute(s)")
    if set(vals) & {*rows, *cols} and one_input:
        raise ValueError("a value attribute needs another name than the keys; derive a copy")

    frame = _Frame(rows, cols)
    types = dict(df.dtypes)
    picked = list(dict.fromkeys(vals))
    source = df.select(*frame.key_columns(), *[F.col(v).alias(f"_v_{v}") for v in picked])

    def value(v: str) -> Value:
        raw = F.col(f"_v_{v}")
        return Value(raw, number_of(raw, types[v]), sort_key(raw, sorters.get(v)))

    named = {v: value(v) for v in vals} if one_input else {}
    inputs = [value(v) for v in vals[: chosen.inputs]]
    base = chosen.of if isinstance(chosen, Share) else chosen

    if isinstance(base, UserAggregator):
        inputs_of = {v: [f"_v_{v}"] for v in vals} if one_input else {"value": [f"_v_{v}" for v in vals[: base.inputs]]}
        # No columns at all would leave a partition's rows without a shape.
        rows_of = source if source.columns else source.withColumn("_row", F.lit(1))
        levels = frame.levels() if frame.keys else [(GRAND_TOTAL, [])]
        table = _by_name(frame, stateful(rows_of, frame.keys, levels, inputs_of, base), list(inputs_of))
    elif isinstance(base, Merged):
        sets = {n: (base, [v]) for n, v in named.items()} if one_input else {"value": (base, inputs)}
        table = _merged(frame, source, sets)
        if isinstance(chosen, Share):
            table = _shared(frame, table, list(sets), chosen.scope)
    elif isinstance(base, Extreme):
        table = _extremes(frame, source, base.pick, named)
    elif isinstance(base, Spread):
        table = _spreads(frame, source, base.finish, named)
    elif isinstance(base, Direct):
        columns = ([base.column([v]).alias(n) for n, v in named.items()] if one_input
                   else [base.column(inputs).alias("value")])
        if frame.keys:
            table = frame.grouped(source).agg(frame.level(), *columns)
        else:
            table = source.agg(*columns).withColumn("level", F.lit(GRAND_TOTAL))
    else:
        if not frame.keys:
            raise ValueError("this aggregator needs a row or column attribute")
        table = (_distinct(frame, source, base, named) if isinstance(base, Distinct)
                 else _quantile(frame, source, base.q, named))
    if not totals:
        table = table.filter(F.col("level") == CELL)
    return frame.renamed(table)


# --- order and scales ----------------------------------------------------------------------------


def axis_rank(
    table: DataFrame,
    axis: Sequence[str],
    level: int,
    name: str,
    order: str = "key_a_to_z",
    value: str | None = None,
    sorters: Mapping[str, Sorter] | None = None,
) -> DataFrame:
    """Position of every key of one axis, by key order or by its total."""
    sorters = sorters or {}
    by_key = [sort_key(F.col(a), sorters.get(a)) for a in axis]
    if order == "key_a_to_z":
        keys = by_key
    elif order in ("value_a_to_z", "value_z_to_a"):
        keys = [F.col(value) if order == "value_a_to_z" else -F.col(value), *by_key]
    else:
        raise ValueError(f"unknown order: {order}")
    return ordered_position(table.filter(F.col("level") == level), keys, name).select(*axis, name)


def ordered(
    table: DataFrame,
    rows: Sequence[str],
    cols: Sequence[str],
    value: str | None = None,
    row_order: str = "key_a_to_z",
    col_order: str = "key_a_to_z",
    sorters: Mapping[str, Sorter] | None = None,
) -> DataFrame:
    """Add ``row_rank`` and ``col_rank``; a total over an axis has no rank on it."""
    for axis, level, name, order in (
        (rows, ROW_TOTAL, "row_rank", row_order), (cols, COLUMN_TOTAL, "col_rank", col_order),
    ):
        if axis:
            table = table.join(axis_rank(table, axis, level, name, order, value, sorters), list(axis), "left")
    return table


def _scoped(table: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str, scope: str,
            levels: Sequence[int]) -> DataFrame:
    """Add the minimum and maximum of the finite values in the scope of each row."""
    inside = {"table": (), "row": rows, "col": cols}[scope]
    scope_keys = {f"_s{i}": F.when(F.col("level") == CELL, F.col(k)) for i, k in enumerate(inside)}
    keyed = table.withColumns(scope_keys) if scope_keys else table
    x = F.col(value).cast("double")
    bounds = keyed.filter(F.col("level").isin(list(levels)) & is_finite(x)).groupBy(
        F.col("level").alias("_level"), *[F.col(k).alias(f"b{k}") for k in scope_keys]
    ).agg(F.min(x).alias("_min"), F.max(x).alias("_max"))
    on = F.col("level") == F.col("_level")
    for k in scope_keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b{k}"))
    return keyed.join(bounds, on, "left").drop("_level", *scope_keys, *[f"b{k}" for k in scope_keys])


def heatmap_scale(table: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str, scope: str = "table") -> DataFrame:
    """``shade`` 0..255 of every cell within the table, its row or its column; totals apart."""
    x = F.col(value).cast("double")
    scoped = _scoped(table, rows, cols, value, scope, (CELL, ROW_TOTAL, COLUMN_TOTAL))
    share = safe_div(x - F.col("_min"), F.col("_max") - F.col("_min"))
    shade = 255 - F.floor(255 * F.when(is_finite(x), share) + 0.5)
    return scoped.withColumn("shade", shade.cast("int")).drop("_min", "_max")


def bar_scale(table: DataFrame, rows: Sequence[str], cols: Sequence[str], value: str) -> DataFrame:
    """``bar_base`` and ``bar_height`` in percent, scaled within each row and the column totals."""
    x = F.col(value).cast("double")
    scoped = _scoped(table, rows, cols, value, "row", (CELL, COLUMN_TOTAL))
    top = F.greatest(F.col("_max"), F.lit(0.0))
    low = F.col("_min")
    span = F.when(low < 0, top - low).otherwise(top)

    def scale(v: Column) -> Column:
        return safe_div(v * 100, span * 1.4)

    base = F.when(low < 0, scale(-low)).otherwise(F.lit(0.0)) + F.when(x < 0, scale(x)).otherwise(F.lit(0.0))
    shown = is_finite(x) & low.isNotNull()
    return scoped.withColumns({
        "bar_base": F.when(shown, base), "bar_height": F.when(shown, scale(F.abs(x)))}).drop("_min", "_max")


def to_wide(table: DataFrame, rows: Sequence[str], col: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Cells with one column per given column key; the long form is the result for any number of keys."""
    return table.filter(F.col("level") == CELL).groupBy(*rows).pivot(col, list(keys)).agg(F.first(value))
