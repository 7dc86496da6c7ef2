"""Cross-tab aggregators that a caller writes with a state of their own.

An aggregator folds values into a state (``push``), joins two states (``merge``) and reads the result
(``value``). Rows are folded where they lie: each partition keeps one state per cell and sends it on as
Arrow columns. States of one cell meet under a salt first and then all together, and totals merge the
states of cells, not rows. States are merged one by one from a sorted stream, so that neither the rows
of a group nor its states are ever held together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

State = dict

# Cells whose states one task holds before it sends them on, and rows that it folds at a time: a batch of Arrow
# holds a few rows of each cell only, and a push costs much the same for a few rows as for many.
HELD = 20_000
FOLDED = 250_000
SALTS = 16


class UserAggregator:
    """Base of aggregators with a state.

    ``state`` names the state's fields and their types, ``result`` the type of the value, ``inputs`` how many
    columns ``push`` gets. With one input every value attribute makes a result column of its own.
    """

    inputs: int = 1
    state: str = "n long"
    result: str = "double"

    def push(self, state: State | None, *values: pd.Series) -> State:
        """The state after more rows, given by column; None is the state before any row."""
        raise NotImplementedError

    def merge(self, one: State, other: State) -> State:
        raise NotImplementedError

    def value(self, state: State):
        raise NotImplementedError


def _named(state: State, fields: Sequence[str]) -> tuple:
    return tuple(state[f] for f in fields)


def gathered(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches, put together until they have so many rows."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def partial_states(
    source: DataFrame, keys: Sequence[str], inputs: Mapping[str, Sequence[str]], aggregator: UserAggregator,
) -> DataFrame:
    """(keys, _name, _salt, state fields): one row per cell, name and partition, or a few of them."""
    fields = StructType.fromDDL(aggregator.state).names
    columns = [*keys, "_name", "_salt", *fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt, states = TaskContext.get().partitionId() % SALTS, {}

        def sent() -> pd.DataFrame:
            rows = [(*cell, name, salt, *_named(state, fields)) for (cell, name), state in states.items()]
            return pd.DataFrame(rows, columns=columns)

        for frame in gathered(frames, FOLDED):
            parts = frame.groupby(list(keys), sort=False) if keys else [((), frame)]
            for cell, rows in parts:
                for name, names in inputs.items():
                    states[cell, name] = aggregator.push(states.get((cell, name)), *[rows[c] for c in names])
            if len(states) > HELD:
                yield sent()
                states = {}
        if states:
            yield sent()

    kinds = "".join(f"{k} string, " for k in keys)
    return source.mapInPandas(run, f"{kinds}_name string, _salt int, {aggregator.state}")


def merged_states(states: DataFrame, keys: Sequence[str], aggregator: UserAggregator) -> DataFrame:
    """One state per key, merged in the order of a sorted stream."""
    fields = StructType.fromDDL(aggregator.state).names
    schema = StructType([states.schema[c] for c in [*keys, *fields]])
    width = len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, done = None, None, []
        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                key, fresh = row[:width], dict(zip(fields, row[width:]))
                if key == current:
                    state = aggregator.merge(state, fresh)
                    continue
                if current is not None:
                    done.append((*current, *_named(state, fields)))
                current, state = key, fresh
            if done:
                yield pd.DataFrame(done, columns=schema.names)
                done = []
        if current is not None:
            yield pd.DataFrame([(*current, *_named(state, fields))], columns=schema.names)

    streams = states.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*keys)
    return streams.mapInPandas(run, schema)


def stateful(
    source: DataFrame,
    keys: Sequence[str],
    levels: Sequence[tuple[int, Sequence[str]]],
    inputs: Mapping[str, Sequence[str]],
    aggregator: UserAggregator,
) -> DataFrame:
    """(keys, level, _name, _result) for the cells of ``keys`` and their totals.

    ``levels`` lists the grouping sets as (level, keys kept); ``inputs`` the columns of each named value.
    """
    fields = StructType.fromDDL(aggregator.state).names
    cells = merged_states(partial_states(source, keys, inputs, aggregator), [*keys, "_name", "_salt"], aggregator)
    spread = reduce(lambda a, b: a.unionByName(b), [
        cells.withColumns({**{k: F.lit(None).cast("string") for k in keys if k not in kept}, "level": F.lit(level).cast("int")})
        for level, kept in levels])
    salted = merged_states(spread, [*keys, "level", "_name", "_salt"], aggregator)
    whole = merged_states(salted, [*keys, "level", "_name"], aggregator)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known = frame[fields].astype(object).where(frame[fields].notna(), None)
            out = frame[[*keys, "level", "_name"]].copy()
            out["_result"] = [aggregator.value(dict(zip(fields, row))) for row in known.itertuples(index=False, name=None)]
            yield out

    kinds = "".join(f"{k} string, " for k in keys)
    return whole.mapInPandas(finish, f"{kinds}level int, _name string, _result {aggregator.result}")


class GeometricMean(UserAggregator):
    """Geometric mean of the positive values."""

    state = "n long, logs double"

    def push(self, state, values):
        import numpy as np

        known = pd.to_numeric(values, errors="coerce").to_numpy(dtype=float)
        known = known[known > 0]
        before = state or {"n": 0, "logs": 0.0}
        return {"n": before["n"] + len(known), "logs": before["logs"] + float(np.log(known).sum())}

    def merge(self, one, other):
        return {"n": one["n"] + other["n"], "logs": one["logs"] + other["logs"]}

    def value(self, state):
        import math

        return math.exp(state["logs"] / state["n"]) if state["n"] else None


class Mode(UserAggregator):
    """The most frequent value as text, the least of equally frequent ones; missing values do not count."""

    state = "counts map<string,long>"
    result = "string"

    def push(self, state, values):
        return self.merge(state or {"counts": {}}, {"counts": values.dropna().astype(str).value_counts().to_dict()})

    def merge(self, one, other):
        counts = dict(one["counts"])
        for value, n in dict(other["counts"]).items():
            counts[value] = counts.get(value, 0) + n
        return {"counts": counts}

    def value(self, state):
        return min(state["counts"].items(), key=lambda item: (-item[1], item[0]), default=(None, 0))[0]
