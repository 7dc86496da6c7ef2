"""Remote tables read as Arrow record batches, one task per batch.

A client knows a remote table: it lists the batches that may hold wanted rows and fetches one of them as
Arrow. ``RemoteBatches`` makes a client a Spark source: batches become partitions, filters that the client
can apply itself are pushed to it, and record batches pass into Spark as they arrive, so nothing is appended
in the driver. Batches are named by handles that any executor can fetch again, so a lost task costs one batch.

    read_batches(spark, "tallyline.sources.remote:ParquetBatches", {"path": folder}, columns=[...]).filter(...)
"""

from __future__ import annotations

import importlib
import operator
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

# One comparison: column, operator, value. Operators: = > >= < <= in "is not null".
Condition = tuple[str, str, Any]

COMPARISONS = {
    ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.In: "in",
}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class BatchClient:
    """What a client must offer. It is built from its options in the driver and again in every task."""

    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)

    def schema(self) -> pa.Schema:
        raise NotImplementedError

    def batches(self, conditions: Sequence[Condition]) -> list[Any]:
        """Handles, small and picklable, of all batches in which a row may meet the conditions."""
        raise NotImplementedError

    def fetch(self, handle: Any, columns: Sequence[str], conditions: Sequence[Condition]) -> Iterator[pa.RecordBatch]:
        """The rows of one batch that meet the conditions."""
        raise NotImplementedError


class ParquetBatches(BatchClient):
    """The row groups of Parquet files under ``path``; row groups whose statistics rule a condition out are not listed."""

    def _dataset(self):
        import pyarrow.dataset

        return pyarrow.dataset.dataset(self.options["path"], format="parquet")

    def schema(self) -> pa.Schema:
        return self._dataset().schema

    def batches(self, conditions):
        wanted = expression(conditions)
        return [(part.path, part.row_groups[0].id) for file in self._dataset().get_fragments(filter=wanted)
                for part in file.split_by_row_group(wanted)]

    def fetch(self, handle, columns, conditions):
        import pyarrow.dataset

        whole, (path, group) = self._dataset(), handle
        part = pyarrow.dataset.ParquetFileFormat().make_fragment(path, whole.filesystem, row_groups=[group])
        yield from part.to_batches(schema=whole.schema, columns=list(columns), filter=expression(conditions))


class QueryBatches(BatchClient):
    """A query in ranges of an integer column, over a connection that returns Arrow.

    ``connect`` names a function (``module:name``) without arguments that returns a connection or cursor with
    ``execute(sql, values)`` and then ``to_arrow_reader`` or ``fetch_record_batch``. ``query`` is the text of the
    relation, ``split`` the column, ``low`` and ``high`` its bounds (the first and last batch are open), ``parts``
    the number of batches.
    """

    def _read(self, sql: str, values: Sequence[Any] = ()) -> pa.RecordBatchReader:
        opened = found(self.options["connect"])()
        done = opened.execute(sql, list(values)) or opened
        return (getattr(done, "to_arrow_reader", None) or done.fetch_record_batch)()

    def schema(self) -> pa.Schema:
        return self._read(f"SELECT * FROM ({self.options['query']}) AS q WHERE 1 = 0").schema

    def batches(self, conditions):
        low, high, parts = (int(self.options[k]) for k in ("low", "high", "parts"))
        edges = [low + (high - low + 1) * i // parts for i in range(1, parts)]
        return list(zip([None, *edges], [*edges, None]))

    def fetch(self, handle, columns, conditions):
        split = self.options["split"]
        low, high = handle
        ranges: list[Condition] = [(split, op, x) for op, x in ((">=", low), ("<", high)) if x is not None]
        tests, values = [], []
        for column, op, value in [*conditions, *ranges]:
            if op == "is not null":
                tests.append(f'"{column}" IS NOT NULL')
            elif op == "in":
                tests.append(f'"{column}" IN ({", ".join("?" * len(value))})')
                values += list(value)
            else:
                tests.append(f'"{column}" {op} ?')
                values.append(value)
        # Rows without the split column belong to the first batch.
        where = " AND ".join(tests) or "1 = 1"
        if low is None and high is not None:
            where = f'({where} OR ("{split}" IS NULL{"".join(" AND " + t for t in tests[:len(conditions)])}))'
            values += values[:-1]
        names = ", ".join(f'"{c}"' for c in columns)
        yield from self._read(f"SELECT {names} FROM ({self.options['query']}) AS q WHERE {where}", values)


def found(name: str):
    """What ``module:name`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def expression(conditions: Sequence[Condition]) -> pc.Expression | None:
    """The conditions as one Arrow expression."""
    tests = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
    parts = []
    for column, op, value in conditions:
        x = pc.field(column)
        if op == "is not null":
            parts.append(x.is_valid())
        else:
            parts.append(x.isin(list(value)) if op == "in" else tests[op](x, value))
    return reduce(operator.and_, parts) if parts else None


class _Batch(ds.InputPartition):
    def __init__(self, handle: Any):
        super().__init__(handle)
        self.handle = handle


class _Reader(ds.DataSourceReader):
    def __init__(self, schema: StructType, client: str, options: Mapping[str, str]):
        self.columns, self.client, self.options = schema.names, client, dict(options)
        self.conditions: list[Condition] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            value = getattr(f, "value", None)
            if len(column) == 1 and isinstance(f, ds.IsNotNull):
                self.conditions.append((column[0], "is not null", None))
            elif len(column) == 1 and type(f) in COMPARISONS and value is not None:
                self.conditions.append((column[0], COMPARISONS[type(f)], value))
            else:
                yield f

    def partitions(self):
        # No batch at all still is one (empty) read.
        return [_Batch(h) for h in found(self.client)(self.options).batches(self.conditions)] or [_Batch(None)]

    def read(self, partition):
        if partition.handle is not None:
            yield from found(self.client)(self.options).fetch(partition.handle, self.columns, self.conditions)


class RemoteBatches(ds.DataSource):
    """Spark source over a ``BatchClient``; options: ``client``, ``columns`` (comma-separated) and the client's own."""

    @classmethod
    def name(cls) -> str:
        return "remote_batches"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        whole = found(self.options["client"])(dict(self.options)).schema()
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        return from_arrow_schema(pa.schema([whole.field(c) for c in wanted]) if wanted else whole)

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return _Reader(schema, self.options["client"], dict(self.options))


def read_batches(
    spark: SparkSession, client: str, options: Mapping[str, str], columns: Sequence[str] = (),
) -> DataFrame:
    """The remote table as a DataFrame; filters on it are pushed to the client where it knows them.

    Spark pushes filters to Python sources only with a setting that is off by default; it is switched on
    for this session. Columns are not pruned by Spark, so name the wanted ones.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RemoteBatches)
    return spark.read.format("remote_batches").options(client=client, columns=",".join(columns), **options).load()
