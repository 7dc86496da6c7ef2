"""File and database sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyline.names import FLOAT_MEASURES


def cast_measures(df: DataFrame, measures: Sequence[str] = FLOAT_MEASURES) -> DataFrame:
    """Cast the named measures that exist to 32-bit floats."""
    return df.withColumns({m: F.col(m).cast("float") for m in measures if m in df.columns})


def scan_parquet_typed(
    spark: SparkSession, path: str, measures: Sequence[str] = FLOAT_MEASURES,
) -> DataFrame:
    return cast_measures(spark.read.parquet(path), measures)


def remote_reader(
    spark: SparkSession,
    options: Mapping[str, str],
    query: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> DataFrameReader:
    """A JDBC reader for a remote table; connection options come from the caller.

    With a partition column the query is read as ``partitions`` parallel range scans, so no
    single connection carries the whole result. Without one it is a single scan.
    """
    reader = spark.read.format("jdbc").options(**options).option("fetchsize", fetch_size)
    reader = reader.option("dbtable", f"({query}) src")
    if partition_column is not None:
        if bounds is None or not partitions:
            raise ValueError("a partitioned read needs bounds and a partition count")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader


def append_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Record batches of one schema as one table."""
    if not batches:
        raise ValueError("no batches")
    return reduce(lambda a, b: a.unionByName(b), batches)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite ``path``; never the path ``df`` is being read from.

    Rows of one partition value are spread over tasks by AQE's rebalance, so a value that holds
    most of the rows is written by many tasks and small values do not leave small files.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema: no inference pass over the files."""
    return spark.read.schema(schema).json(path)
