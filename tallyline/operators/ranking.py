"""Global positions without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.lineage import cut


def ordered_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row in the given order.

    ``row_number`` over the whole table would sort it in one task. Here the rows are range
    partitioned on the order, each partition is numbered on its own, and the sizes of the
    earlier partitions are added. The range partitioning is written to the checkpoint folder,
    because a second run could choose other boundaries.
    """
    keyed = df.withColumns({f"_k{i}": c for i, c in enumerate(order)})
    keys = [f"_k{i}" for i in range(len(order))]
    ranged = cut(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition: its running sum is as small as the number of partitions.
    starts = sizes.withColumn(
        "_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).drop("_rows")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return (
        ranged.join(starts, "_part")
        .withColumn(name, (F.col("_before") + local).cast("long"))
        .drop("_part", "_before", *keys)
    )
