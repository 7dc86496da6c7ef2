"""A history stored by month, of which a refresh rewrites only the months of the extract.

Rows lie in one folder per month. A refresh first computes the extract and writes it aside; only then are
its months replaced, by Spark's dynamic partition overwrite, which moves finished files into place when all tasks
are done. So a failure while rows are computed or written leaves the stored rows as they were, and other months'
files are never touched. Readers prune by month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.dates import month_start, stamp
from tallyline.lineage import cut

MONTH = "stored_month"


def _month(date) -> Column:
    return F.date_format(date, "yyyyMM").cast("int")


def _written(df: DataFrame, path: str, date: str) -> None:
    # AQE's rebalance spreads a month that holds most of the rows over many files.
    staged = df.withColumn(MONTH, _month(F.col(date))).hint("rebalance", MONTH)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def create(df: DataFrame, path: str, date: str = "sales_date") -> None:
    """A new store; an existing one only loses the months that ``df`` has."""
    _written(df, path, date)


def months(spark: SparkSession, path: str) -> list[int]:
    """The stored months as yyyymm, from the folder names: as many as the calendar has."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    values = [n.partition("=")[2] for n in names if n.startswith(f"{MONTH}=")]
    return sorted(int(v) for v in values if v.isdigit())  # rows without a date have a folder of another name


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """The stored rows, or those from month ``first`` to month ``last``; other months' folders are not listed for reading."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col(MONTH) >= _month(month_start(stamp(first))))
    if last is not None:
        rows = rows.filter(F.col(MONTH) <= _month(month_start(stamp(last))))
    return rows.drop(MONTH)


def refresh(spark: SparkSession, path: str, extract: DataFrame, date: str = "sales_date") -> list[int]:
    """Replace the stored months from the extract's first to its last by the extract; the months replaced.

    Rows of the extract without a date replace the stored rows without one. Stored months inside the range
    for which the extract has no row go, after the others have been written.
    """
    extract = cut(extract)  # computed before anything stored is touched
    span = extract.agg(_month(F.min(date)).alias("first"), _month(F.max(date)).alias("last"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return []
    before = months(spark, path)
    _written(extract, path, date)
    new = {r[0] for r in extract.select(_month(F.col(date))).distinct().collect()}  # one value per month
    if span["first"] is not None:
        files, _ = _folder(spark, path)
        for stale in before:
            if span["first"] <= stale <= span["last"] and stale not in new:
                files.delete(_folder(spark, f"{path.rstrip('/')}/{MONTH}={stale}")[1], True)
    return sorted(m for m in new if m is not None)
