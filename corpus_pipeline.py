"""The training-data pipeline: stages over the documents table, each written and read again.

All stages but the last return the columns they were given. ``n_chars``, where there is such a
column, follows the text. The near-duplicate stage decides per row: rows that share an id stay or go by
their own text, and rows without an id come after all others. An empty table passes through every stage.

A stage begins by removing intermediate tables that no result can read any more: those of a stage
whose result was written, or given up. Results that are read late, or chained without a write, keep theirs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import divergence, line_chunks, ngram_join, packing, pii_crf
from tallyline.llm.common import sweep, table, vocabulary_path, written


def _stage(step):
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, collect=True)
        return step(spark, docs, sf_dir)

    return run_step


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the reference of their language."""
    source = [c for c in docs.columns if c == "source"]
    rows = docs.select("doc_id", "lang", "text", *source, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return divergence.judge(rows, keep=["_row"]).filter("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines or more are taken out of all texts but the first."""
    return _counted(line_chunks.dedup(docs).select(*[f"`{c}`" for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id."""
    return ngram_join.first_rows(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return _counted(pii_crf.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences, with their ids."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", _stage(quality)),
    ("lines", _stage(lines)),
    ("near_duplicates", _stage(near_duplicates)),
    ("personal_data", _stage(personal_data)),
    ("packing", _stage(packed)),
]

# No single SQL statement: stages of the list tokenize, search components and apply a trained tagger.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
