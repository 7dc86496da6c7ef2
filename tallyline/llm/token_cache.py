"""Token counts with a digest cache: only texts that were never counted are encoded.

Counts are stored under two digests, that of the normalised content and that of the tokenizer
version. A run joins the digests of its texts to the stored counts, encodes one text of each digest
that is missing, appends those counts and joins again. Texts move once, and only to bring one copy
of each missing digest to an encoder: copies of a text meet as digests only.

Edge cases: a null text counts as empty (0 tokens); rows with a null id, repeated ids and repeated
rows each keep their own row; an empty table gives an empty result; other columns of ``docs`` are
left out unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyline.lineage import scratch_path
from tallyline.llm.common import encoder, table, vocabulary_path, whole_text, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {importlib.metadata.version(library)} {content}".encode()).hexdigest()


def counter(path: str) -> Callable[[str], int]:
    """Tokens of one text, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    ids = encoder(path).ids
    return lambda text: len(ids(text))


def stored(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; a digest that two runs stored counts once."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException:  # nothing was stored yet
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return cache.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, digest, n_bytes, n_tokens), one row per row of ``docs``.

    ``normalise`` maps texts with equal counts to one content; the default changes nothing, which
    is right for every tokenizer. ``cache_path`` is a folder that lives as long as the counts shall.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    content = normalise(whole_text(text_column))
    digest = F.unhex(F.sha2(content, 256))
    keys = written(
        docs.select(F.col(id_column).alias(id_column), *keep, digest.alias("digest"),
                    F.octet_length(whole_text(text_column)).cast("long").alias("n_bytes")),
        "token-keys",
    )
    missing = (
        keys.groupBy("digest").agg(F.min(id_column).alias("_one"))
        .join(stored(spark, cache_path, version), "digest", "left_anti")
        .withColumnRenamed("digest", "_digest")
    )
    # The missing digests are the narrow side and are built into a table per partition; texts
    # stream past it unsorted. The key holds the id, so that copies of one text do not meet.
    texts = docs.select(F.col(id_column).alias("_id"), content.alias("_text"), digest.alias("_key"))
    chosen = texts.join(
        missing.hint("shuffle_hash"),
        (F.col("_key") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_one")),
    ).select(F.col("_digest").alias("digest"), "_text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(tokenizer)
        for frame in frames:
            frame = frame.drop_duplicates("digest")
            yield pd.DataFrame({"digest": frame["digest"], "n_tokens": [tokens(t) for t in frame["_text"]]})

    fresh = chosen.mapInPandas(count, "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    # Written, so that both sides of the join are plain exchanges and a digest of very many copies can be split.
    return keys.join(written(stored(spark, cache_path, version), "token-counts"), "digest")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, cache_path: str | None = None) -> DataFrame:
    """Token counts of all documents; without a ``cache_path`` the cache starts empty."""
    counted = token_counts(
        table(spark, sf_dir, "documents"),
        cache_path or scratch_path(spark, "token-cache"),
        tokenizer or vocabulary_path("byte_bpe_50k.json"),
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
