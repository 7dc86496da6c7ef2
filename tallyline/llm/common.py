"""Helpers shared by the operators of this package: written tables, hot keys, tokenizers."""

from __future__ import annotations

import functools
import gc
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.lineage import scratch_path


# Folders of the tables written by this process, with weak references to what their readers' plans hold on to.
_tables: list[tuple[str, object]] = []


def sweep(spark, collect: bool = False) -> None:
    """Remove written tables that no DataFrame can read any more.

    Every plan over a table holds the table's file index. Once that object is gone from the driver, no result,
    however late it is asked for, can reach the table. ``collect`` lets both collectors run before.
    """
    jvm = spark.sparkContext._jvm
    if collect:
        gc.collect()
        jvm.System.gc()
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for entry in list(_tables):
        if entry[1].refersTo(None):
            _tables.remove(entry)
            place = jvm.org.apache.hadoop.fs.Path(entry[0])
            place.getFileSystem(configuration).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage like a checkpoint, but compressed and by column, so that a later step reads
    only what it needs and a lost executor costs nothing that was written. The table goes when
    nothing can read it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    index = back._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _tables.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    sweep(spark)
    return back


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names close to ``wanted`` that no column of ``df`` has (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas refer to it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- tokenizers ---------------------------------------------------------------------------------


def vocabulary_path(name: str) -> str:
    """A file of the installed vocabularies; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Encoder:
    """Ids of whole texts, as the ``tokenizers`` library gives them for one vocabulary file.

    A byte-level BPE file whose merges come in the order of their ids can be encoded by ranks,
    which takes about a third of the time; the library itself encodes for every other file and
    every text in which an added token's string occurs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added: list[str] = []
        self.fast = self._by_ranks(path)

    def _by_ranks(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            spec.get("normalizer") is None and model.get("type", "BPE") == "BPE"
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True)
            and before.get("use_regex", True) and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not model.get("ignore_merges")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])
        )
        if not plain:
            return None
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = [vocabulary[a + b] for a, b in merges]
        singles = _byte_alphabet()
        if any(x >= y for x, y in zip(order, order[1:])) or not set(singles) <= set(vocabulary):
            return None
        import public_tokenizers
        import tiktoken

        added = {t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(singles[c] for c in token): i for token, i in vocabulary.items() if i not in added
        }
        return tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str):
        """The ids of one text, as a sequence."""
        # The rank encoder's pattern runs on a stack that very long white space would overflow.
        if self.fast is None or len(text) > 500_000 or any(t in text for t in self.added):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def batches_of(frames: Iterator, rows: int) -> Iterator:
    """The incoming batches, cut to at most ``rows`` rows."""
    for frame in frames:
        for start in range(0, len(frame), rows):
            yield frame.iloc[start:start + rows]
