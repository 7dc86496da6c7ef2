"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Class k holds pieces that fit a slot of capacity / k and fills each of its sequences with exactly k
of them. Membership depends on a piece's length alone, so every worker classifies and numbers its
own pieces; only the number of pieces per worker and class is exchanged. Since documents may be cut,
each one is first cut at slot lengths: whole sequences, then the largest slot that fits, a few times
over. Those pieces fill their sequences without padding; only the short rest of a document is
rounded up to a slot. The sequences that remain unfilled, one per class, are put together.

Edge cases: an empty or null text is the end id alone; null and repeated ids and repeated rows are
packed row by row; an empty table gives no piece; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.common import encoder, table, vocabulary_path, whole_text, written

PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, class int, part int, ordinal long, ids binary"
)


def classes(capacity: int) -> list[tuple[int, int]]:
    """(pieces per sequence, slot length) by falling slot: 1, 2, 3, 4, 6, 8, 12, 16, then powers of two.

    Thirds of powers of two are kept while rounding the slot down wastes little.
    """
    wanted = {1 << i for i in range(capacity.bit_length())} | {3 << i for i in range(capacity.bit_length())}
    kept = sorted(k for k in wanted if k <= capacity and capacity // k * k >= 0.995 * capacity)
    slots: dict[int, int] = {}
    for k in kept:
        slots[capacity // k] = k
    if 1 not in slots:
        slots[1] = capacity
    return [(k, slot) for slot, k in sorted(slots.items(), reverse=True)]


def cut_lengths(n: int, capacity: int, slots: list[tuple[int, int]], cuts: int) -> list[tuple[int, int]]:
    """(length, class) of the consecutive pieces of a document of ``n`` ids."""
    pieces = [(capacity, 0)] * (n // capacity)
    rest = n % capacity
    for _ in range(cuts):
        if not rest:
            break
        index = next(i for i, (_, slot) in enumerate(slots) if slot <= rest)
        pieces.append((slots[index][1], index))
        rest -= slots[index][1]
    if rest:
        index = max(i for i, (_, slot) in enumerate(slots) if slot >= rest)
        pieces.append((rest, index))
    return pieces


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = 2048, cuts: int = 3,
) -> DataFrame:
    """Pieces of all documents with their class, their number in worker and class, and their ids.

    ``ids`` holds little-endian unsigned 32-bit numbers. The numbers come from the task that made
    the piece, so the table has to be written before it is used twice.
    """
    slots = classes(capacity)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(tokenizer).ids, TaskContext.get().partitionId()
        end = [] if end_id is None else [end_id]
        used = [0] * len(slots)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["_id"].tolist(), frame["_text"].tolist()):
                ids = np.array([*encode(text), *end], dtype="<u4").tobytes()
                start = 0
                for length, index in cut_lengths(len(ids) // 4, capacity, slots, cuts):
                    rows.append((None if pd.isna(doc_id) else int(doc_id), start, length, len(ids) // 4, index, part,
                                 used[index], ids[4 * start:4 * (start + length)]))
                    used[index] += 1
                    start += length
            names = ["doc_id", "start", "length", "doc_tokens", "class", "part", "ordinal", "ids"]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("_text")).mapInPandas(
        cut, PIECE_SCHEMA)


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces.

    The driver sees one count per class. The numbers of earlier workers are a running sum over
    (worker, class) counts, which no piece takes part in.
    """
    slots = classes(capacity)
    counts = pieces.groupBy("class", "part").agg(F.max("ordinal").alias("_n")).withColumn("_n", F.col("_n") + 1)
    totals = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("_n").alias("n")).collect()}
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("class").alias("_class"), F.col("part").alias("_part"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    base, tail_of, bins, next_id = {}, {}, [], 0
    for index, (k, _) in enumerate(slots):
        base[index] = next_id
        next_id += totals.get(index, 0) // k
    for index, (k, slot) in enumerate(slots):  # falling slots, though not falling sums: first fit
        size = totals.get(index, 0) % k * slot
        if size:
            found = next((b for b in bins if b[0] + size <= capacity), None)
            if found is None:
                found = [0, next_id]
                next_id += 1
                bins.append(found)
            found[0] += size
            tail_of[index] = found[1]

    def by_class(values: dict[int, int], otherwise: int = 0):
        return F.element_at(F.array(*[F.lit(values.get(i, otherwise)).cast("long") for i in range(len(slots))]),
                            F.col("class") + 1)

    per = by_class({i: k for i, (k, _) in enumerate(slots)})
    full = by_class({i: totals.get(i, 0) // k for i, (k, _) in enumerate(slots)})
    numbered = (
        pieces.join(before, (F.col("class") == F.col("_class")) & (F.col("part") == F.col("_part")))
        .withColumn("_g", F.col("_before") + F.col("ordinal"))
        .withColumn("_bin", F.floor(F.col("_g") / per).cast("long"))
        .withColumn("sequence_id", F.when(F.col("_bin") < full, by_class(base) + F.col("_bin"))
                    .otherwise(by_class(tail_of)))
    )
    inside = Window.partitionBy("sequence_id").orderBy("class", "_g").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long"))).drop(
        "_class", "_part", "_before", "_g", "_bin", "class", "part", "ordinal")


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and the ids."""
    pieces = cut_documents(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return assign(written(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer or vocabulary_path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
