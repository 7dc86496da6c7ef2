from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import packing, piece_rounds, token_cache
from tallyline.llm.common import encoder, vocabulary_path
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = vocabulary_path(PIECES)
    return piece_rounds.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts(seed: int, n: int) -> list[str]:
    random.seed(seed)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "\n", "▁", "é", "ß", "中", "文", "😀", "0", "1", "=", "the", "ing", "\t", "\x00",
             "aaaa", "    ", "<s>", "<0x41>", "http://", "'s", "<|endoftext|>"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(n)]


def test_merge_rounds_equal_the_library(pieces):
    model, library = pieces
    texts = [*odd_texts(3, 3000), "", " ", "a" * 3000, " " * 999, "=" * 501, "中文" * 500, *[r[1] or "" for r in edge_rows()]]
    for text, ids, expected in zip(texts, model.encode(texts), library.encode(texts)):
        assert ids.tolist() == expected
        assert model.decode(expected) == library.decode(expected)


def test_a_merge_that_creates_a_better_pair():
    """Rounds fall back to one merge at a time where simultaneous merges would differ."""
    model = piece_rounds.PieceModel.__new__(piece_rounds.PieceModel)
    # a=0 b=1 ab=2 aba=3: (ab, a) ranks before (a, b).
    pairs = np.array([0 * 10 + 1, 2 * 10 + 0], dtype=np.int64)
    model.width, model.pairs = 10, piece_rounds.KeyTable(pairs)
    model.merged, model.rank = np.array([2, 3]), np.array([1, 0])
    symbols, segment = model._rounds(np.array([0, 1, 0, 1]), np.array([0]))
    assert symbols.tolist() == [3, 1] and segment.tolist() == [0, 0]


def test_decoding_of_any_ids(pieces):
    model, library = pieces
    random.seed(4)
    for _ in range(3000):
        ids = [random.randint(0, 31_999) if random.random() < 0.5 else random.randint(0, 260) for _ in range(random.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_rank_encoder_equals_the_library():
    own = encoder(vocabulary_path(BPE))
    assert own.fast is not None
    for text in [*odd_texts(5, 3000), *[r[1] or "" for r in edge_rows()]]:
        assert list(own.ids(text)) == own.library.encode(text, add_special_tokens=False).ids
        if "<|endoftext|>" not in text:
            assert own.fast.encode_ordinary(text) == own.library.encode(text, add_special_tokens=False).ids


def test_edges(spark):
    docs = edge_docs(spark)
    path = vocabulary_path(PIECES)
    encoded = piece_rounds.encode_decode(docs, path).collect()
    assert len(encoded) == len(edge_rows())
    assert sorted(r["decoded"] for r in encoded) == sorted((r[1] or "").replace("▁", " ") for r in edge_rows())
    packed = packing.pack(docs, vocabulary_path(BPE)).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == 1
    assert sum(r["length"] for r in packed if r["doc_id"] == 4) == 2 * 7
    for maker in (lambda d: piece_rounds.encode_decode(d, path), lambda d: packing.pack(d, vocabulary_path(BPE))):
        assert maker(empty_docs(spark)).count() == 0


def test_counts_use_and_fill_the_cache(spark, tmp_path):
    path, cache = vocabulary_path(BPE), str(tmp_path / "cache")
    docs = edge_docs(spark)
    first = token_cache.token_counts(docs, cache, path)
    assert first.count() == len(edge_rows())
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in edge_rows()}) == stored.select("digest").distinct().count()
    spark.createDataFrame([(token_cache.tokenizer_version(path), 99)], "tokenizer string, n_tokens long").withColumn(
        "digest", F.unhex(F.sha2(F.lit("fresh text"), 256))).select("tokenizer", "digest", "n_tokens").write.mode("append").parquet(cache)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(77, "fresh text")], "doc_id long, text string"))
    again = token_cache.token_counts(more, cache, path)
    assert again.filter("doc_id = 77").first()["n_tokens"] == 99  # taken from the cache, not counted
    assert spark.read.parquet(cache).count() == stored.count() + 1
    assert token_cache.token_counts(empty_docs(spark), str(tmp_path / "none"), path).count() == 0


def test_counts_of_a_sentencepiece_model(spark, tmp_path, pieces):
    counted = token_cache.token_counts(edge_docs(spark).limit(4), str(tmp_path / "c"), vocabulary_path(PIECES))
    assert {r["n_tokens"] for r in counted.filter("doc_id = 2").collect()} <= {0}


def test_classes_fill_their_sequences():
    for capacity in (2048, 1000, 7, 1):
        slots = packing.classes(capacity)
        assert all(k * slot <= capacity for k, slot in slots)
        for n in range(1, 3 * capacity + 2):
            pieces = packing.cut_lengths(n, capacity, slots, 3)
            assert sum(length for length, _ in pieces) == n
            assert all(0 < length <= slots[c][1] for length, c in pieces)


def test_long_runs_and_words_take_time_in_proportion(pieces):
    """Runs of one character and words of 200,000 letters, each in seconds, with the library's ids."""
    import time

    model, library = pieces
    draw = random.Random(1)
    texts = [c * n for c in " \t-=a" for n in (511, 513, 200_000)]
    texts += ["".join(draw.choices("etaoinshrdlu", k=200_000)), "ab" * 50_000 + " x" + " " * 3000 + "é" * 2000]
    for text in texts:
        start = time.perf_counter()
        ids = model.encode([text])[0]
        assert time.perf_counter() - start < 6, text[:5]
        assert ids.tolist() == library.encode(text), text[:5]
