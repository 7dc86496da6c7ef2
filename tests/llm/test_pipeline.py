from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import common, divergence, line_chunks, pii_crf
from tallyline.llm.common import vocabulary_path
from tests.llm.helpers import edge_docs, empty_docs
from tests.llm.test_dedup import brute


def test_stages_on_edges(spark):
    for make in (edge_docs, empty_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = make(spark)
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, make(spark), "").count() >= 0


def test_run_equals_plain_steps(spark):
    """The pieces of run() against the operators' own results and a brute-force near-duplicate step."""
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r["doc_id"] for r in divergence.judge(docs).filter("kept").collect()]
    one = line_chunks.dedup(docs.filter(F.col("doc_id").isin(kept)))
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    groups = brute(texts, 5, 75)
    field = pii_crf.trained()
    left = {d: t for d, t in texts.items() if groups[d] == d}
    masked = {d: pii_crf.masked(t, pii_crf.all_spans([t], field)[0]) for d, t in left.items()}
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    expected = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in masked.items()}
    got: dict[int, list] = {}
    for r in sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], dtype="<u4").tolist())
    assert got == expected
    assert 0 < len(got) < len(kept) < docs.count()


def test_near_duplicates_decide_per_row(spark):
    """Repeated and null ids: a clean text keeps its row, copies under one id or without an id go."""
    long = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcde"]
    rows = [
        (1, long[0]), (2, f"{long[0]} more"), (2, long[1]),  # id 2 is a near copy and a clean text
        (3, long[2]), (3, long[2]), (3, long[2].upper()),  # copies under one id
        (None, long[3]), (None, long[3]), (None, long[0]), (None, f"{long[4]} more"), (4, long[4]),
        (5, ""), (5, ""), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    found = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in got), key=str)
    assert found == sorted([(1, long[0]), (2, long[1]), (3, long[2]), (None, long[3]), (4, long[4]),
                            (5, ""), (5, ""), (None, "")], key=str)


def test_results_read_late_or_chained_without_a_write(spark):
    """Stages remove no table that an unfinished result still reads."""
    docs = edge_docs(spark)
    stages = dict(corpus_pipeline.STAGES)
    first, second = stages["packing"](spark, docs, ""), stages["packing"](spark, docs, "")
    lazily = docs
    for name in ("quality", "lines", "near_duplicates", "personal_data"):
        lazily = stages[name](spark, lazily, "")
    later = stages["lines"](spark, docs, "").filter("doc_id IS NOT NULL")  # the stage's own result is given up here
    stages["quality"](spark, docs, "")
    assert second.count() == first.count() > 0
    assert lazily.count() <= docs.count() and later.count() == docs.filter("doc_id IS NOT NULL").count()


def test_tables_go_with_their_last_reader(spark):
    import pathlib

    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    common.sweep(spark, collect=True)
    before = {p.name for p in root.glob("tallyline-*")}
    result = common.written(spark.range(10).toDF("x"), "kept-while-read")
    derived = result.filter("x > 3").select("x")
    del result
    common.sweep(spark, collect=True)
    made = {p.name for p in root.glob("tallyline-*")} - before
    assert len(made) == 1 and derived.count() == 6
    del derived
    for _ in range(50):  # the driver hears of a dropped name a little later
        common.sweep(spark, collect=True)
        if not any((root / name).exists() for name in made):
            break
        time.sleep(0.2)
    assert not any((root / name).exists() for name in made)
