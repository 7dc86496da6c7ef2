from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import fill_middle as M
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) from the definition."""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in M.MARKERS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def batch(rows):
    digests = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for i, _ in rows]
    draws = {f"_h{k}": pa.array([int(d[8 * k:8 * k + 8], 16) for d in digests], pa.int64()) for k in range(4)}
    return pa.RecordBatch.from_pydict({"_text": pa.array([t for _, t in rows], pa.string()), **draws})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab <PSM>\n\t\x0b\x00é \U0001f600"), max_size=30), min_size=1, max_size=12))
def test_batches_equal_the_definition(texts):
    rows = list(enumerate(texts))
    made = M.transform_batch(batch(rows), M.WORD_UNITS, 50, 80, M.MARKERS)
    got = list(zip(*[made[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")]))
    assert got == [plain(i, t) for i, t in rows]
    assert M.restore_batch(made["output"].cast(pa.binary()), made["form"]).cast(pa.string()).to_pylist() == texts


def test_edges(spark):
    made = M.fill_in_middle(edge_docs(spark), keep=["source", "n_words"])
    rows = made.collect()
    assert made.columns == ["doc_id", "source", "n_words", "n", "form", "prefix_chars", "middle_chars", "output"]
    expected = [(d, s, *plain(d, t or "")) for d, t, _, s, _ in edge_rows()]
    assert sorted(((r[0], r[1], *r[3:]) for r in rows), key=repr) == sorted(expected, key=repr)
    back = M.restored(made).collect()
    assert sorted((r["restored"] for r in back)) == sorted(t or "" for _, t, *_ in edge_rows())
    assert M.restored(M.fill_in_middle(empty_docs(spark))).count() == 0


def test_other_parameters(spark):
    docs = spark.createDataFrame([(i, f"one two three {i}") for i in range(200)], "doc_id long, text string")
    forms = {r["form"] for r in M.fill_in_middle(docs, rate=100, suffix_first=0, markers=("[p]", "[s]", "[m]")).collect()}
    assert forms == {"psm"}
    made = M.fill_in_middle(docs, rate=100, pattern=rb"(?s).", markers=("[p]", "[s]", "[m]"))
    assert {r["restored"] for r in M.restored(made, markers=("[p]", "[s]", "[m]")).collect()} == {r["text"] for r in docs.collect()}
    assert made.filter("n != length(concat('one two three ', doc_id))").count() == 0


def test_long_texts_go_alone():
    rows = [(i, "word " * 1000) for i in range(10)]
    parts = list(M.slices(batch(rows), "_text", 12_000))
    assert [len(p) for p in parts] == [2] * 5
    assert [len(p) for p in M.slices(batch([(0, "x" * 50_000), (1, "")]), "_text", 100)] == [1, 1]
