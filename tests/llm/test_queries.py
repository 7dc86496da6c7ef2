"""Registered queries beside their SQL, and the contracts that SQL cannot state beside brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyline.llm import queries
from tallyline.llm.common import vocabulary_path
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    assert difference(run(spark, name), connect(FOLDER), queries.ORACLES[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_op1_rules_and_verdicts(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = {r["page_id"]: r for r in run(spark, "op1_url_model_ratio").collect()}
    assert rows.keys() == urls.keys()
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    for page, url in urls.items():
        rest = url.split("://", 1)[1]
        host = rest[:min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        got = rows[page]
        assert (got["host"], got["path"], got["rule"]) == (host, path, rule)
        assert got["verdict"] in ("allow", "block")
        if rule:
            assert got["verdict"] == {h + p: v for (h, p), v in rules.items()}[rule]


def test_op2_pieces_cover_documents(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in run(spark, "op2_harmonic_packing").collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        raw = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(raw), len(ids[r["doc_id"]]))
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(ids[d])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at
    assert padding <= 0.01 * sum(map(len, ids.values())) + 16 * 2048


def test_op3_equals_the_library(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    rows = run(spark, "op3_piece_rounds").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op9_equals_brute_force(spark, texts):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op9_ngram_join").collect()}
    assert rows == {d: (len(sets[d]), find(d)) for d in docs}
    assert any(c != d for d, (_, c) in rows.items())


def test_op10_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = run(spark, "op10_token_counts").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)


def test_op5_base_spans(spark, texts):
    from tallyline.llm.pii_crf import KINDS
    from tests.llm.test_personal_data import plain_spans

    for r in run(spark, "op5_personal_data").collect():
        spans = plain_spans(texts[r["doc_id"]])
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(","))
