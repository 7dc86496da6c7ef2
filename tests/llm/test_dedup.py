from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import divergence, license_scan, line_chunks, ngram_join
from tests.llm.helpers import PASSAGE, edge_docs, edge_rows, empty_docs


def test_line_chunks_edges(spark):
    docs = edge_docs(spark)
    out = line_chunks.dedup(docs)
    rows = out.collect()
    assert len(rows) == len(edge_rows()) and set(docs.columns) <= set(out.columns)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["text"] is None and by_id[2]["text"] == ""
    assert by_id[8]["text"] == f"own start\n{PASSAGE}\nown end"  # the first place keeps its text
    assert by_id[9]["text"].startswith("other start") and by_id[9]["text"].endswith("other end")
    assert len(by_id[9]["text"]) < len(PASSAGE) / 2
    assert by_id[11]["text"] == ""
    assert line_chunks.dedup(empty_docs(spark)).count() == 0


def test_single_lines_stay(spark):
    docs = spark.createDataFrame([(i, f"line {i}\nall rights reserved\nend {i}") for i in range(20)], "doc_id long, text string")
    assert {r["text"] for r in line_chunks.dedup(docs).collect()} == {r["text"] for r in docs.collect()}


def without_repeats(texts: dict[int, str]) -> dict[int, str]:
    """Every two adjacent lines that stood before, in order of id and line, lose both lines."""
    seen, out = {}, {}
    for d in sorted(texts):
        ls, gone = texts[d].split("\n"), set()
        for i in range(len(ls) - 1):
            pair = (ls[i], ls[i + 1])
            if pair in seen and not (ls[i] == ls[i + 1] and seen[pair] == (d, i - 1)):
                gone |= {i, i + 1}
            seen.setdefault(pair, (d, i))
        out[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def test_short_passages_are_removed_wherever_they_stand(spark):
    """Passages of 2 to 6 lines in the middle of documents of own lines; chunk ends fall where they may."""
    rng = random.Random(11)
    texts: dict[int, str] = {}
    for size in range(2, 7):
        for j in range(12):
            passage = [f"passage {size} {j} line {k} {rng.random()}" for k in range(size)]
            for copy in range(2):
                before, after = ([f"own {size} {j} {copy} {side} {k}" for k in range(rng.randint(3, 9))] for side in "ab")
                texts[len(texts)] = "\n".join([*before, *passage, *after])
    texts[len(texts)] = "x\nx\nx\nx\nx"
    texts[len(texts)] = "one\n\nall rights reserved\n\ntwo"
    texts[len(texts)] = "three\n\nall rights reserved\n\nfour"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in line_chunks.dedup(docs).collect()}
    n = len(texts) - 3
    for d in range(0, n, 2):
        assert rows[d]["text"] == texts[d]
        assert "passage" not in rows[d + 1]["text"] and rows[d + 1]["n_removed"] == 2 + d // 24
    assert {d: r["text"] for d, r in rows.items() if d < n} == {d: t for d, t in without_repeats(texts).items() if d < n}
    assert rows[n]["text"] == "x\nx"
    assert all(rows[d]["text"] == texts[d] for d in (n + 1, n + 2))  # single lines between blank lines


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    texts = {i: "\n".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 9))) or "z" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup(docs).collect()}
    assert got == without_repeats(texts)
    assert {x for t in got.values() for x in t.split("\n") if x} == {x for t in texts.values() for x in t.split("\n")}


def brute(texts: dict[int, str], n: int, percent: int) -> dict[int, int]:
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


@pytest.mark.parametrize("blocks", [(2048, 512), (4, 4)])
def test_ngram_join_equals_brute_force(spark, blocks):
    """Chains, groups of near copies larger than a block, exact copies and unrelated texts of one passage."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts: dict[int, str] = {}
    base = [rng.choice(vocabulary) for _ in range(80)]
    for i in range(40):  # near copies
        words = list(base)
        words[rng.randrange(80)] = "changed"
        texts[len(texts)] = " ".join(words)
    for i in range(12):  # a chain: each links with the next only
        texts[len(texts)] = " ".join(f"c{j}" for j in range(6 * i, 6 * i + 60))
    for i in range(30):  # unrelated but for a passage
        texts[len(texts)] = " ".join([*base[:20], *[rng.choice(vocabulary) for _ in range(60)]])
    for i in range(10):
        texts[len(texts)] = texts[0].upper()
    texts[len(texts)], texts[len(texts)] = "a b", "A  b"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(docs, block=blocks[0], set_block=blocks[1]).collect()}
    assert got == brute(texts, 5, 75)


def test_frequent_ngrams_come_last(spark):
    docs = spark.createDataFrame([(i, f"own{i} a b c d e f") for i in range(40)], "doc_id long, text string").coalesce(1)
    frequent = ngram_join.frequent_ngrams(docs, 5, 0.5)
    assert set(frequent.tolist()) == set(ngram_join.ngram_set("a b c d e f").tolist())


def test_bounds_and_intersections():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert ngram_join.common(a, b) == len(set(a.tolist()) & set(b.tolist()))
        bits = ngram_join.Signatures([ngram_join.signature(a), ngram_join.signature(b)])
        differing = int(bits.differing(0, np.array([1]))[0])
        assert differing <= len(set(a.tolist()) ^ set(b.tolist()))
        assert differing == int(bits.differing(1, np.array([0]))[0])


def test_ngram_join_edges(spark):
    rows = ngram_join.link(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3)] == [0, 0, 0]
    assert by_id[1]["component_id"] == 1 and by_id[11]["component_id"] == by_id[10]["component_id"]
    nulls = [r for r in rows if r["doc_id"] is None]
    assert sorted((r["n_shingles"], r["component_id"]) for r in nulls if r["n_shingles"]) == [(2, 4)]
    assert ngram_join.link(empty_docs(spark)).count() == 0


def test_quality_edges(spark):
    rows = divergence.judge(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
    assert by_id[6]["n_repeat_words"] == 20_000
    assert by_id[8]["n_words"] == 12 * 8 + 4
    assert divergence.judge(empty_docs(spark)).count() == 0


def test_quality_keeps_prose_and_rejects_junk(spark):
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    joined = divergence.judge(prose).join(labels, "doc_id")
    counts = {(r["quality"], r["kept"]): r["count"] for r in joined.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0
    assert counts[(0, False)] > 4 * counts.get((0, True), 0)


def test_hot_junk_source_is_no_reference(spark):
    """A third of all rows from one source of symbol noise, in a common language, in a null and in a rare one."""
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    good = {r["doc_id"] for r in divergence.judge(prose).filter("kept").collect()}
    rng = random.Random(9)
    noise = [" ".join(rng.choice(["word### word$$$", "text### ab$$$", "some$$$ more###"]) + str(rng.randint(0, 10**6))
                      for _ in range(60)) for _ in range(500)]
    for lang, repeat in (("en", 1), (None, 1), ("zz", 1), ("en", 100)):
        rows = [(-1 - i, " ".join([t] * repeat) if i == 0 else t, lang, "junk") for i, t in enumerate(noise)]
        junk = spark.createDataFrame(rows, prose.schema)
        judged = divergence.judge(prose.union(junk)).select("doc_id", "kept", "base_failed").collect()
        passed = {r["doc_id"] for r in judged if r["kept"]}
        assert not any(d < 0 for d in passed)
        assert not all(r["base_failed"] for r in judged if r["doc_id"] < 0)
        assert len(good - passed) <= 0.01 * len(good)


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r["n_repeat_words"] for r in divergence.judge(docs).collect()}
    for d, t in texts.items():
        w = t.split()
        places: dict[tuple, list[int]] = {}
        for i in range(len(w) - 2):
            places.setdefault(tuple(w[i:i + 3]), []).append(i)
        assert got[d] == len({p + k for ps in places.values() if len(ps) > 1 for p in ps for k in range(3)})


def test_license_edges(spark):
    extra = spark.createDataFrame([
        (20, "CC by\nLicensed under CC BY-NC 4.0.\nGeneral  Public-License", "en", "", 1),
        (21, "xcc by ccx by cc byx École cc by", "fr", "", 1),
        (22, "this work was licensed under the gnu general public license version 3", "en", "", 1),
    ], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in license_scan.scan(extra).collect()}
    assert (rows[20]["n_base"], rows[20]["base_labels"], rows[20]["score"]) == (3, "cc-by,gpl", 1.0)
    assert "cc-by-nc-4.0" in rows[20]["labels"] and (rows[20]["first_word"], rows[20]["last_word"]) == (0, 9)
    assert (rows[21]["n_base"], rows[21]["first_word"]) == (1, 7)
    assert rows[22]["labels"] == "gpl,gpl-3.0" and 0.8 <= rows[22]["score"] < 1
    assert license_scan.scan(edge_docs(spark)).count() == len(edge_rows())
    assert license_scan.scan(empty_docs(spark)).count() == 0


def test_license_notices_give_exact_labels(spark):
    """Every notice its own labels and no other's, also when it is wrapped or stands among other lines."""
    notices = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
        "licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0", "Licensed under CC BY-NC-SA 4.0": "cc-by", "CC BY-ND 4.0": "cc-by",
        "Released under the MIT License.": "mit", "mit der License": "",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": "mpl-2.0",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:": "bsd",
        "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-2.0",
        "Licensed under the Apache\nLicense,\nVersion 2.0": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "the GNU Lesser General Public License, version 3": "gpl",
        "This work is licensed under a\nCreative Commons Attribution-ShareAlike 4.0\nInternational License.": "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\n"
        "associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
        "All rights\nreserved.": "reserved", "the license of the software is under review": "",
    }
    rows = []
    for k, text in enumerate(notices):
        rows += [(2 * k, text), (2 * k + 1, f"first line\n\n{text}\nlast line of the text")]
    # Two notices in adjacent lines keep their own labels.
    rows += [(900, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, labels) in enumerate(notices.items()):
        assert (got[2 * k], got[2 * k + 1]) == (labels, labels), text
    assert got[900] == "cc-by,cc-by-4.0,cc-by-nc-4.0"


def test_a_junk_source_of_a_third_does_not_become_the_norm(spark):
    """The registered rule: one source has one vote, however many rows it holds."""
    import random

    draw = random.Random(2)
    common = divergence.COMMON_WORDS["en"]

    def clean():
        return " ".join(draw.choice(common) if draw.random() < 0.4 else "".join(draw.choices("abcdefghilmnoprstu", k=6)) for _ in range(160))

    def junk():
        return " ".join("".join(draw.choices("abcdefgh", k=4)) + draw.choice(["###", "$$$", "%%%"]) for _ in range(160))

    rows = [(i, clean(), "en", f"s{i % 4}") for i in range(80)] + [(100 + i, junk(), "en", "hot") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in divergence.judge(docs).filter("kept").collect()}
    assert kept == set(range(80))
