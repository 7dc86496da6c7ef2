from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import pivot_search, url_models


def test_search_block_equals_brute_force():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (6, 16))
    rows = np.concatenate([centres[i % 6] + rng.integers(-20, 20, (1, 16)) for i in range(600)])
    rows[100:120] = rows[7]  # ties
    ids = rng.permutation(600).astype(np.int64)
    pivots = rows[:12]
    table = pivot_search.distances(rows, pivots)
    asks = np.arange(0, 600, 9)
    floor = np.full(len(asks), np.iinfo(np.int64).min // 2)
    scores, found, evaluated = pivot_search.search_block(
        ids[asks], rows[asks], table[asks], floor, ids, rows, table, 5, step=16)
    for i, a in enumerate(asks):
        exact = sorted(((-int(rows[a] @ rows[j]), int(ids[j])) for j in range(600) if ids[j] != ids[a]))[:5]
        assert list(zip((-scores[i]).tolist(), found[i].tolist())) == exact
    assert evaluated < 0.6 * len(asks) * 600  # bounds do stop the search on clustered vectors


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1),
            (5, [None, 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0], 1), (7, [], 1), (50, [-0.001, 2.0], 1), (8, [1e30, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in pivot_search.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    # 256 * (1, .5), (-1, 512), shorter vectors padded with zeros; both rows of id 1 count, and the very large vector 8
    assert got == [(0, 1, 8, pivot_search.LONG), (0, 2, 1, 81920), (0, 3, 1, 81920), (0, 4, 6, 65536), (0, 5, 50, 65280),
                   (50, 1, 0, 65280), (50, 2, 1, 65280), (50, 3, 1, 65280), (50, 4, 7, 0), (50, 5, 6, -256)]
    assert pivot_search.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_vectors_and_repeated_ids(spark):
    """Whole numbers of any size, and every row its own candidate, against brute force."""
    import random

    draw = random.Random(8)
    sizes = [0.5, 3.0, 70_000.0, 1e9, 3e15, 1e40, 1e300]
    rows = [(i % 37, [draw.choice([-1, 1]) * draw.random() * draw.choice(sizes) for _ in range(draw.randint(1, 6))]) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    expected = []
    for a, (i, q) in enumerate(whole):
        if i % 10 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(whole) if b != a)[:5]
            expected += [(i, rank, j, max(-pivot_search.LONG, min(pivot_search.LONG, -s))) for rank, (s, j) in enumerate(found, 1)]
    got = [tuple(r) for r in pivot_search.search(table, F.col("vec_id") % 10 == 0, pivots=9, query_block=7, row_block=20).collect()]
    assert sorted(got) == sorted(expected)


def test_blocks_do_not_change_the_result(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = pivot_search.search(table, F.col("vec_id") % 20 == 0).collect()
    many = pivot_search.search(table, F.col("vec_id") % 20 == 0, pivots=7, query_block=5, row_block=60).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET", "x://a.org/fr/x?y#z", "x://org/fr/", "x://forg/fr/",
            "x://sub.example.net/en/1", "x://sub.example.net/de/1", "x://a?b/fr/", "x://h/p#f?q", "a://b://c/d", "x://É.ORG/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit(3)).withColumn("verdict", F.lit(4))
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_models.judge(pages).collect()}
    assert rows == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("www.example.net", "", None),
        4: ("a.org", "/fr/x", "org/fr/"), 5: ("org", "/fr/", "org/fr/"), 6: ("forg", "/fr/", None),
        7: ("sub.example.net", "/en/1", "example.net/en/"), 8: ("sub.example.net", "/de/1", "net/"),
        9: ("a", "", None), 10: ("h", "/p", None), 11: ("b:", "//c/d", None), 12: ("É.org", "/fr/", "org/fr/"),
    }
    assert {r["verdict"] for r in url_models.judge(pages).filter("rule IS NULL").collect()} == {"allow"}
    assert url_models.judge(pages.limit(0)).count() == 0


def test_markov_probabilities_sum_to_one():
    model = url_models.MarkovModel(["http://a.org/fr/1", "http://b.org/fr/22"], 4)
    context = b"http://a.or"
    total = 0.0
    for byte in range(256):
        data = np.frombuffer(context + bytes([byte]), dtype=np.uint8)
        total += np.exp(model.log_likelihood(data, np.arange(len(data)))[-1])
    assert abs(total - 1) < 1e-9


def test_ratio_separates_held_out_urls():
    good = [f"http://site{i}.org/fr/{i * 37 % 9973}" for i in range(400)]
    bad = [f"https://shop{i}.net/de/{i * 91 % 9973}?page=2" for i in range(400)]
    accepted, rejected, slope, intercept = url_models.train([(u, True) for u in good[:300]] + [(u, False) for u in bad[:300]])
    score = url_models.ratios(accepted, rejected, good[300:] + bad[300:]) * slope + intercept
    assert (score[:100] > 0).mean() > 0.98 and (score[100:] < 0).mean() > 0.98


def test_every_labelled_url_is_counted(spark):
    urls = [f"http://s{i}.{'org/fr' if i % 2 else 'net/de'}/{i * 37 % 9973}" for i in range(12_000)] + ["http://a.org/fr/" + "z" * 3_000]
    pages = spark.createDataFrame([(u, "/fr/" in u) for u in urls], "_url string, accepted boolean")
    held = {r["_url"] for r in pages.filter("pmod(xxhash64(_url), 5) = 0").collect()}
    for limit in (1 << 18, 2_000):
        models = url_models.fit(pages, limit=limit)
        for model, accepted in zip(models[:2], (True, False)):
            size = sum(len(u) for u in urls if ("/fr/" in u) == accepted and u not in held)
            assert [level[1].sum() for level in model.levels] == [size] * 6
            assert max(len(level[0]) for level in model.levels) <= limit
        fresh = [f"http://t{i}.org/fr/{i}" for i in range(100)] + [f"http://t{i}.net/de/{i}" for i in range(100)]
        score = url_models.ratios(*models[:2], fresh) * models[2] + models[3]
        assert (score[:100] > 0).mean() > 0.95 and (score[100:] < 0).mean() > 0.95


def test_counts_by_spark_equal_the_model_of_the_texts(spark):
    urls = [f"http://s{i}.org/fr/{i * 37 % 9973}" for i in range(300)]
    plain = url_models.MarkovModel(urls, 5)
    rows = url_models.counted(spark.createDataFrame([(u, True) for u in urls], "_url string, accepted boolean"), 5).collect()
    for k, (keys, counts, *_) in enumerate(plain.levels):
        assert {(r["key"], r["n"]) for r in rows if r["level"] == k} == set(zip(keys.view(np.int64).tolist(), counts.astype(int).tolist()))


def test_scores_are_of_models_of_all_labelled_urls(spark):
    for n in (300, 7, 2):  # 7 and 2: few examples, which the hash may deal all alike
        good = [f"http://s{i}.org/fr/{i * 37 % 9973}" for i in range(n)]
        bad = [f"http://s{i}.net/de/{i * 91 % 9973}?page=2" for i in range(n)]
        fresh = [f"http://t{i}.edu/{p}/{i}" for i in range(30) for p in ("fr", "de")] + ["", None, "é" * 50]
        pages = spark.createDataFrame(list(enumerate(good + bad + fresh + good[:5])), "page_id int, url string")
        got = {r["page_id"]: r for r in url_models.judge(pages).collect()}
        assert len(got) == len(good + bad + fresh + good[:5])
        models = [url_models.MarkovModel(urls, 5) for urls in (good, bad)]
        expected = url_models.ratios(*models, [u or "" for u in fresh])
        own = [got[2 * n + i] for i in range(len(fresh))]
        assert np.allclose([r["score"] for r in own], expected, rtol=0, atol=1e-12)
        assert all((r["probability"] >= 0.5) == (r["verdict"] == "allow") for r in own)
        if n > 2:
            assert {r["verdict"] for r in own[0:60:2]} == {"allow"} and {r["verdict"] for r in own[1:60:2]} == {"block"}


def test_a_side_of_one_url_or_none_is_scored_and_allowed(spark):
    good = [f"http://s{i}.org/fr/{i}" for i in range(30)]
    for bad in ([], ["http://a.net/de/1"]):
        pages = spark.createDataFrame(list(enumerate([*good, *bad, "http://t.edu/fr/1", "http://b.edu/de/1"])), "page_id int, url string")
        own = url_models.judge(pages).filter("rule IS NULL").orderBy("page_id").collect()
        expected = url_models.ratios(*[url_models.MarkovModel(urls, 5) for urls in (good, bad)], ["http://t.edu/fr/1", "http://b.edu/de/1"])
        assert np.allclose([r["score"] for r in own], expected, rtol=0, atol=1e-12)
        assert [(r["verdict"], r["probability"]) for r in own] == [("allow", 1.0)] * 2


def test_both_sides_of_the_split_have_examples(spark):
    urls = [f"u{i}" for i in range(60)]
    rows = spark.createDataFrame([(u, True) for u in urls], "_url string, accepted boolean")
    held = {r["_url"] for r in rows.filter("pmod(xxhash64(_url), 5) = 0").collect()}
    alike = [sorted(held)[:2], [u for u in urls if u not in held][:3]]
    for good, bad in (alike, alike[::-1]):
        both = spark.createDataFrame([(u, u in good) for u in good + bad], "_url string, accepted boolean")
        table, curved = url_models.dealt(both)
        assert curved and {(r["accepted"], r["_held"]) for r in table.collect()} == {(a, h) for a in (True, False) for h in (True, False)}
