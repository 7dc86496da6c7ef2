from __future__ import annotations

import itertools

import numpy as np
import pytest

from tallyline.operators import lloyd


def table(spark, groups: dict[str, np.ndarray], partitions: int = 4):
    rows = [(f"{s}-{i}", s, [float(x) for x in v]) for s, points in groups.items() for i, v in enumerate(points)]
    return spark.createDataFrame(rows, "id string, s string, v array<double>").repartition(partitions)


@pytest.fixture(scope="module")
def groups():
    draw = np.random.default_rng(7)
    blobs = np.concatenate([draw.normal(c, 0.4, size=(25, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0), (5, 5, 5))])
    return {"blobs": blobs, "noise": draw.normal(size=(40, 3)), "pair": np.array([[0.0, 0, 0], [9.0, 9, 9], [9.0, 9, 9.5]])}


@pytest.fixture(scope="module")
def fitted(spark, groups):
    points = lloyd.prepared(table(spark, groups), "v", "id", "s")
    runs = lloyd.fit(points, {"blobs": range(2, 7), "noise": [3], "pair": [2]}, restarts=4)
    return points, lloyd.settled(points, runs)


def test_runs_of_all_segments_reach_a_fixed_point(spark, groups, fitted):
    points, runs = fitted
    assert {(r.segment, r.k, r.restart) for r in runs} == {
        *itertools.product(["blobs"], range(2, 7), range(4)), *itertools.product(["noise"], [3], range(4)),
        *itertools.product(["pair"], [2], range(4))}
    for run in runs:
        own = groups[run.segment]
        distances = np.square(own[:, None] - run.centres[None]).sum(axis=2)
        nearest = distances.argmin(axis=1)
        assert run.settled and run.sizes.sum() == len(own)
        assert run.cost == pytest.approx(distances.min(axis=1).sum())
        for i in set(nearest):
            assert run.centres[i] == pytest.approx(own[nearest == i].mean(axis=0))


def test_silhouettes_equal_the_definition_and_find_the_blobs(spark, groups, fitted):
    points, runs = fitted
    best = lloyd.best_restarts(runs)
    scores = lloyd.silhouettes(points, list(best.values()))
    assert set(scores) == set(best)
    for (segment, k), run in best.items():
        own = groups[segment]
        squared = np.square(own[:, None] - own[None]).sum(axis=2)
        label = np.square(own[:, None] - run.centres[None]).sum(axis=2).argmin(axis=1)
        values = []
        for i in range(len(own)):
            mine = (label == label[i]) & (np.arange(len(own)) != i)
            others = [squared[i, label == c].mean() for c in set(label) - {label[i]}]
            a, b = squared[i, mine].mean() if mine.any() else 0.0, min(others)
            values.append((b - a) / max(a, b) if mine.any() else 0.0)
        assert scores[segment, k] == pytest.approx(np.mean(values))
    assert max((v, k) for (s, k), v in scores.items() if s == "blobs")[1] == 4


def test_search_ends_at_the_best_score(spark, groups):
    points = lloyd.prepared(table(spark, {"": groups["blobs"]}), "v", "id", "s")
    run, scores = lloyd.search(points, 6, restarts=3)
    assert run.k == 4 and run.settled and scores[4] == max(scores.values()) and set(scores) == {2, 3, 4, 5, 6}
    labelled = lloyd.labels(points, "id", {"": run})
    assert lloyd.fixed_point(points, labelled, "id").filter("not nearest").count() == 0
    assert lloyd.search(points, 1, restarts=2)[0].k == 2


def test_every_restart_runs_until_it_stands_still(spark):
    own = np.random.default_rng(11).normal(size=(600, 2))
    points = lloyd.prepared(table(spark, {"": own}), "v", "id", "s")
    first = lloyd.starts(points, {"": range(2, 8)}, 4, 42)
    rounds, expected = [], {}
    for k, restart in itertools.product(range(2, 8), range(4)):
        centres, moved = first["", restart][:k], None
        for n in itertools.count():
            nearest = np.square(own[:, None] - centres[None]).sum(axis=2).argmin(axis=1)
            moved = np.array([own[nearest == i].mean(axis=0) for i in range(k)])
            if np.allclose(moved, centres, rtol=1e-10, atol=1e-12):
                break
            centres = moved
        rounds.append(n)
        expected[k, restart] = np.square(own[:, None] - centres[None]).sum(axis=2).min(axis=1).sum()
    assert max(rounds) > 20
    runs = lloyd.fit(points, {"": range(2, 8)}, restarts=4)
    assert all(run.settled for run in runs)
    assert {(r.k, r.restart): r.cost for r in runs} == pytest.approx(expected)
    best = lloyd.best_restarts(runs)
    run, scores = lloyd.search(points, 7, restarts=4)
    assert scores == pytest.approx({k: v for (_, k), v in lloyd.silhouettes(points, list(best.values())).items()})
    assert run.k == max(scores, key=scores.get) and run.cost == pytest.approx(min(expected[run.k, r] for r in range(4)))


def test_rounds_end_with_the_last_move_only(monkeypatch):
    done = []

    def advance(points, runs):
        done.append(len(runs))
        runs[-1].settled = len(done) >= 1_000

    monkeypatch.setattr(lloyd, "advance", advance)
    runs = [lloyd.Run("", 2, r, np.zeros((2, 1))) for r in range(2)]
    assert [r.settled for r in lloyd.settled(None, runs)] == [True, True] and done == [2] * 1_000 + [1]


def test_a_round_that_does_not_lower_the_cost_is_the_last(spark):
    points = lloyd.prepared(table(spark, {"": np.array([[0.0], [1.0], [5.0]])}), "v", "id", "s")
    for last, settled in ((17.0, False), (16.0, True)):
        run = lloyd.Run("", 2, 0, np.array([[0.0], [1.0]]), cost=last)
        lloyd.advance(points, [run])
        assert run.cost == 16.0 and run.centres.tolist() == [[0.0], [3.0]] and run.settled is settled


def test_labels_are_the_same_for_any_partitioning(spark, groups):
    found = []
    for partitions in (1, 5):
        points = lloyd.prepared(table(spark, groups, partitions), "v", "id", "s")
        labelled = lloyd.labels(points, "id", lloyd.best_fits(points, {"blobs": 4, "noise": 3}, restarts=3))
        found.append(sorted(map(tuple, labelled.collect())))
        check = lloyd.fixed_point(points, labelled, "id")
        assert check.count() == 140 and check.filter("nearest").count() == 140
    assert found[0] == found[1]


def test_fixed_point_check_sees_wrong_labels(spark, groups):
    points = lloyd.prepared(table(spark, {"blobs": groups["blobs"]}), "v", "id", "s")
    wrong = points.selectExpr("segment", "id", "cast(pmod(_h, 2) as int) as cluster")
    assert lloyd.fixed_point(points, wrong, "id").filter("not nearest").count() > 0


def test_fewer_distinct_points_than_clusters(spark):
    points = lloyd.prepared(table(spark, {"same": np.ones((6, 2)), "two": np.array([[0.0, 0], [1, 1], [1, 1]])}), "v", "id", "s")
    runs = lloyd.fit(points, {"same": [2, 3], "two": [3]}, restarts=2)
    assert {r.segment: len(r.centres) for r in runs} == {"same": 1, "two": 2}
    assert ("same", 2) not in lloyd.silhouettes(points, runs)
    empty = lloyd.prepared(table(spark, {"x": np.zeros((1, 2))}).limit(0), "v", "id", "s")
    assert lloyd.fit(empty, {"x": [2]}) == []


def test_blocks_hold_all_points_dealt_evenly(spark):
    draw = np.random.default_rng(3)
    own = {"a": draw.normal(size=(4_500, 3)), "b": draw.normal(size=(5, 3))}
    points = lloyd.prepared(table(spark, own, 1), "v", "id", "s")
    blocks = lloyd.packed(points)
    found = {s: [] for s in own}
    for segment, vectors, hashes in lloyd._parts([blocks.toPandas()]):
        assert len(vectors) == len(hashes) <= 2 * lloyd.BLOCK
        found[segment] += map(tuple, vectors)
    assert {s: sorted(v) for s, v in found.items()} == {s: sorted(map(tuple, v)) for s, v in own.items()}
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    one, other = (lloyd.fit(p, {"a": [3], "b": [2]}, restarts=2) for p in (points, blocks))
    for x, y in zip(one, other):
        assert x.sizes.tolist() == y.sizes.tolist() and x.centres == pytest.approx(y.centres)
