"""K-means of many kinds at once: every segment, number of clusters and restart in the same rounds.

A run is a (segment, k, restart). The centres of all runs, a few numbers that do not grow with the data,
travel to the points; each partition assigns its points to the centres of every run and sends back one
sum per centre; one aggregate adds the sums up. So a round is one job whatever the number of runs. Every run goes
on until it stands still, and only then are restarts compared by their cost and numbers of clusters by their silhouette. Starts are
drawn with probabilities in proportion to the squared distance from the centres drawn before, all restarts in one aggregate per draw;
runs of one restart with different k share their first centres. Silhouettes of all k come from the sums of the last round.

Points are rows (segment, key, vector); a draw depends on the key and the seed only. A search reads them in many
rounds, so it first packs them: blocks of points with their vectors as one binary value, dealt evenly to the cores,
which a round reads as numpy arrays without a conversion per point.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.lineage import cut

RESTARTS = 10
# Points of one block.
BLOCK = 2_000


@dataclass
class Run:
    """One k-means: centres, and after each round the sizes, sums and squares of their members and the cost."""

    segment: str
    k: int
    restart: int
    centres: np.ndarray
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))
    squares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cost: float = float("inf")
    settled: bool = False


def prepared(df: DataFrame, vector: str, key: str, segment: str | None = None) -> DataFrame:
    """(segment, key, vector, _h) written once, since every round reads it."""
    own = F.col(segment).cast("string") if segment else F.lit("")
    return cut(df.select(own.alias("segment"), key, F.col(vector).alias("vector"), F.xxhash64(key).alias("_h")))


def packed(points: DataFrame) -> DataFrame:
    """(segment, width, vectors, hashes): the points in blocks, written once and dealt evenly."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(segment: str) -> pd.DataFrame:
            parts = held.pop(segment)
            vectors, hashes = (np.concatenate(x) for x in zip(*parts))
            return pd.DataFrame([(segment, vectors.shape[1], vectors.tobytes(), hashes.tobytes())],
                                columns=["segment", "width", "vectors", "hashes"])

        for segment, vectors, hashes in _parts(frames):
            held.setdefault(segment, []).append((vectors, hashes))
            if sum(len(v) for v, _ in held[segment]) >= BLOCK:
                yield block(segment)
        for segment in list(held):
            yield block(segment)

    blocks = points.select("segment", "vector", "_h").mapInPandas(pack, "segment string, width int, vectors binary, hashes binary")
    return cut(blocks.repartition(points.sparkSession.sparkContext.defaultParallelism))


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from the hashes and the salt."""
    x = hashes.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _squared(points: np.ndarray, centres: np.ndarray, rows: int = 256) -> np.ndarray:
    """Squared distances, points x centres, from differences: equal points are at distance 0 exactly.

    A few rows at a time, so that what is added up stays in the processor's cache.
    """
    out = np.zeros((len(points), len(centres)))
    for start in range(0, len(points), rows):
        part, total = points[start:start + rows], out[start:start + rows]
        for d in range(points.shape[1]):
            off = part[:, d, None] - centres[None, :, d]
            total += np.multiply(off, off, out=off)
    return out


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(segment, vectors, hashes) of each batch, from points or from blocks of them."""
    for frame in frames:
        if "width" in frame:
            for row in frame.itertuples(index=False):
                yield row.segment, np.frombuffer(row.vectors).reshape(-1, row.width), np.frombuffer(row.hashes, dtype=np.int64)
            continue
        for segment, piece, vectors in _pieces(frame):
            yield segment, vectors, piece["_h"].to_numpy()


def _pieces(frame: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, np.ndarray]]:
    """(segment, rows, vectors) of a batch of points."""
    for segment, part in frame.groupby("segment", sort=False):
        for start in range(0, len(part), BLOCK):
            piece = part.iloc[start:start + BLOCK]
            yield segment, piece, np.stack(piece["vector"].to_list()).astype(float)


def starts(points: DataFrame, ks: Mapping[str, Sequence[int]], restarts: int, seed: int) -> dict[tuple[str, int], np.ndarray]:
    """Starting centres of each (segment, restart), as many as the largest k needs and the points allow."""
    drawn: dict[tuple[str, int], list[np.ndarray]] = {(s, r): [] for s in ks for r in range(restarts)}
    most = {s: max(k) for s, k in ks.items()}
    for step in range(max(most.values(), default=0)):
        now = {k: np.array(c) for k, c in drawn.items() if len(c) == step < most[k[0]]}
        if not now:
            break

        def race(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The point with the least draw of each partition: exponential times at the rate of the squared distance."""
            best: dict[tuple[str, int], tuple[float, list]] = {}
            for segment, vectors, hashes in _parts(frames):
                for restart in range(restarts):
                    if (segment, restart) not in now:
                        continue
                    rate = _squared(vectors, now[segment, restart]).min(axis=1) if step else np.ones(len(vectors))
                    times = -np.log(_uniform(hashes, (seed * 1_000 + restart) * 1_000 + step))
                    times = np.where(rate > 0, times / np.maximum(rate, 1e-300), np.inf)
                    i = int(times.argmin())
                    if np.isfinite(times[i]) and times[i] < best.get((segment, restart), (np.inf,))[0]:
                        best[segment, restart] = (float(times[i]), vectors[i].tolist())
            yield pd.DataFrame([(s, r, t, v) for (s, r), (t, v) in best.items()], columns=["segment", "restart", "time", "vector"])

        won = points.mapInPandas(race, "segment string, restart int, time double, vector array<double>")
        for row in won.groupBy("segment", "restart").agg(F.min_by("vector", F.struct("time", "vector")).alias("vector")).collect():
            drawn[row["segment"], row["restart"]].append(np.array(row["vector"]))
    return {k: np.array(c) for k, c in drawn.items() if c}


def _assigned(vectors: np.ndarray, runs: Sequence[Run], centres: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first centre, nearest centre, its squared distance) of each run, for centres laid end to end."""
    distances, at = _squared(vectors, centres), 0
    for run in runs:
        own = distances[:, at:at + len(run.centres)]
        nearest = own.argmin(axis=1)
        yield at, nearest, own[np.arange(len(own)), nearest]
        at += len(run.centres)


def _by_segment(runs: Sequence[Run]) -> dict[str, tuple[list[Run], np.ndarray]]:
    grouped: dict[str, list[Run]] = {}
    for run in runs:
        grouped.setdefault(run.segment, []).append(run)
    return {s: (own, np.concatenate([r.centres for r in own])) for s, own in grouped.items()}


def advance(points: DataFrame, runs: Sequence[Run]) -> None:
    """One round: every run's centres become the means of the points nearest to them."""
    placed = _by_segment(runs)
    width = runs[0].centres.shape[1]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for segment, vectors, _ in _parts(frames):
            if segment not in placed:
                continue
            own, centres = placed[segment]
            total = totals.setdefault(segment, np.zeros((len(centres), width + 3)))
            rows = np.concatenate([np.ones((len(vectors), 1)), np.square(vectors).sum(axis=1, keepdims=True), vectors], axis=1)
            for at, nearest, distance in _assigned(vectors, own, centres):
                members = np.zeros((int(nearest.max()) + 1, len(vectors)))
                members[nearest, np.arange(len(vectors))] = 1.0
                total[at:at + len(members), :-1] += members @ rows
                total[at:at + len(members), -1] += members @ distance
        yield pd.DataFrame([(s, i, row.tolist()) for s, t in totals.items() for i, row in enumerate(t) if row[0]],
                           columns=["segment", "centre", "sums"])

    parts = points.mapInPandas(sums, "segment string, centre int, sums array<double>")
    added = parts.groupBy("segment", "centre").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width + 3)]).alias("sums"))
    found = {(r["segment"], r["centre"]): np.array(r["sums"]) for r in added.collect()}
    for segment, (own, centres) in placed.items():
        total = np.array([found.get((segment, i), np.zeros(width + 3)) for i in range(len(centres))])
        at = 0
        for run in own:
            part = total[at:at + len(run.centres)]
            at += len(run.centres)
            run.sizes, run.squares, run.sums = part[:, 0], part[:, 1], part[:, 2:-1]
            last, run.cost = run.cost, float(part[:, -1].sum())
            # A centre without members stays where it is.
            moved = np.where(run.sizes[:, None] > 0, run.sums / np.maximum(run.sizes, 1)[:, None], run.centres)
            # Moved centres lower the cost. Where they do not, a tie or the rounding of the sums has moved them, maybe for ever.
            run.settled = np.allclose(moved, run.centres, rtol=1e-10, atol=1e-12) or not run.cost < last
            run.centres = moved


def fit(points: DataFrame, ks: Mapping[str, Sequence[int]], restarts: int = RESTARTS, seed: int = 42) -> list[Run]:
    """All runs, advanced together until every one stands still."""
    first = starts(points, ks, restarts, seed)
    runs = [Run(s, k, r, first[s, r][:k].copy()) for s, own in ks.items() for r in range(restarts) if (s, r) in first
            for k in own]
    return settled(points, runs)


def settled(points: DataFrame, runs: Sequence[Run]) -> list[Run]:
    """The runs, advanced until their centres stand still; a round is for those that still move."""
    moving = [r for r in runs if not r.settled]
    while moving:
        advance(points, moving)
        moving = [r for r in moving if not r.settled]
    return list(runs)


def best_fits(points: DataFrame, ks: Mapping[str, int], restarts: int = RESTARTS, seed: int = 42) -> dict[str, Run]:
    """The best run of each segment for a given number of clusters."""
    runs = fit(packed(points), {s: [k] for s, k in ks.items()}, restarts, seed)
    return {s: run for (s, _), run in best_restarts(runs).items()}


def best_restarts(runs: Sequence[Run]) -> dict[tuple[str, int], Run]:
    """The run with the least cost of each (segment, k); the first of equal ones."""
    best: dict[tuple[str, int], Run] = {}
    for run in runs:
        have = best.get((run.segment, run.k))
        if have is None or run.cost < have.cost:
            best[run.segment, run.k] = run
    return best


def silhouettes(points: DataFrame, runs: Sequence[Run]) -> dict[tuple[str, int], float]:
    """Mean silhouette (squared Euclidean) of each run with two clusters or more, all in one job.

    The mean squared distance of a point to a cluster follows from the cluster's size, sum and squares.
    """
    runs = [r for r in runs if (r.sizes > 0).sum() > 1]
    if not runs:
        return {}
    placed = _by_segment(runs)

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[str, int], list[float]] = {}
        for segment, vectors, _ in _parts(frames):
            own, centres = placed.get(segment, ((), None))
            if not own:
                continue
            for run, (_, nearest, _) in zip(own, _assigned(vectors, own, centres)):
                n = np.maximum(run.sizes, 1)
                mean = np.square(vectors).sum(axis=1)[:, None] + (run.squares / n)[None] - 2 * vectors @ (run.sums / n[:, None]).T
                row = np.arange(len(vectors))
                mine = mean[row, nearest] * run.sizes[nearest] / np.maximum(run.sizes[nearest] - 1, 1)
                mean[:, run.sizes == 0] = np.inf
                mean[row, nearest] = np.inf
                other, top = mean.min(axis=1), np.maximum(mine, mean.min(axis=1))
                value = np.where((run.sizes[nearest] > 1) & (top > 0), (other - mine) / np.where(top > 0, top, 1), 0.0)
                sums = totals.setdefault((segment, run.k), [0.0, 0])
                sums[0] += float(value.sum())
                sums[1] += len(vectors)
        yield pd.DataFrame([(s, k, *t) for (s, k), t in totals.items()], columns=["segment", "k", "score", "n"])

    added = points.mapInPandas(scores, "segment string, k int, score double, n long").groupBy("segment", "k").agg(
        (F.sum("score") / F.sum("n")).alias("score"))
    return {(r["segment"], r["k"]): r["score"] for r in added.collect()}


def labels(points: DataFrame, key: str, chosen: Mapping[str, Run], name: str = "cluster") -> DataFrame:
    """(segment, key, cluster): the nearest centre of the segment's chosen run; other segments are left out."""
    centres = {s: run.centres for s, run in chosen.items()}

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for segment, piece, vectors in _pieces(frame):
                if segment not in centres:
                    continue
                yield pd.DataFrame({"segment": segment, key: piece[key].array,
                                    name: _squared(vectors, centres[segment]).argmin(axis=1).astype("int32")})

    kind = points.schema[key].dataType.simpleString()
    return points.mapInPandas(assign, f"segment string, {key} {kind}, {name} int")


def search(
    points: DataFrame, last_k: int, default: int = 2, restarts: int = RESTARTS, seed: int = 42,
) -> tuple[Run, dict[int, float]]:
    """The run with the best silhouette over k from 2 to ``last_k``, and all scores, for points of one segment.

    Of equal scores the smaller k wins.
    """
    points = packed(points)
    best = {k: r for (_, k), r in best_restarts(fit(points, {"": range(2, max(last_k, default) + 1)}, restarts, seed)).items()}
    scores = {k: v for (_, k), v in silhouettes(points, [r for k, r in best.items() if k <= last_k]).items()}
    return best[max(sorted(scores), key=scores.__getitem__, default=default)], scores


def fixed_point(points: DataFrame, labelled: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(segment, key, cluster, nearest): does every label name the nearest of the means of the labelled points?

    Recomputed with DataFrame functions from the labels alone, so it proves both halves of a fixed point:
    centres are means of their members, and members are nearest to their own mean. The means of a
    segment, one short array per cluster, are one row beside each of its points.
    """
    rows = points.join(labelled, ["segment", key])
    means = (
        rows.select("segment", "cluster", F.posexplode("vector").alias("_d", "_x"))
        .groupBy("segment", "cluster", "_d").agg(F.avg("_x").alias("_m"))
        .groupBy("segment", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda p: p["_m"]).alias("_mean"))
        .groupBy("segment").agg(F.collect_list(F.struct("cluster", "_mean")).alias("_means")))

    def squared(mean):
        return F.aggregate(F.zip_with("vector", mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    distances = F.transform("_means", lambda m: F.struct(m["cluster"].alias("cluster"), squared(m["_mean"]).alias("d")))
    own = F.filter("_distances", lambda m: m["cluster"] == F.col("cluster"))
    return rows.join(means, "segment").withColumn("_distances", distances).select(
        "segment", key, "cluster",
        (F.get(own, F.lit(0))["d"] <= F.array_min(F.transform("_distances", lambda m: m["d"])) + tolerance).alias("nearest"))
