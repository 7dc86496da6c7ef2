"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to many pivots are computed once. For a query and a candidate, the largest
difference of their distances to a pivot is a lower bound of their distance, hence an upper bound of
their inner product. Candidates are evaluated in the order of that bound until it falls below the
k-th best score found so far (or the k-th best score among the pivots themselves, which are rows of
the table). Equal bounds are evaluated, so ties are exact.

Queries and candidates meet in blocks of bounded size; a block returns its k best per query, and the
k best of all blocks are the result. The stated query set is compared with all rows: the work grows
with their product, less what the bounds save. The pivots are a bounded sample, the rows with the
smallest hash of their id.

Vectors with a scaled component beyond ``LARGEST`` are too large for these bounds; pairs in which one takes part
meet in blocks as well, and their products are computed in whole numbers of any size. Their ranks are exact; a score
that no long can hold is given as the nearest long.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an
id; rows that share an id are candidates and queries of their own, and each other's candidates; shorter vectors count
as padded with zeros; fewer than k candidates give fewer rows; an empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.common import table, written

LARGEST = 1 << 24
LONG = (1 << 63) - 1
# ``beyond`` is -1, 0 or 1: the score lies below, within or above a long; ``digits`` orders those beyond.
BEST_SCHEMA = "query long, query_id long, vec_id long, score long, beyond int, digits string"


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, vector array<double>, large) of the rows that take part: floor(scale * x), exact as a double.

    From 2 ** 45 on a double is a multiple of 1 / 256, so nothing is left to round down.
    """
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(value, lambda x: F.when(F.abs(x) < 2.0 ** 45, F.floor(scale * x).cast("double")).otherwise(x))
    far = F.exists(value, lambda x: F.abs(x) > LARGEST / scale)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), far.alias("large"),
        F.when(far, value).otherwise(whole).alias("vector"))


def exact(vector, scale: int = 256) -> list[int]:
    """floor(scale * x) of unscaled components as whole numbers of any size."""
    return [math.floor(scale * x) if abs(x) < 2.0 ** 45 else scale * int(x) for x in vector]


def placed(score: int) -> tuple[int, int, str]:
    """(score, beyond, digits): what orders whole numbers of any size, the score as the nearest long."""
    if -LONG <= score <= LONG:
        return score, 0, ""
    digits = f"{abs(score):0700d}"  # products of doubles have fewer
    if score > 0:
        return LONG, 1, digits
    return -LONG, -1, digits.translate(str.maketrans("0123456789", "9876543210"))


def packed(vectors: list, width: int) -> np.ndarray:
    """Vectors of whole components as rows of equal width."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to the pivots."""
    a, b = x.astype(float), pivots.astype(float)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of each query with its own selection of candidates, exact."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if largest < 2 ** 53:
        return np.matmul(c.astype(float)[at], q.astype(float)[:, :, None])[:, :, 0].astype(np.int64)
    return (c[at] * q[:, None, :]).sum(axis=2)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to smaller ids."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, query_table: np.ndarray, floor: np.ndarray,
    ids: np.ndarray, vectors: np.ndarray, pivot_table: np.ndarray, k: int, step: int = 128,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, pairs evaluated); rows hold up to k results, missing ones have score NONE."""
    none = np.iinfo(np.int64).min // 2
    best = np.full((len(queries), k), none)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    bound = np.zeros((len(queries), len(ids)), dtype=np.float32)
    gap = np.empty_like(bound)
    q_table, c_table = query_table.astype(np.float32), pivot_table.astype(np.float32)
    for p in range(q_table.shape[1]):
        np.subtract(q_table[:, p, None], c_table[None, :, p], out=gap)
        np.abs(gap, out=gap)
        np.maximum(bound, gap, out=bound)
    largest = float(max(q_table.max(initial=0), c_table.max(initial=0)))
    bound -= np.float32(1e-6 * largest + 1e-3)  # what 32-bit rounding may have added
    np.maximum(bound, 0, out=bound)
    square_q, square_c = (queries.astype(float) ** 2).sum(axis=1), (vectors.astype(float) ** 2).sum(axis=1)
    upper = (square_q[:, None] + square_c[None, :]) / 2 - bound.astype(float) ** 2 / 2
    upper += 1e-12 * (square_q[:, None] + square_c[None, :]) + 0.5
    upper[query_ids[:, None] == ids[None, :]] = -np.inf  # the query's own row
    order = np.argsort(-upper, axis=1, kind="stable")
    evaluated = 0
    for start in range(0, len(ids), step):
        at = order[:, start:start + step]
        limit = np.maximum(best[:, -1], floor)
        active = np.flatnonzero(np.take_along_axis(upper, at[:, :1], 1)[:, 0] >= limit)
        if not len(active):
            break
        at = at[active]
        scores = products(queries[active], vectors, at)
        scores[np.isneginf(np.take_along_axis(upper[active], at, 1))] = none
        evaluated += scores.size
        best[active], best_ids[active] = best_of(
            np.concatenate([best[active], scores], axis=1), np.concatenate([best_ids[active], ids[at]], axis=1), k)
    return best, best_ids, evaluated


def search(
    vectors: DataFrame, is_query, k: int = 5, pivots: int = 48, query_block: int = 4096, row_block: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every row for which ``is_query`` holds."""
    everything = written(scaled(vectors), "scaled")
    rows = everything.filter("NOT large")
    n, n_queries, n_large, width = everything.agg(
        F.count(F.when(~F.col("large"), 1)), F.count(F.when(is_query, 1)), F.count(F.when(F.col("large"), 1)),
        F.max(F.when(~F.col("large"), F.size("vector")))).first()
    width = max(width or 0, 1)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).collect()  # bounded
    pivot_keys = np.array([r["row"] for r in chosen], dtype=np.int64)
    pivot_rows = packed([r["vector"] for r in chosen], width)

    def measure(frames):
        for frame in frames:
            x = packed(frame["vector"].tolist(), width)
            yield pd.DataFrame({
                "row": frame["row"], "vec_id": frame["vec_id"], "vector": [v.tobytes() for v in x.astype("<i4")],
                "distances": [d.tobytes() for d in distances(x, pivot_rows)]})

    measured = written(rows.mapInPandas(measure, "row long, vec_id long, vector binary, distances binary"), "pivot-table")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        def part(f: pd.DataFrame):
            return (f["row"].to_numpy(), f["vec_id"].to_numpy(), np.frombuffer(b"".join(f["vector"]), dtype="<i4").reshape(len(f), width).astype(np.int64),
                    np.frombuffer(b"".join(f["distances"])).reshape(len(f), len(pivot_keys)))

        asks = frame["asks"].to_numpy()
        q_rows, q_ids, q, q_table = part(frame[asks])
        own, ids, c, table_ = part(frame[~asks])
        order = np.lexsort((own, ids))  # places stand for rows: ties go to smaller ids
        own, ids, c, table_ = own[order], ids[order], c[order], table_[order]
        out = []
        for start in range(0, len(q_ids), 256) if len(ids) else ():
            some = slice(start, start + 256)
            # A query's k-th best score among the pivots, its own row left out, is a floor.
            near = q[some] @ pivot_rows.T
            near[q_rows[some, None] == pivot_keys[None, :]] = np.iinfo(np.int64).min // 2
            floor = np.sort(near, axis=1)[:, -k] if near.shape[1] >= k else np.full(len(near), np.iinfo(np.int64).min // 2)
            # A query's own place, if it is here.
            at = np.full(len(q_rows[some]), -1)
            known = {r: i for i, r in enumerate(own.tolist())}
            for i, r in enumerate(q_rows[some].tolist()):
                at[i] = known.get(r, -1)
            scores, found, _ = search_block(at, q[some], q_table[some], floor, np.arange(len(ids)), c, table_, k)
            real = scores > np.iinfo(np.int64).min // 2
            count = real.sum(axis=1)
            out.append(pd.DataFrame({
                "query": np.repeat(q_rows[some], count), "query_id": np.repeat(q_ids[some], count), "vec_id": ids[found[real]],
                "score": scores[real], "beyond": 0, "digits": ""}))
        return pd.concat(out) if out else _none()

    found = _blocks(measured, measured.filter(is_query), n, n_queries, row_block, query_block).groupBy("q", "r").applyInPandas(meet, BEST_SCHEMA)
    if n_large:
        found = found.unionByName(_with_large(everything, is_query, n + n_large, n_queries, k))
    best = Window.partitionBy("query").orderBy(F.col("beyond").desc(), F.col("digits").desc(), F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _none() -> pd.DataFrame:
    return pd.DataFrame({c: [] for c in ("query", "query_id", "vec_id", "score", "beyond", "digits")}).astype({"digits": object})


def _blocks(rows: DataFrame, queries: DataFrame, n: int, n_queries: int, row_block: int, query_block: int) -> DataFrame:
    """Every row once per block of queries and every query once per block of rows: they meet by (q, r)."""
    row_blocks, query_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(n_queries / query_block))
    own = F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int")
    asking = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int")
    all_rows = rows.select("*", F.lit(False).alias("asks"), own.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    return all_rows.unionByName(queries.select(
        "*", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("r"), asking.alias("q")))


def _with_large(everything: DataFrame, is_query, n: int, n_queries: int, k: int) -> DataFrame:
    """The best of each query among pairs in which it or the candidate is large, in smaller blocks."""
    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        whole = [exact(v) if large else [int(x) for x in v] for v, large in zip(frame["vector"], frame["large"])]
        columns = (frame["asks"].tolist(), frame["row"].tolist(), frame["vec_id"].tolist(), frame["large"].tolist(), whole)
        members = list(zip(*columns))
        out = []
        for _, row, query_id, large, q in (m for m in members if m[0]):
            scores = [(-sum(a * b for a, b in zip(q, c)), vec_id) for asks, own, vec_id, far, c in members
                      if not asks and own != row and (large or far)]
            out += [(row, query_id, vec_id, *placed(-score)) for score, vec_id in sorted(scores)[:k]]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score", "beyond", "digits"]) if out else _none()

    # A block without a large row has no pair to offer, but blocks are dealt by row alone.
    return _blocks(everything, everything.filter(is_query), n, n_queries, 512, 512).groupBy("q", "r").applyInPandas(meet, BEST_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# Every query with every row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
