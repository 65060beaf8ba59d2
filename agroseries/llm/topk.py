"""Exact top-k inner-product search by multi-resolution segment statistics.

Vectors and queries meet in the cells of a grid: a block of queries against a
block of vectors, of fixed sizes, so a task's memory does not grow with the
tables.  In a cell, a vector is described by the mean and the deviation of its
segments, first one segment, then more and shorter ones.  For segments of length
l, the squared distance of x and q is at least
``sum(l * (mean_x - mean_q)^2 + (dev_x - dev_q)^2)``; with the norms this bounds the
inner product from above.

Each query goes through the levels from coarse to fine by itself: the vectors of
the highest bounds are scored first, which lifts its threshold (the k-th best score
so far), and the vectors whose bound lies below it are left out of the next level.
Survivors are scored in steps, those of the highest bounds first, and after each step
the ones below the threshold are dropped.  The first column of the grid is searched first; its k-th best
scores are the thresholds that the other columns begin with.

Defined results: a vector that is null, empty, holds null or a non-finite
component takes no part, nor does a row without id; only vectors of equal length
are compared; a query does not meet rows with its own id; ties go to the smaller
id; repeated rows (equal id and vector) count once; fewer than k candidates give
fewer rows.  Scores are exact while sums of absolute products stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

VECTORS_IN_CELL = 16_384
QUERIES_IN_CELL = 2_048
STEP = 256


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows that take part, each (id, vector) once."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~bad)
            .select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).dropDuplicates(["id", "vector"]))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of ``x``: scaled means, deviations."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    means = np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)
    deviations = np.stack([np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for p in parts], axis=1)
    return np.concatenate([means, deviations], axis=1)


def nearest(x: np.ndarray, of_x: list[np.ndarray], q: np.ndarray, of_q: list[np.ndarray], own: np.ndarray, k: int, floor: float, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the best k of the rows of ``x`` for one query, by score and
    place, of those that reach ``floor``; and how many products were computed.  ``own``
    are the places that are no candidates; ``of_x`` and ``of_q`` the statistics by level."""
    at, score = np.zeros(0, np.int64), np.zeros(0)
    scored = np.zeros(len(x), bool)
    scored[own] = True
    made = 0

    def take(rows):
        nonlocal at, score, floor, made
        scored[rows] = True
        made += len(rows)
        new = x[rows] @ q
        good = new >= floor
        at, score = np.concatenate([at, rows[good]]), np.concatenate([score, new[good]])
        best = np.lexsort((at, -score))[:k]
        at, score = at[best], score[best]
        if len(score) == k:
            floor = max(floor, score[-1])

    rows = np.flatnonzero(~scored)
    bound = np.zeros(0)
    for mine, asked in zip(of_x, of_q):
        # gathering more than half of the rows costs more than their bounds
        bound = (mine @ asked + slack)[rows] if 2 * len(rows) > len(x) else mine[rows] @ asked + slack[rows]
        if len(rows) > k:
            take(rows[np.argpartition(-bound, k - 1)[:k]])
        stay = (bound >= floor) & ~scored[rows]
        rows, bound = rows[stay], bound[stay]
    step = STEP
    while len(rows) > step:
        by_bound = np.argpartition(-bound, step - 1)
        take(np.sort(rows[by_bound[:step]]))
        rest = by_bound[step:]
        rest = rest[bound[rest] >= floor]
        rows, bound, step = rows[rest], bound[rest], 2 * step
    take(rows)
    good = score >= floor
    return at[good], score[good], made


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int, levels: tuple[int, ...],
           floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, id, score) of each query's best k, and the number of products that
    were computed for them; ``ids`` ascend.  Scores below a query's floor may be left out."""
    of_x, of_q = [statistics(x, s) for s in levels], [statistics(q, s) for s in levels]
    norms, size = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    first, last = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
    found, products = [], 0
    for i in range(len(q)):
        at, score, made = nearest(x, of_x, q[i], [o[i] for o in of_q], np.arange(first[i], last[i]), k,
                                  -np.inf if floors is None else floors[i], 1e-9 * size[i] * norms + 1e-9)
        found.append((np.full(len(at), i), ids[at], score))
        products += made
    return *(np.concatenate(c) for c in zip(*found)), products


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5,
          levels: tuple[int, ...] = (1, 4, 16), scale: float | None = 256.0) -> DataFrame:
    """query_id, rank, id, score.  ``is_query`` is a condition on column ``id``;
    with ``scale`` a component x counts as floor(scale * x)."""
    own = B.written(usable(vectors, id_col, vector))
    n, m = own.select(F.count("*"), F.count(F.when(is_query, 1))).first()
    across, down = max(1, -(-n // VECTORS_IN_CELL)), max(1, -(-m // QUERIES_IN_CELL))
    size = F.size("vector").alias("size")
    block = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    x = own.select("id", "vector", size, block("id", across).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("line"))
    q = own.where(is_query).select(F.col("id").alias("id"), F.col("vector").alias("vector"), size, block("id", down).alias("line"))

    def cell(right: pa.Table, left: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty

        def matrix(t):
            flat = t.column("vector").combine_chunks()
            flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
            values = flat.flatten().to_numpy().reshape(len(t), -1)
            ids = t.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            return (np.floor(scale * values) if scale else values)[order], ids[order], order

        (xs, ids, _), (qs, query_ids, order) = matrix(right), matrix(left)
        r, found, score, _ = search(xs, ids, qs, query_ids, k, levels, left.column("floor").to_numpy()[order])
        return pa.table({"query_id": query_ids[r], "id": found, "score": score})

    def cells(first: int, last: int, queries: DataFrame) -> DataFrame:
        asked = queries.withColumn("column", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return (x.where(F.col("column").between(first, last)).groupBy("size", "column", "line").cogroup(asked.groupBy("size", "column", "line"))
                .applyInArrow(cell, "query_id bigint, id bigint, score double"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    lowest = F.lit(float("-inf"))
    found = cells(0, 0, q.withColumn("floor", lowest))
    if across > 1:
        found = B.written(ranked(found).drop("rank"))
        floors = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("floor"))
        rest = q.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", lowest))
        found = found.unionByName(cells(1, across - 1, rest))
    return ranked(found).select("query_id", "rank", "id", "score")
