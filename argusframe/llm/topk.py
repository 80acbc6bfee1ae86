"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to a set of pivots are computed once. For a query and a candidate, the
largest difference of their pivot distances bounds their distance from below, and with the two
norms their inner product from above. Candidates are evaluated in the order of that bound until
the k-th best score exceeds every bound left, so the answer is exact.

Queries meet candidates block by block. Blocks have bounded sizes, and each pair of blocks is one
group of work; partial answers of a query are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PIVOTS = 32
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Candidates evaluated before the first look at the bound; twice as many before each next one.
BATCH = 256
#: Above this, sums of products could leave the exact range of doubles.
EXACT = 2.0**53


def scaled(column: Column) -> Column:
    """floor(64 * x) of every component; null where the vector takes no part."""
    x = F.transform(column, lambda v: v.cast("double"))
    bad = F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * 64).cast("long")))


def _matrix(column: pa.Array | pd.Series, width: int = 0) -> np.ndarray:
    """Rows of equal width; missing last components are zero."""
    rows = [np.asarray(v, np.float64) for v in column]
    width = max([width, *(len(v) for v in rows)])
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    p = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T
    return np.sqrt(np.maximum(square, 0))


def _table(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1).to_pylist())
        d = _distances(x, pivots)
        flat = pa.array(d.reshape(-1))
        at = pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, flat)],
            ["vec_id", "v", "pivot"],
        )


def _pivots(vectors: DataFrame) -> np.ndarray:
    """PIVOTS vectors: from a bounded sample least in hash, each the farthest from those before."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * PIVOTS).collect()
    x = _matrix([r["v"] for r in rows])
    if not len(x):
        return np.zeros((1, 1))
    chosen, gap = [0], np.full(len(x), np.inf)
    for _ in range(min(PIVOTS, len(x)) - 1):
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(gap.argmax()))
    return x[chosen]


def search_block(
    query_id: np.ndarray, q: np.ndarray, q_pivot: np.ndarray,
    vec_id: np.ndarray, c: np.ndarray, c_pivot: np.ndarray, k: int,
) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Per query the ids and scores of its k best candidates; and how many were evaluated."""
    largest = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1)
    kind = np.float32 if largest < 2**24 else np.float64 if largest < EXACT else np.int64
    order = np.argsort(vec_id, kind="stable")
    vec_id, c = vec_id[order], c[order]
    columns = c_pivot[order].T.astype(np.float32)
    q_pivot = q_pivot.astype(np.float32)
    q_norm, c_norm = (q.astype(float) ** 2).sum(1), (c.astype(float) ** 2).sum(1)
    # rounding of the distances may not hide a candidate
    slack = 1 + 1e-6 * (c_norm + columns.max(0).astype(float) ** 2)
    q, c = q.astype(kind), c.astype(kind)
    ids, scores, evaluated = [], [], 0
    lower, gap = np.empty(len(c), np.float32), np.empty(len(c), np.float32)
    for i in range(len(q)):
        lower.fill(0)
        for p, column in enumerate(columns):
            np.abs(np.subtract(column, q_pivot[i, p], out=gap), out=gap)
            np.maximum(lower, gap, out=lower)
        own = 1e-6 * (q_norm[i] + float(q_pivot[i].max()) ** 2)
        bound = (q_norm[i] + c_norm - lower.astype(float) ** 2) / 2 + slack + own
        bound[vec_id == query_id[i]] = -np.inf
        best_id, best = np.zeros(0, np.int64), np.zeros(0, c.dtype)
        left, batch = np.flatnonzero(bound > -np.inf), BATCH
        while len(left):
            if len(left) > batch:
                cut = np.argpartition(-bound[left], batch)
                now, left = left[cut[:batch]], left[cut[batch:]]
            else:
                now, left = left, left[:0]
            evaluated += len(now)
            score = c[now] @ q[i]
            if len(best) == k:
                good = score >= best[-1]
                now, score = now[good], score[good]
            best_id, best = np.concatenate((best_id, vec_id[now])), np.concatenate((best, score))
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
            if len(best) == k:
                left = left[bound[left] >= best[-1]]
            batch *= 2
        ids.append(best_id)
        scores.append(best)
    return ids, scores, evaluated


_PARTIAL = "query_id long, vec_id long, score long"


def _search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if not len(candidates) or not len(queries):
        return empty
    q, c = _matrix(queries["v"]), _matrix(candidates["v"])
    width = max(q.shape[1], c.shape[1])
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    c = np.pad(c, ((0, 0), (0, width - c.shape[1])))
    own = queries["vec_id"].to_numpy()
    ids, scores, _ = search_block(
        own, q, np.stack(queries["pivot"]),
        candidates["vec_id"].to_numpy(), c, np.stack(candidates["pivot"]), k,
    )
    return pd.DataFrame(
        {
            "query_id": np.repeat(own, [len(x) for x in ids]),
            "vec_id": np.concatenate(ids).astype("int64"),
            "score": np.concatenate(scores).astype("int64"),
        }
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k highest inner products of every query: (query_id, rank, vec_id, score).

    `vectors` has vec_id and v, an array of integers as `scaled` makes it. Null vec_id or v: takes
    no part. Vectors of different lengths: missing components count as zero. A vec_id that occurs
    in several rows stands for its least vector. Ties: smaller vec_id. Fewer candidates than k: all.
    Empty table or no query: no rows.
    """
    own = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    own = own.groupBy("vec_id").agg(F.min("v").alias("v"))
    total, asked = own.select(F.count("*"), F.count_if(is_query)).first()
    table = own.select("vec_id", "v").mapInArrow(
        partial(_table, pivots=_pivots(own)), "vec_id long, v array<long>, pivot array<double>"
    )
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    candidate_blocks = max(1, -(-total // CANDIDATE_BLOCK))

    def block(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = table.select("*", block(candidate_blocks, 1).alias("cb"), every(query_blocks).alias("qb"))
    queries = table.where(is_query).select(
        "*", block(query_blocks, 2).alias("qb"), every(candidate_blocks).alias("cb")
    )
    found = (
        candidates.groupBy("cb", "qb")
        .cogroup(queries.groupBy("cb", "qb"))
        .applyInPandas(lambda c, q: _search(c, q, k), _PARTIAL)
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
