"""Exact centroid clustering with heap-ordered bounds.

Vectors are kept in blocks. In every block each cluster has a heap of its vectors, ordered by the
gap between the distance to the second nearest and to the own centroid, plus the drift the cluster
had accumulated when the gap was measured. When centroids move, only a sum per cluster grows; a
vector's assignment can change only once that sum has reached its key, so a round pops just those
and measures them again exactly. Sums of vectors per cluster follow the moves, so a round ships
only what moved.

Vector blocks are shuffled and written once; later rounds shuffle the heaps, not the vectors.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from argusframe.sources.session import materialize

#: Centroids, components, rounds of assignment and update, and vectors of a block.
CLUSTERS, WIDTH, ROUNDS, BLOCK = 16, 64, 3, 2048
#: Squared distances of larger components would not fit a long.
LARGEST = 2**27
#: Below this, sums of WIDTH products are exact in doubles.
EXACT = 2.0**22
#: Bounds are doubles: a vector is measured again a little before its key is reached.
SLACK = 1e-5


def quantized(column: Column, width: int = WIDTH) -> Column:
    """floor(64 * x) of every component; null unless there are `width`, none null or non-finite."""
    x = F.transform(column, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.transform(
        x,
        lambda v: F.when(F.abs(v) * 64 < LARGEST, F.floor(v * 64).cast("int")).otherwise(
            F.raise_error(F.lit("components this large have no squared distance in a long")).cast("int")
        ),
    )
    return F.when((F.size(column) == width) & ~bad, whole)


@dataclass
class Centroids:
    """Centroids of a round, and how far each had moved up to it."""

    at: np.ndarray
    #: Per cluster: own movement plus the largest movement of another one, summed over rounds.
    drift: np.ndarray
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), object))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, object))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Centroids:
        """The next round's, from what joined and left each cluster."""
        k = len(self.at)
        total = sums if not len(self.counts) else self.sums + sums
        n = counts if not len(self.counts) else self.counts + counts
        at = self.at.copy()
        for c in range(k):
            if n[c] > 0:
                at[c] = [int(s) // int(n[c]) for s in total[c]]
        step = np.sqrt(((at - self.at).astype(np.float64) ** 2).sum(1))
        other = np.array([max((step[j] for j in range(k) if j != c), default=0.0) for c in range(k)])
        return Centroids(at, self.drift + step + other, total, n)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        cross = (a @ b.T).astype(np.int64)
    else:
        cross = x.astype(np.int64) @ centroids.T
    wide = x.astype(np.int64)
    return (wide * wide).sum(1)[:, None] - 2 * cross + (centroids * centroids).sum(1)[None]


def rescan(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number), and its key in that cluster's heap."""
    d = squared(x, c.at)
    nearest = d.argmin(1)
    rows = np.arange(len(x))
    if d.shape[1] > 1:
        upper = np.sqrt(d[rows, nearest].astype(np.float64))
        d[rows, nearest] = np.iinfo(np.int64).max
        gap = np.sqrt(d.min(1).astype(np.float64)) - upper
    else:
        gap = np.full(len(x), np.inf)
    return nearest, gap + c.drift[nearest]


def sweep(x: np.ndarray, heaps: list[list[tuple[float, int]]], c: Centroids) -> list[tuple[int, int, int]]:
    """Pop and measure again the vectors whose gap is used up; returns (vector, from, to) of the moved."""
    popped, source = [], []
    for k, heap in enumerate(heaps):
        limit = c.drift[k] * (1 + SLACK) + SLACK
        while heap and heap[0][0] <= limit:
            popped.append(heapq.heappop(heap)[1])
            source.append(k)
    if not popped:
        return []
    target, key = rescan(x[popped], c)
    moves = []
    for i, a, b, v in zip(popped, source, target.tolist(), key.tolist(), strict=True):
        heapq.heappush(heaps[b], (v, i))
        if a != b:
            moves.append((i, a, b))
    return moves


_STATE = "block long, cluster int, key array<double>, member array<int>, n long, sums array<long>"


def _deltas(block: int, heaps: list, counts: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    """One row a cluster: its heap, and how its count and sums change."""
    rows = [
        (block, k, [v for v, _ in heap], [i for _, i in heap], int(counts[k]), sums[k].tolist())
        for k, heap in enumerate(heaps)
    ]
    return pd.DataFrame(rows, columns=["block", "cluster", "key", "member", "n", "sums"])


def _matrix(block: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(block["body"].iloc[0], np.int32).reshape(-1, block["width"].iloc[0])


def _first(block: pd.DataFrame, c: Centroids) -> pd.DataFrame:
    x, k = _matrix(block), len(c.at)
    nearest, key = rescan(x, c)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
    for i, (a, v) in enumerate(zip(nearest.tolist(), key.tolist(), strict=True)):
        heaps[a].append((v, i))
    for h in heaps:
        heapq.heapify(h)
    sums = np.stack([x[nearest == a].sum(0, dtype=np.int64) for a in range(k)])
    return _deltas(int(block["block"].iloc[0]), heaps, np.bincount(nearest, minlength=k), sums)


def _heaps(state: pd.DataFrame, k: int) -> list[list[tuple[float, int]]]:
    out: list[list[tuple[float, int]]] = [[] for _ in range(k)]
    for a, key, member in zip(state["cluster"], state["key"], state["member"], strict=True):
        out[a] = list(zip(key.tolist(), member.tolist(), strict=True))
    return out


def _again(blocks: pd.DataFrame, state: pd.DataFrame, c: Centroids) -> pd.DataFrame:
    x, k = _matrix(blocks), len(c.at)
    heaps = _heaps(state, k)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    for i, a, b in sweep(x, heaps, c):
        counts[a] -= 1
        counts[b] += 1
        sums[a] -= x[i]
        sums[b] += x[i]
    return _deltas(int(blocks["block"].iloc[0]), heaps, counts, sums)


def _last(blocks: pd.DataFrame, state: pd.DataFrame, c: Centroids) -> pd.DataFrame:
    x = _matrix(blocks)
    heaps = _heaps(state, len(c.at))
    sweep(x, heaps, c)
    cluster = np.zeros(len(x), np.int64)
    for a, heap in enumerate(heaps):
        cluster[[i for _, i in heap]] = a
    apart = x.astype(np.int64) - c.at[cluster]
    return pd.DataFrame(
        {"row": blocks["ids"].iloc[0], "cluster": cluster.astype(np.int32), "distance": (apart * apart).sum(1)}
    )


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) of a partition as blocks of at most BLOCK vectors."""
    ids: list = []
    parts: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        body = np.concatenate(parts).astype(np.int32).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([body])],
            ["width", "ids", "body"],
        )

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column(1).flatten().to_numpy().reshape(-1, width)
            own = part.column(0).to_pylist()
            while own:
                room = BLOCK - len(ids)
                ids += own[:room]
                parts.append(x[:room])
                own, x = own[room:], x[room:]
                if len(ids) == BLOCK:
                    yield block()
                    ids, parts = [], []
    if ids:
        yield block()


def _opened(c: Centroids) -> Callable:
    def one(block):
        return _first(block, c)

    return one


def _step(by_block: GroupedData, state: DataFrame, work: Callable, c: Centroids, schema: str) -> DataFrame:
    """Every block meets its heaps; only the heaps are shuffled."""

    def one(block, heaps):
        return work(block, heaps, c)

    return by_block.cogroup(state.groupBy("block")).applyInPandas(one, schema)


def _totals(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts per cluster over all blocks: k rows."""
    rows = state.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)),
    )
    sums, counts = np.zeros((k, width), object), np.zeros(k, object)
    for r in rows.collect():
        counts[r["cluster"]] = int(r["n"])
        sums[r["cluster"]] = [int(r[f"s{i}"]) for i in range(width)]
    return sums, counts


def seeds(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the least sha256 of `<salt>:<vec_id>`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "1", width: int = WIDTH
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of integer vectors.

    vectors: (vec_id, v), v of `width` integers below LARGEST (see `quantized`), null v takes no
    part. Centroids start as the vectors least in sha256 of `<salt>:<vec_id>`; `rounds` times
    every vector goes to the nearest one (squared Euclidean distance, ties to the smaller number)
    and every non-empty centroid becomes floor(sum / count) of its vectors; at the end vectors are
    assigned once more. Exact throughout.

    Repeated rows and rows that repeat a vec_id: each is a vector. Null vec_id: takes part, is
    chosen as a first centroid only after all others. Fewer vectors than centroids: as many
    centroids as vectors. Empty table: no rows. Other columns are not looked at.
    """
    kept = vectors.where(F.col("v").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    first = seeds(kept, clusters, salt)
    k = len(first)
    c = Centroids(first, np.zeros(k))
    blocks = kept.mapInArrow(partial(_pack, width=width), "width int, ids array<long>, body binary")
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()).repartition("block"))
    if not k:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return blocks.sparkSession.createDataFrame([], empty)
    by_block = blocks.groupBy("block")
    state = materialize(by_block.applyInPandas(_opened(c), _STATE))
    for r in range(rounds):
        if r:
            state = materialize(_step(by_block, state, _again, c, _STATE))
        c = c.moved(*_totals(state, k, width))
    out = materialize(_step(by_block, state, _last, c, "row long, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.at.tolist()]
    known = F.array(*(F.struct(F.lit(inertia.get(i, 0)).cast("long").alias("s"), F.lit(digest[i]).alias("d")) for i in range(k)))
    return out.select(
        F.col("row").alias("vec_id"), "cluster", "distance",
        known[F.col("cluster")]["s"].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        known[F.col("cluster")]["d"].alias("centroid_sha256"),
    )
