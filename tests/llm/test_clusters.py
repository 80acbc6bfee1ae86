"""Centroid clustering against a plain version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from argusframe.llm import centroids


def plain_clusters(rows, k, rounds):
    """Rows of (vec_id, components), every distance of every round measured."""
    order = sorted(
        range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), rows[i][1])
    )
    at = [list(rows[i][1]) for i in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in at]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in rows]
        for c in range(len(at)):
            members = [v for (_, v), a in zip(rows, own, strict=True) if a == c]
            if members:
                at[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [nearest(v) for _, v in rows]
    inertia = [sum(d for a, d in last if a == c) for c in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(
        (i, a, d, inertia[a], sum(inertia), digest[a]) for (i, _), (a, d) in zip(rows, last, strict=True)
    )


def found(table, **how):
    return sorted(tuple(r) for r in centroids.cluster(table, **how).collect())


@pytest.mark.parametrize("spread, scale", [(3, 1), (40, 1), (3, 2**22)])
def test_clusters_equal_plain_rounds(spark, monkeypatch, spread, scale):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rng = np.random.default_rng(spread)
    centre = rng.integers(-20, 21, (6, 5))
    x = (centre[rng.integers(0, 6, 300)] + rng.integers(-spread, spread + 1, (300, 5))) * scale // 2
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(400 + i, rows[i % 4][1]) for i in range(150)]  # copies, ties
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, rows[7][1])]  # repeated rows and ids
    table = spark.createDataFrame(rows, "vec_id long, v array<int>")
    for rounds in (1, 5):
        got = found(table, clusters=7, rounds=rounds, width=5)
        assert got == plain_clusters(rows, 7, rounds)


def test_few_vectors_are_measured_again():
    rng = np.random.default_rng(4)
    centre = rng.integers(-200, 200, (8, 6))
    x = (centre[rng.integers(0, 8, 2000)] + rng.integers(-12, 13, (2000, 6))).astype(np.int32)
    c = centroids.Centroids(centre + rng.integers(-9, 10, centre.shape), np.zeros(8))
    nearest, key = centroids.rescan(x, c)
    heaps = [[(v, i) for i, (a, v) in enumerate(zip(nearest, key, strict=True)) if a == k] for k in range(8)]
    heaps = [sorted(h) for h in heaps]
    sums = np.stack([x[nearest == k].sum(0) for k in range(8)]).astype(object)
    c = c.moved(sums, np.bincount(nearest, minlength=8).astype(object))
    expired = sum(v <= c.drift[k] for k, h in enumerate(heaps) for v, _ in h)
    centroids.sweep(x, heaps, c)
    assert expired < 0.2 * len(x)
    own = {i: k for k, h in enumerate(heaps) for _, i in h}
    assert [own[i] for i in range(len(x))] == centroids.squared(x, c.at).argmin(1).tolist()


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>, cluster int, block long, distance string, v string, n int"
    two = [0.5, -0.01]
    rows = [
        (0, two), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0]),
        (6, []), (7, [0.5, 1.0, 2.0]), (8, two), (8, two), (None, [9.0, 9.0]),
    ]
    raw = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], schema)
    table = raw.select("vec_id", centroids.quantized(F.col("embedding"), 2).alias("v"), "cluster", "block", "n")
    got = centroids.cluster(table, width=2).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["distance"]) for r in got) == [
        (False, 0, 0), (False, 8, 0), (False, 8, 0), (True, 0, 0)
    ]
    assert {r["centroid_sha256"] for r in got} == {
        hashlib.sha256(b"32,-1").hexdigest(), hashlib.sha256(b"576,576").hexdigest()
    }
    empty = centroids.cluster(table.where("false"), width=2)
    assert empty.collect() == []
    assert empty.columns == centroids.cluster(table, width=2).columns
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="squared distance"):
        centroids.cluster(huge.select("vec_id", centroids.quantized(F.col("embedding"), 2).alias("v")), width=2).collect()
