"""Connected components of a link table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from argusframe.sources.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """(b, a) pairs with the least neighbour of every node."""
    return edges.groupBy("node").agg(F.min("near").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node that has a link (a, b).

    Links of a node to itself and links with a null are ignored. Every round only aggregates and
    joins; the table of links never grows. A node with very many links is aggregated before
    the shuffle, and its rows are split by adaptive execution in the join.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct())
    before = _fingerprint(edges)
    while True:
        # large star: neighbours above a node move to its least neighbour
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        large = (
            both.join(_least(both), "node")
            .where("near > node")
            .select(F.col("near").alias("a"), F.least("node", "least").alias("b"))
            .distinct()
        )
        # small star: a node and its lesser neighbours move to the least of them
        down = large.select(F.col("a").alias("node"), F.col("b").alias("near"))
        small = down.join(_least(down), "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("near").alias("a"), F.col("least").alias("b")),
                    F.struct(F.col("node").alias("a"), F.col("least").alias("b")),
                )
            ).alias("e")
        )
        edges = materialize(small.select("e.a", "e.b").where("a <> b").distinct())
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
