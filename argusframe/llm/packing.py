"""Best-fit packing under conflicts.

Documents fill bins of a fixed number of words. A bin never holds two documents of one source or
of one duplicate cluster. Bins are kept in the order of their free space and carry bitmaps of
the sources and clusters inside; the search starts at the tightest bin that has room and moves on
to its successors until one is compatible. A text longer than a bin fills whole bins by itself,
and its rest is packed like any other document.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from argusframe.llm.words import U64, mix, pieces

CAPACITY = 2048
#: Documents packed together; every shard is packed by itself.
SHARD = 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for p in pieces(batch.column(names.index("text"))):
            part = batch.slice(p.row0, p.rows)
            n = p.word_counts()
            # order-sensitive value of the words, equal for texts that differ in blanks and case
            k = np.arange(len(p.hash), dtype=U64) - np.repeat((np.cumsum(n) - n).astype(U64), n)
            value = mix(p.hash + mix(k + U64(1)))
            total = np.concatenate(([0], np.cumsum(value, dtype=U64))).astype(U64)
            end = np.cumsum(n)
            cluster = mix(total[end] - total[end - n] + n.astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(names.index("doc_id")), part.column(names.index("source")),
                    pa.array(n), pa.array(cluster, mask=n == 0),
                ],
                ["doc_id", "source", "n_words", "cluster"],
            )


def document_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, cluster); texts of the same words are one cluster, empty ones none."""
    return documents.select("doc_id", "source", "text").mapInArrow(
        _sizes, "doc_id long, source string, n_words long, cluster long"
    )


class Bins:
    """Open bins ordered by free space, then by number."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def open(self) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        self.used.append(0)
        return len(self.used) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a document; source and cluster are bitmaps of one bit, or 0."""
        at = bisect_left(self.order, (size, -1))
        order, sources, clusters = self.order, self.sources, self.clusters
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & source or clusters[b] & cluster):
                order.pop(at)
                break
            at += 1
        else:
            b = self.open()
        offset = self.used[b]
        self.used[b] = offset + size
        sources[b] |= source
        clusters[b] |= cluster
        if self.used[b] < self.capacity:
            insort(order, (self.capacity - self.used[b], b))
        return b, offset


def pack_rows(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Pack one shard: longest first, then by doc_id. Returns a row for every piece of a bin."""
    rows = rows.sort_values(
        ["rest", "doc_id", "source", "cluster"], ascending=[False, True, True, True], na_position="last"
    )
    bins = Bins(capacity)
    source_bit: dict = {}
    cluster_bit: dict = {}
    many = rows["cluster"].value_counts()
    many = set(many[many > 1].index)
    out = []
    for doc, source, cluster, n, rest in rows[
        ["doc_id", "source", "cluster", "n_words", "rest"]
    ].itertuples(index=False, name=None):
        s = 0 if source is None or source != source else 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster in many else 0
        full = (n - rest) // capacity
        for k in range(full):
            b = bins.open()
            bins.used[b], bins.sources[b], bins.clusters[b] = capacity, s, c
            out.append((doc, source, b, 0, k * capacity, capacity))
        if rest or not n:
            b, offset = bins.place(rest, s, c)
            out.append((doc, source, b, offset, n - rest, rest))
    return pd.DataFrame(out, columns=["doc_id", "source", "bin", "bin_offset", "start_word", "n_words"])


_PLACED = "doc_id long, source string, shard long, bin long, bin_offset long, start_word long, n_words long"


def _pack(frames: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """Rows come ordered by shard; a shard longer than SHARD rows is packed in several parts."""
    held: list[pd.DataFrame] = []
    count, part, shard = 0, 0, None

    def flush() -> pd.DataFrame:
        placed = pack_rows(pd.concat(held, ignore_index=True), capacity)
        # parts of one shard never share a bin number
        placed["shard"] = shard * (1 << 20) + part
        return placed

    for frame in frames:
        for value, rows in frame.groupby("shard", sort=False):
            if held and value != shard:
                yield flush()
                held, count, part = [], 0, 0
            shard = int(value)
            while len(rows):
                take = rows.iloc[: 2 * SHARD - count]
                held.append(take)
                count += len(take)
                rows = rows.iloc[len(take) :]
                if count >= 2 * SHARD:
                    yield flush()
                    held, count, part = [], 0, part + 1
    if held:
        yield flush()


def best_fit(sizes: DataFrame, documents: int, capacity: int = CAPACITY) -> DataFrame:
    """Places of all documents: (doc_id, source, shard, bin, bin_offset, start_word, n_words).

    `sizes` has doc_id, source, n_words and cluster. (shard, bin) names a bin. A document gets one
    row per bin it is in, so every word is placed exactly once; a document without words gets one
    row of no words. Null source or cluster: no conflict. Ties: the least doc_id first, the tightest
    bin, then the oldest. Repeated rows: each is placed; as one source and one cluster they never
    share a bin. Empty table: no rows. Shards are dealt by hash, about SHARD documents each, so a
    hot source or cluster is spread over all of them.
    """
    rest = F.col("n_words") % capacity
    shards = max(1, -(-documents // SHARD))
    rows = sizes.select(
        "doc_id", "source", "n_words", "cluster",
        F.when((F.col("n_words") > 0) & (rest == 0), 0).otherwise(rest).alias("rest"),
        F.pmod(F.xxhash64("doc_id", "source", "n_words", "cluster"), F.lit(shards)).alias("shard"),
    )
    return (
        rows.repartition("shard")
        .sortWithinPartitions("shard", F.col("rest").desc(), "doc_id")
        .mapInPandas(partial(_pack, capacity=capacity), _PLACED)
    )


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Best-fit places of whole texts, measured in words; null texts count as empty."""
    return best_fit(document_sizes(documents), documents.count(), capacity)
