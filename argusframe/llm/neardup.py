"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

HALVES short keys of ROWS minimum hashes each are computed per distinct shingle set; the table
keys are all pairs of them, so HALVES * ROWS hashes serve HALVES * (HALVES - 1) / 2 tables of
2 * ROWS hashes. Two sets meet in some table once two of their short keys agree.

Equal sets are one node from the start. In a table bucket of few sets all pairs are candidates;
in a larger one every set is a candidate pair with the bucket's least set, which links a group of
copies in linear time, and what is still apart afterwards is compared across the components, block
by block, by sketches first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from argusframe.llm.graph import components
from argusframe.llm.words import U64, mix, pieces, windows
from argusframe.sources.session import written

#: Two short keys agree with probability s ** ROWS. At similarity 0.8 fewer than two of the 14
#: agree with probability 0.0007, at 0.85 with 0.00004.
HALVES, ROWS = 14, 3
SMALL_BUCKET = 8
#: Sets of a large bucket are compared in full if so many of SKETCH four-bit minimum hashes agree;
#: at similarity 0.8 fewer do with probability 0.0002.
SKETCH, LIKELY = 64, 40
#: Documents of a block when the sets around a component are compared.
BLOCK = 256
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, max(SKETCH, HALVES * ROWS), dtype=U64) | U64(1)


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for p in pieces(batch.column(names.index("text"))):
            part = batch.slice(p.row0, p.rows)
            n_words = p.word_counts()
            value, at = windows(p.hash, p.row, k)
            row = p.row[at]
            few = np.flatnonzero((n_words > 0) & (n_words < k))
            first = np.cumsum(n_words) - n_words
            if len(few):  # fewer words than a shingle: the whole sequence is one
                alone = [mix(np.append(p.hash[first[i] : first[i] + n_words[i]], U64(n_words[i]))) for i in few]
                alone = [np.bitwise_xor.reduce(a * np.arange(3, 3 + len(a), dtype=U64)) for a in alone]
                value, row = np.append(value, np.array(alone, U64)), np.append(row, few)
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            value, row = value[new], row[new]
            size = np.bincount(row, minlength=p.rows).astype(np.int64)
            full = np.flatnonzero(size)
            start = (np.cumsum(size) - size)[full]
            one, two = np.zeros(p.rows, U64), np.zeros(p.rows, U64)
            halves, sketch = np.zeros((p.rows, HALVES), U64), np.zeros((p.rows, SKETCH // 16), U64)
            if len(full):
                one[full] = np.add.reduceat(mix(value), start)
                two[full] = np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), start)
                key = np.zeros(len(full), U64)
                for i, seed in enumerate(_SEEDS):
                    x = value * seed
                    x ^= x >> U64(32)
                    least = np.minimum.reduceat(x * seed, start)
                    sketch[full, i // 16] |= (mix(least) >> U64(60)) << U64(4 * (i % 16))
                    if i < HALVES * ROWS:
                        key = mix(key + least)
                        if i % ROWS == ROWS - 1:
                            halves[full, i // ROWS], key = key, np.zeros(len(full), U64)
            empty = size == 0

            def lists(x: np.ndarray) -> pa.Array:
                bounds = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                return pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.view(np.int64).reshape(-1)))

            yield pa.RecordBatch.from_arrays(
                [
                    part.column(names.index("doc_id")), part.column(names.index("mark")), pa.array(size),
                    pa.array(one.view(np.int64), mask=empty), pa.array(two.view(np.int64), mask=empty),
                    lists(halves), lists(sketch),
                ],
                ["doc_id", "mark", "n_shingles", "set1", "set2", "halves", "sketch"],
            )


def signatures(documents: DataFrame, shingle: int) -> DataFrame:
    """Set size, 128-bit value of the set, short keys and sketch of every document; mark: its text."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(
        partial(_signatures, k=shingle),
        "doc_id long, mark long, n_shingles long, set1 long, set2 long, "
        "halves array<long>, sketch array<long>",
    )


def _shingles(text: bytes, k: int) -> set:
    words = text.lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    last, other = None, set()
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        one = batch.column(2).cast(pa.binary())
        two = batch.column(3).cast(pa.binary())
        for i in range(batch.num_rows):
            b = two[i].as_buffer().to_pybytes()
            if b != last:
                last, other = b, _shingles(b, k)
            own = _shingles(one[i].as_buffer().to_pybytes(), k)
            common = len(own & other)
            keep[i] = 100 * common >= percent * (len(own) + len(other) - common) > 0
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _confirmed(pairs: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, a_mark, b, b_mark) of documents whose full shingle sets are similar enough."""
    texts = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    own = texts.select(F.col("doc_id").alias("a"), F.col("mark").alias("a_mark"), F.col("text").alias("one"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("mark").alias("b_mark"), F.col("text").alias("two"))
    both = pairs.join(own, ["a", "a_mark"]).join(other, ["b", "b_mark"]).select("a", "b", "one", "two")
    return both.mapInArrow(partial(_confirm, k=shingle, percent=percent), "a long, b long").distinct()


def _similar_size(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _links_of(
    left: pd.DataFrame, right: pd.DataFrame, shingle: int, percent: int
) -> pd.DataFrame:
    """Links between two blocks of documents of different components, without listing the pairs."""
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        sketch = [np.stack(x["sketch"]).view(U64) for x in (left, right)]
        size = [x["n"].to_numpy() for x in (left, right)]
        place = [x["place"].to_numpy() for x in (left, right)]
        number = [x["doc_id"].to_numpy() for x in (left, right)]
        low = left["low"].iloc[0]
        sets: list[dict[int, set]] = [{}, {}]

        def full(side: int, frame: pd.DataFrame, i: int) -> set:
            if i not in sets[side]:
                sets[side][i] = _shingles(frame["text"].iat[i].encode(), shingle)
            return sets[side][i]

        for i in range(len(left)):
            d = sketch[0][i] ^ sketch[1]
            d |= d >> U64(1)
            d |= d >> U64(2)
            equal = SKETCH - np.bitwise_count(d & U64(0x1111111111111111)).sum(1, dtype=np.int64)
            near = (equal >= LIKELY) & (place[1] != place[0][i])
            near &= (place[1] == low) | (number[1] < number[0][i])
            near &= 100 * np.minimum(size[0][i], size[1]) >= percent * np.maximum(size[0][i], size[1])
            for j in np.flatnonzero(near).tolist():
                x, y = full(0, left, i), full(1, right, j)
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    found.append((number[0][i], number[1][j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _across(apart: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links of the sets that large buckets hold beside their least component.

    The sets around one component are dealt to blocks; every block of sets outside it meets every
    block of all of them. Pairs are compared inside the blocks and only links leave.
    """
    texts = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    around = apart.groupBy("low", "own").agg(F.first("at").alias("place"), F.first("sketch").alias("sketch"))
    around = around.select("low", "own.*", "place", "sketch")
    total = around.groupBy("low").agg(
        F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if(F.col("place") != F.col("low")) / BLOCK).alias("outside")
    )
    whole = around.join(total, "low").join(texts, ["doc_id", "mark"])
    deal = F.xxhash64("doc_id", "mark")
    columns = ["low", "doc_id", "n", "place", "sketch", "text"]
    left = whole.where(F.col("place") != F.col("low")).select(
        *columns, F.pmod(deal, F.col("outside")).alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"),
    )
    right = whole.select(
        *(F.col(c).alias(c) for c in columns), F.pmod(deal, F.col("blocks")).alias("j"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("outside") - 1)).alias("i"),
    )
    key = ("low", "i", "j")
    compare = lambda x, y: _links_of(x, y, shingle, percent)
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "a long, b long")
    return met.distinct()


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents are linked if the Jaccard similarity of their sets of word shingles (A-Z in lower
    case) is at least `percent`; component_id is the least doc_id reachable. A text with fewer words
    than a shingle is one shingle. Null, empty or wordless text: an empty set, linked with nothing.
    Rows that repeat a doc_id are one document: whatever one of them is linked with, all are. Null
    doc_id: linked with nothing, component null, kept. Empty table: no rows.
    """
    signed = written(signatures(documents, shingle))
    sets = signed.where(F.col("doc_id").isNotNull() & F.col("set1").isNotNull())
    key = ("set1", "set2")
    nodes = sets.groupBy(*key).agg(
        F.min(F.struct("doc_id", "mark")).alias("least"),
        F.first("n_shingles").alias("n"), F.first("halves").alias("halves"),
        F.first("sketch").alias("sketch"),
    )
    nodes = written(nodes.select("least.*", *key, "n", "halves", "sketch"))
    pair = [(i, j) for i in range(HALVES) for j in range(i + 1, HALVES)]
    tables = F.explode(
        F.array(*(F.xxhash64(F.lit(i * HALVES + j), F.col("halves")[i], F.col("halves")[j]) for i, j in pair))
    )
    # one narrow row a table key; what else is known of a set joins where keys are shared
    rows = nodes.select(tables.alias("bucket"), "doc_id")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    own = nodes.select("doc_id", F.struct("doc_id", "mark", F.col("n").cast("int").alias("n")).alias("own"))
    met = written(rows.join(sizes, "bucket").join(own, "doc_id").select("bucket", "size", "own"))

    def pairs(of: DataFrame) -> DataFrame:
        fit = of.where(_similar_size(F.col("x.n"), F.col("y.n"), percent) & (F.col("x") != F.col("y")))
        first = F.col("x") > F.col("y")
        a, b = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
        fit = fit.select(a.alias("a"), b.alias("b")).select(
            F.col("a.doc_id").alias("a"), F.col("a.mark").alias("a_mark"),
            F.col("b.doc_id").alias("b"), F.col("b.mark").alias("b_mark"),
        )
        return fit.distinct()

    few = met.where(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.collect_list("own").alias("all"))
    few = few.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x > y")
    many = met.where(F.col("size") > SMALL_BUCKET)
    leads = many.groupBy("bucket").agg(F.min("own").alias("lead"))
    stars = many.join(leads, "bucket").select(F.col("own").alias("x"), F.col("lead").alias("y"))
    links = written(_confirmed(pairs(few.unionByName(stars)), documents, shingle, percent))
    if not signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        links = written(links.unionByName(_one_document(sets, nodes)))
    reached = components(links)

    # what a large bucket still holds apart: sets outside the component of its least set
    place = F.coalesce(F.col("component"), F.col("own.doc_id"))
    placed = many.join(reached, F.col("own.doc_id") == F.col("node"), "left").select(
        "bucket", "own", place.alias("at")
    )
    spread = placed.groupBy("bucket").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    apart = placed.join(spread.where("low < high").select("bucket", "low"), "bucket")
    sketched = nodes.select(F.struct("doc_id", "mark", F.col("n").cast("int").alias("n")).alias("own"), "sketch")
    apart = written(apart.join(sketched, "own"))
    more = written(_across(apart, documents, shingle, percent))
    if not more.isEmpty():
        reached = components(links.unionByName(more))
    return _labelled(signed, nodes, reached)


def _one_document(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the sets of rows that repeat a doc_id: they are one document."""
    named = sets.select("doc_id", "set1", "set2").join(
        nodes.select("set1", "set2", F.col("doc_id").alias("node")), ["set1", "set2"]
    )
    named = named.select("doc_id", "node").distinct()
    low = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high"))
    return named.join(low.where("b < high"), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def _labelled(signed: DataFrame, nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """One row per document row, with the component of its set."""
    named = nodes.join(reached, F.col("doc_id") == F.col("node"), "left").select(
        "set1", "set2", F.coalesce("component", "doc_id").alias("component")
    )
    found = signed.select("doc_id", "n_shingles", "set1", "set2").join(named, ["set1", "set2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
