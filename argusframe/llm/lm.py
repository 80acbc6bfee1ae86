"""Language-model scores of whole documents.

Token counts of all training texts give the base model, the vocabulary and its classes. The
frequent tokens are items of a gated recurrent network of their own; every other token is one of
64 rest items, chosen by its ending, followed by its share of that item's counts. So each known
or unknown token has a probability. The network starts from a bounded sample and is then trained
over all training documents: each partition goes on from the same network over its own documents,
and the results are averaged by tokens.

Tokens are named by 58 bits of a hash and 6 bits of the ending.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from argusframe.llm.recurrent import Classes, Net, Running, Trainer, score
from argusframe.llm.words import U64, Piece, pieces
from argusframe.sources.session import checkpoint_dir

#: Tokens whose counts every machine holds; items with an output of their own; classes.
HEAD, ITEMS, RESTS, CLASSES = 1 << 18, 2048, 64, 46
#: Bound of the sample the network starts from, in documents; passes over it.
SAMPLE, PASSES = 1500, 3
#: Tokens learned together, tokens scored together, and pairs a task collects before it passes counts on.
CHUNK, SCORED, COLLECT = 1 << 19, 1 << 20, 1 << 20
#: Leading bits of a key that find its range of the head.
RANGE_BITS = 20
RANGES = 1 << RANGE_BITS
END = 0  # item of the document end
LN10 = float(np.log(10))


def token_keys(p: Piece) -> np.ndarray:
    """64-bit names of the words of a piece: hash, and in the low bits the bucket of the ending."""
    last = p.data[p.end - 1].astype(U64)
    other = np.where(p.end - p.start > 1, p.data[np.maximum(p.end - 2, 0)], 0).astype(U64)
    last, other = (np.where((x >= 65) & (x <= 90), x + U64(32), x) for x in (last, other))
    bucket = ((last * U64(31) + other * U64(7)) * U64(0x9E3779B97F4A7C15)) >> U64(58)
    return (p.hash & ~U64(63)) | bucket


def is_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, size = [], [], 0

    def merged() -> pa.RecordBatch:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
        keys[:], counts[:] = [key], [n]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for p in pieces(batch.column(0)):
            key, n = np.unique(token_keys(p), return_counts=True)
            keys.append(key)
            counts.append(n)
            size += len(key)
            if size > COLLECT:
                out = merged()
                size = len(keys[0])
                if size > COLLECT // 2:
                    yield out
                    keys, counts, size = [], [], 0
    if keys:
        yield merged()


def token_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of all training texts, without the ends of documents."""
    rows = documents.where(is_training(F.col("doc_id"))).select("text")
    return rows.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/counts-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


@dataclass
class Vocabulary:
    """Head tokens sorted by key, with counts and item numbers; totals of the rest items."""

    key: np.ndarray
    count: np.ndarray
    item: np.ndarray
    rest_total: np.ndarray
    rest_kinds: np.ndarray
    item_count: np.ndarray
    classes: Classes
    total: int
    kinds: int
    ends: int

    @property
    def items(self) -> int:
        return len(self.item_count)

    def __post_init__(self) -> None:
        # first key of each range of leading bits, and the most keys of one range
        edges = np.arange(RANGES, dtype=np.uint64) << U64(64 - RANGE_BITS)
        self.range_first = np.searchsorted(self.key, edges).astype(np.int32)
        self.range_most = int(np.diff(self.range_first, append=len(self.key)).max(initial=0))

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where each key is among the head, or a place of another key: few steps in its range."""
        at = np.minimum(self.range_first[(key >> U64(64 - RANGE_BITS)).astype(np.int64)], len(self.key) - 1)
        left = np.flatnonzero(self.key[at] < key)
        for _ in range(self.range_most):
            if not len(left):
                break
            at[left] = np.minimum(at[left] + 1, len(self.key) - 1)
            left = left[self.key[at[left]] < key[left]]
        return at

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and head count (-1: not in the head) of each token."""
        bucket = (key & U64(63)).astype(np.int64) + self.items - RESTS
        if not len(self.key):
            return bucket, np.full(len(key), -1, np.int64)
        at = self._place(key)
        hit = self.key[at] == key
        item = np.where(hit & (self.item[at] >= 0), self.item[at], bucket)
        return item, np.where(hit, self.count[at], -1)


def vocabulary(counts: DataFrame, training_documents: int) -> Vocabulary:
    """Head and totals from the counts; the head ends where a bucket of counts no longer fits."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    levels = sorted(((r["level"], r["n"], r["kinds"]) for r in levels.collect()), reverse=True)
    total, kinds = sum(n for _, n, _ in levels), sum(k for _, _, k in levels)
    held, least = 0, None
    for name, _, k in levels:
        if held + k > HEAD:
            break
        held, least = held + k, name
    rows = counts.where(level >= least).toPandas() if least is not None else pd.DataFrame({"word": [], "n": []}, dtype="int64")
    rows = rows.sort_values(["n", "word"], ascending=[False, True])
    key, n = rows["word"].to_numpy(np.int64).view(U64), rows["n"].to_numpy(np.int64)
    rests = counts.groupBy(F.pmod("word", F.lit(RESTS)).alias("rest")).agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")
    )
    rest_total, rest_kinds = np.zeros(RESTS), np.zeros(RESTS)
    for r in rests.collect():  # RESTS rows
        rest_total[r["rest"]], rest_kinds[r["rest"]] = r["n"], r["kinds"]
    own = min(ITEMS, len(key))
    bucket = (key[:own] & U64(63)).astype(np.int64)
    rest_total -= np.bincount(bucket, n[:own], RESTS)
    rest_kinds -= np.bincount(bucket, minlength=RESTS)
    # items: the end, the most frequent tokens, the rests; numbered by frequency within classes
    amount = np.concatenate(([training_documents], n[:own], rest_total))
    classes = _classes(amount)
    item = np.full(len(key), -1, np.int64)
    item[:own] = np.arange(1, own + 1)
    order = np.argsort(key)
    return Vocabulary(
        key[order], n[order], item[order], rest_total, rest_kinds, amount, classes,
        total + training_documents, kinds + (training_documents > 0), training_documents,
    )


def _classes(amount: np.ndarray) -> Classes:
    """Classes over items in their own order: the end alone, words by frequency, rests together."""
    words = Classes.by_frequency(amount[1 : len(amount) - RESTS], CLASSES) if len(amount) > RESTS + 1 else None
    of = [np.zeros(1, np.int64)]
    if words is not None:
        of.append(words.of + 1)
    of.append(np.full(RESTS, of[-1][-1] + 1))
    of = np.concatenate(of)
    return Classes(np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)), of)


def _documents(
    batches: Iterator[pa.RecordBatch], v: Vocabulary, chunk: int
) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Rows with enough tokens to work on together: (rows, [(items, counts, keys)], tokens per row)."""
    for batch in batches:
        row0, held, sizes = 0, [], []
        for p in pieces(batch.column(batch.schema.get_field_index("text"))):
            key = token_keys(p)
            held.append((*v.lookup(key), key))
            sizes.append(p.word_counts())
            if sum(len(h[2]) for h in held) >= chunk or p.row0 + p.rows == batch.num_rows:
                size = np.concatenate(sizes)
                yield batch.slice(row0, len(size)), held, size
                row0, held, sizes = p.row0 + p.rows, [], []


def _with_ends(items: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items with the end of each document after its words."""
    at = np.cumsum(size)
    return np.insert(items, at, END), size + 1


def _teach(
    batches: Iterator[pa.RecordBatch], v: Vocabulary, start: np.ndarray, squares: list[np.ndarray]
) -> Iterator[pa.RecordBatch]:
    net = Net.fresh(v.items, v.item_count, v.classes)
    net.load(start)
    trainer = Trainer(net, v.classes, 0.02, [s.copy() for s in squares])
    chunks = (
        _with_ends(np.concatenate([h[0] for h in held]), size) for _, held, size in _documents(batches, v, CHUNK)
    )
    trainer.learn_all(chunks, END, 256)
    if trainer.tokens:
        vector = net.vector()
        parts = np.array_split(vector, -(-len(vector) // 4096))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(parts)), pa.int32()), pa.array([float(trainer.tokens)] * len(parts)),
                pa.array([(p.astype(np.float64) * trainer.tokens).tolist() for p in parts], pa.list_(pa.float64())),
            ],
            ["part", "tokens", "values"],
        )


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {"part": [rows["part"].iloc[0]], "tokens": [rows["tokens"].sum()], "values": [np.sum(rows["values"].to_list(), 0)]}
    )


def fit(documents: DataFrame, v: Vocabulary) -> np.ndarray:
    """Parameters of the network, trained over all training documents."""
    training = documents.where(is_training(F.col("doc_id"))).select("doc_id", "text")
    least = documents.where(is_training(F.col("doc_id"))).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE ids: every machine can hold them
    rows = training.join(F.broadcast(least.distinct()), "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))[: 2 * SAMPLE]
    net = Net.fresh(v.items, v.item_count, v.classes)
    trainer = Trainer(net, v.classes, 0.1)
    batch = pa.RecordBatch.from_arrays([pa.array([r["text"] for r in rows], pa.string())], ["text"])
    for _ in range(PASSES):
        for _, held, size in _documents(iter([batch]), v, CHUNK):
            items, size = _with_ends(np.concatenate([h[0] for h in held]), size)
            trainer.learn(items, size, END, 64)
    schema = "part int, tokens double, values array<double>"
    taught = training.select("text").mapInArrow(
        partial(_teach, v=v, start=net.vector(), squares=trainer.squares), schema
    )
    # two levels, so no group holds the results of all partitions
    some = taught.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.groupBy("part", "some").applyInPandas(_add, schema)
    mean = some.groupBy("part").applyInPandas(_add, schema).collect()
    if not mean:
        return net.vector()
    parts = sorted((r["part"], np.asarray(r["values"]) / r["tokens"]) for r in mean)
    return np.concatenate([p for _, p in parts]).astype(np.float32)


def _score(batches: Iterator[pa.RecordBatch], v: Vocabulary, net: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = Net.fresh(v.items, v.item_count, v.classes)
    model.load(net)
    rest = np.log10(v.rest_total + 0.1 * (v.rest_kinds + 1))
    base = np.log10(v.total + 0.1 * (v.kinds + 1))
    names = ["row", "doc_id", "word", "times", "n_tokens", "n_known", "base", "score"]
    waiting: deque[tuple] = deque()  # all but the scores of chunks that are not over
    running = Running(model, v.classes, END, 512)

    def over(got: np.ndarray) -> Iterator[pa.RecordBatch]:
        while len(got):
            columns, shares, n = waiting.popleft()
            own, got = got[: len(shares)] / LN10 + shares, got[len(shares) :]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.array(own), pa.nulls(n, pa.float64())])], names)

    for part, held, size in _documents(batches, v, SCORED):
        item, count, key = (np.concatenate([h[i] for h in held]) for i in range(3))
        row = np.repeat(np.arange(len(size)), size)
        items, full = _with_ends(item, size)
        is_rest = item >= v.items - RESTS
        bucket = item[is_rest] - (v.items - RESTS)
        head = count >= 0
        log = np.log10(np.where(head, count, 0) + 0.1)
        shares = np.zeros(len(size))
        shares += np.bincount(row[head & is_rest], log[head & is_rest], len(size))
        shares -= np.bincount(row[is_rest], rest[bucket], len(size))
        known = np.bincount(row[head], minlength=len(size)) + (v.ends > 0)
        plain = np.bincount(row[head], log[head], len(size)) + np.log10(v.ends + 0.1) - full * base
        # tokens outside the head meet their counts in a join
        far = ~head
        order = np.lexsort((key[far], row[far]))
        word, at = key[far][order], row[far][order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1])
        start = np.flatnonzero(new)
        times = np.diff(start, append=len(word))
        number = part.column(part.schema.get_field_index("row")).to_numpy()
        ids = part.column(part.schema.get_field_index("doc_id"))
        n = len(start)
        none = pa.nulls(n, pa.int64())
        columns = [
            pa.concat_arrays([pa.array(number), pa.array(number[at[start]])]),
            pa.concat_arrays([ids, none]),
            # a row of a document itself carries its own number scrambled, and no token
            pa.concat_arrays([pa.array((number.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)), pa.array(word[start].view(np.int64))]),
            pa.concat_arrays([pa.array(np.zeros(len(size), np.int64)), pa.array(times.astype(np.int64))]),
            pa.concat_arrays([pa.array(full.astype(np.int64)), none]),
            pa.concat_arrays([pa.array(known.astype(np.int64)), none]),
            pa.concat_arrays([pa.array(plain), pa.nulls(n, pa.float64())]),
        ]
        waiting.append((columns, shares, n))
        yield from over(score(model, v.classes, items, full, END, 512, running))
    none = np.zeros(0, np.int64)
    yield from over(running.add(none, none, last=True))


def score_documents(documents: DataFrame) -> DataFrame:
    """Base and model log10 probability of every whole text.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Learned from documents
    with crc32(doc_id) % 10 <> 0. Null or empty text: the end alone. Null doc_id: scored, held_out
    null, not learned from. Repeated rows: each counts and is scored. Empty table: no rows. Nothing
    to learn from: every token is unknown, the network is untrained.
    """
    training_documents = documents.where(is_training(F.col("doc_id"))).count()
    counts = _stored(token_counts(documents))
    v = vocabulary(counts, training_documents)
    net = fit(documents, v)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = rows.mapInArrow(
        partial(_score, v=v, net=net),
        "row long, doc_id long, word long, times long, n_tokens long, n_known long, base double, score double",
    )
    met = parts.join(counts, "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    whole = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.max("base") + F.sum(log)).alias("base_score"),
        (F.max("score") + F.sum(log)).alias("score"),
    )
    return whole.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
