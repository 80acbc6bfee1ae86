"""Prefix trie of conversations by truncation peeling.

The trie is built from its deepest level up. At every depth the conversations that end there are
merged with the nodes that are left from the depth below; equal prefixes are one node, and their
counts are complete the moment they meet. Then every node loses its last turn and is regrouped
with its siblings one level higher, so nodes are found and aggregated in the same single pass.

A prefix is known by a 128-bit key, a sum over its turns that does not depend on where a
conversation was cut between tasks. Deep levels with few conversations are peeled many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.llm.words import U64, pieces
from argusframe.sources.session import materialize

#: Conversations rebuilt from one head, and the most turns taken from it.
FAMILY, HEAD = 20, 3
#: Levels whose turns are fewer than this in sum are peeled in one job, tree by tree; wider levels one
#: by one, their paths looked up for so many levels at once.
NARROW, BAND = 1 << 14, 16
#: Characters of role and text that say where tasks split rows of one conversation and turn.
SPLIT = 32
_ONE, _TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SIZE = 1 << 64


def _powers(base: int, first: int, n: int) -> np.ndarray:
    """base**first .. base**(first + n - 1) modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = pow(base, first, _SIZE)
    return np.cumprod(out, dtype=U64)[:n]


def _sums(hashes: np.ndarray, base: int, at: int, before: int) -> np.ndarray:
    """Running sums of hash * base**place, places from `at` + 1, on top of `before`."""
    if not len(hashes):
        return hashes
    terms = hashes * _powers(base, at + 1, len(hashes))
    terms[0] += U64(before)
    return np.cumsum(terms, dtype=U64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and running keys of sorted turns, counted within the task."""
    conv, n, one, two = None, 0, 0, 0
    for batch in batches:
        names = batch.schema.names
        ids = batch.column(names.index("conv_id")).to_numpy()
        if not len(ids):
            continue
        role, text = batch.column(names.index("role")), batch.column(names.index("text"))
        h = np.empty((len(ids), 2), U64)
        for i, (r, t) in enumerate(zip(role.to_pylist(), text.to_pylist(), strict=True)):
            r = r.encode()
            h[i] = np.frombuffer(hashlib.blake2b(b"%d:%b%b" % (len(r), r, t.encode()), digest_size=16).digest(), U64)
        words = np.concatenate([p.word_counts() for p in pieces(text)])
        place, k1, k2 = np.empty(len(ids), np.int64), np.empty(len(ids), U64), np.empty(len(ids), U64)
        begin = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True):
            if ids[a] != conv:
                conv, n, one, two = int(ids[a]), 0, 0, 0
            place[a:b] = np.arange(n + 1, n + 1 + b - a)
            k1[a:b], k2[a:b] = _sums(h[a:b, 0], _ONE, n, one), _sums(h[a:b, 1], _TWO, n, two)
            n, one, two = n + b - a, int(k1[b - 1]), int(k2[b - 1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index("conv_id")), batch.column(names.index("part")), pa.array(place),
             pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(words)],
            ["conv_id", "part", "place", "k1", "k2", "words"],
        )


def _shift(batches: Iterator[pa.RecordBatch], before: dict[int, list[tuple[int, int, int, int]]]) -> Iterator[pa.RecordBatch]:
    """Add what earlier tasks hold of a conversation; before: per task, (conversation, turns, keys)."""
    for batch in batches:
        ids, part, place = (batch.column(i).to_numpy() for i in range(3))
        place, keys = place.copy(), [batch.column(i).to_numpy().view(U64).copy() for i in (3, 4)]
        for p in np.unique(part).tolist():
            for conv, n, *sums in before.get(p, []):
                at = (ids == conv) & (part == p)
                place[at] += n
                for k, base, add in zip(keys, (_ONE, _TWO), sums, strict=True):
                    k[at] = k[at] * U64(pow(base, n, _SIZE)) + U64(add)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(place), *(pa.array(k.view(np.int64)) for k in keys), batch.column(5)],
            ["conv_id", "place", "k1", "k2", "words"],
        )


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, k1, k2, words): own turns from 1 in order, with the key of the turns up to each.

    Rows are dealt to tasks by ranges of (conversation, turn), so a conversation of any length is
    spread; each task counts for itself, and what its first conversation has in earlier tasks is
    added afterwards.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turn = F.col("turn").asc_nulls_first()
    dealt = rows.repartitionByRange("conv_id", turn, F.left("role", F.lit(SPLIT)), F.left("text", F.lit(SPLIT)))
    local = (
        dealt.sortWithinPartitions("conv_id", turn, "role", "text")
        .select("conv_id", "role", "text", F.spark_partition_id().alias("part"))
        .mapInArrow(_scan, "conv_id long, part int, place long, k1 long, k2 long, words long")
    )
    local = materialize(local)
    ends = local.groupBy("conv_id", "part").agg(F.max(F.struct("place", "k1", "k2")).alias("end"))
    # only the first and the last conversation of a task can go on in another: two rows a task
    parts = F.count("*").over(Window.partitionBy("conv_id"))
    split = ends.withColumn("parts", parts).where("parts > 1").collect()
    before: dict[int, list[tuple[int, int, int, int]]] = {}
    conv, n, one, two = None, 0, 0, 0
    for r in sorted(split, key=lambda r: (r["conv_id"], r["part"])):
        if r["conv_id"] != conv:
            conv, n, one, two = r["conv_id"], 0, 0, 0
        before.setdefault(r["part"], []).append((conv, n, one, two))
        place, k1, k2 = r["end"]
        one, two = (k1 * pow(_ONE, n, _SIZE) + one) % _SIZE, (k2 * pow(_TWO, n, _SIZE) + two) % _SIZE
        n += place
    return local.mapInArrow(partial(_shift, before=before), "conv_id long, place long, k1 long, k2 long, words long")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of own turns after the head of another conversation took the place of the first ones."""
    for batch in batches:
        c = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names)}
        keys = []
        for base, key, own, head in ((_ONE, "k1", "own1", "head1"), (_TWO, "k2", "own2", "head2")):
            inverse = pow(base, -1, _SIZE)
            back = np.array([pow(inverse, d, _SIZE) for d in range(HEAD + 1)], U64)[c["h"] - c["m"]]
            keys.append((c[key].view(U64) - c[own].view(U64)) * back + c[head].view(U64))
        depth = c["m"] + c["place"] - c["h"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(depth.astype(np.int64)), batch.column(batch.schema.get_field_index("n")),
             *(pa.array(k.view(np.int64)) for k in keys), batch.column(batch.schema.get_field_index("words"))],
            ["conv_id", "depth", "n", "k1", "k2", "words"],
        )


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes (conv_id, depth, n, k1, k2, words) of rebuilt conversations of n turns, and those of none."""
    turn = F.struct("place", "k1", "k2", "words")
    per = own.groupBy("conv_id").agg(
        F.max("place").alias("size"), F.sort_array(F.collect_list(F.when(F.col("place") <= HEAD, turn))).alias("heads")
    )
    base = per.select(F.col("conv_id").alias("base_id"), F.col("heads").alias("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    per = per.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base_id", "left")
    per = per.withColumn("h", h).withColumn(
        "base", F.slice(F.coalesce("base", F.array().cast(per.schema["heads"].dataType)), F.lit(1), F.col("h"))
    )
    m = F.size("base")

    def key_at(turns: str, at: Column, key: str) -> Column:
        """Key of the first turns; no turn, or not so many: 0 (no row needs it then)."""
        return F.coalesce(F.try_element_at(turns, F.when(at > 0, at).otherwise(HEAD + 1))[key], F.lit(0).cast("long"))

    per = per.select(
        "conv_id", "base", m.alias("m"), "h", (m + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n"),
        key_at("heads", F.col("h"), "k1").alias("own1"), key_at("heads", F.col("h"), "k2").alias("own2"),
        key_at("base", m, "k1").alias("head1"), key_at("base", m, "k2").alias("head2"),
    )
    per = materialize(per)
    first = per.select("conv_id", "n", F.explode("base").alias("t")).select(
        "conv_id", F.col("t.place").alias("depth"), "n", "t.k1", "t.k2", "t.words"
    )
    rest = own.join(per.drop("base"), "conv_id").where("place > h")
    rest = rest.mapInArrow(_replace, "conv_id long, depth long, n long, k1 long, k2 long, words long")
    return first.unionByName(rest), per.where("n = 0").select("conv_id")


class Band(NamedTuple):
    """Levels above `low` up to `high` that are peeled together."""

    low: int
    high: int
    narrow: bool


def bands(lengths: dict[int, int], narrow: int, wide: int) -> list[Band]:
    """Bands from the deepest level up; lengths: how many conversations have so many turns.

    A narrow band has at most `narrow` turns in all and ends above the root; the others have at
    most `wide` levels.
    """
    out: list[Band] = []
    ends = sorted((n for n in lengths if n > 0), reverse=True)
    high = level = ends[0] if ends else 0
    rows = reach = 0
    for top, low in zip(ends, [*ends[1:], 1]):
        reach += lengths[top]  # conversations that reach each of the levels above `low`
        if reach > narrow:
            break
        while level > max(low, 1):
            fit = min(level - max(low, 1), (narrow - rows) // reach)
            level, rows = level - fit, rows + fit * reach
            if not fit:
                out.append(Band(level, high, True))
                high, rows = level, 0
    if level < high:
        out.append(Band(level, high, True))
    out += [Band(max(top - wide, 0), top, False) for top in range(level, 0, -wide)]
    return out


_NODE = (
    "depth long, k1 long, k2 long, up1 long, up2 long, conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long"
)
_NODE_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def _peel(rows: list[tuple], low: int) -> list[tuple]:
    """Nodes of the levels above `low` under one node at `low`.

    rows: depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, and the keys and words of the path.
    """
    left: dict[int, list[list]] = {}
    for depth, *sums, k1, k2, words in rows:
        left.setdefault(depth, []).append([*sums, (k1, k2, words)])
    out = []
    at: dict[tuple[int, int], list] = {}
    for depth in range(max(left), low, -1):
        i = depth - low
        for new in left.get(depth, []):
            _merge(at, (new[-1][0][i], new[-1][1][i]), new)
        above: dict[tuple[int, int], list] = {}
        for key, (conv, n, children, leaves, saved, path) in at.items():
            up = (path[0][i - 1], path[1][i - 1])
            saved += (n - 1) * path[2][i]
            leaves = leaves if children else 1
            out.append((depth, *key, *up, conv, n, children, leaves, saved))
            _merge(above, up, [conv, n, 1, leaves, saved, path])
        at = above
    return out


def _peels(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[pa.RecordBatch]:
    """Peel group after group of rows sorted by (g1, g2); a group has NARROW turns at most."""
    names = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "p1", "p2", "pw"]
    held: list[tuple] = []
    group = None

    def nodes(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * len(_NODE_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NODE_NAMES)

    for batch in batches:
        found: list[tuple] = []
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("g1", "g2", *names)]
        for g1, g2, *row in zip(*columns, strict=True):
            if (g1, g2) != group and held:
                found += _peel(held, low)
                held = []
            group = (g1, g2)
            held.append(tuple(row))
        yield nodes(found)
    if held:
        yield nodes(_peel(held, low))


def _merge(at: dict, key: tuple[int, int], new: list) -> None:
    have = at.get(key)
    if have is None:
        at[key] = new
        return
    have[0] = min(have[0], new[0])
    for i in (1, 2, 3, 4):
        have[i] += new[i]


def _paths(prefixes: DataFrame, band: Band) -> DataFrame:
    """Keys of every conversation from the level `low` of a band (1 at least) to its end or `high`."""
    inside = prefixes.where(F.col("depth").between(max(band.low, 1), band.high))
    steps = F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "words")))
    return inside.groupBy(F.col("conv_id").alias("of")).agg(steps.alias("path"))


def _stripped(nodes: DataFrame) -> DataFrame:
    """What is left of nodes without their last turn."""
    return nodes.select(
        (F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2"), "conv_id", "n_convs",
        F.lit(1).cast("long").alias("n_children"), *(c for c in ("n_leaves", "saved_tokens", "path") if c in nodes.columns),
    )


def _level(rows: DataFrame, band: Band, depth: int) -> DataFrame:
    """Nodes at a depth, with their paths."""
    first = max(band.low, 1)

    def step(d: int, name: str) -> Column:
        return F.element_at("path", d - first + 1)[name] if d >= 1 else F.lit(0).cast("long")

    merged = rows.where(F.col("depth") == depth).groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("path").alias("path"),
        *(F.sum(n).alias(n) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    return merged.select(
        F.lit(depth).cast("long").alias("depth"), "k1", "k2", step(depth - 1, "k1").alias("up1"), step(depth - 1, "k2").alias("up2"),
        "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * step(depth, "words")).alias("saved_tokens"), "path",
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the joined ids of every node from rows sorted by (depth, k1, k2, conv_id), hashed as they pass."""
    key, state = None, None

    def done(keys: list, digests: list) -> pa.RecordBatch:
        columns = list(zip(*keys, strict=True)) if keys else [[]] * 3
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string())],
            ["depth", "k1", "k2", "ends_sha256"],
        )

    for batch in batches:
        keys, digests = [], []
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("depth", "k1", "k2", "conv_id")]
        for *node, conv in zip(*columns, strict=True):
            if node == key:
                state.update(b",%d" % conv)
                continue
            if key is not None:
                keys.append(key)
                digests.append(state.hexdigest())
            key, state = node, hashlib.sha256(b"%d" % conv)
        yield done(keys, digests)
    if key is not None:
        yield done([key], [state.hexdigest()])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    Every conversation c takes its first h = crc32(c) % 4 turns from conversation c - c % 20 and
    the rest from itself (% as in SQL, with the sign of c). Turns are ordered by turn (null first), ties by role, then text; null
    role or text is empty; repeated rows are turns of their own. Null conv_id: no part. Empty
    table: no rows, otherwise the root is a node even if no conversation has a turn.

    A node is (depth, key) and keys have 128 bits. The digest of the ids that end at a node is
    sequential by definition: ids of one node pass through one task, sorted outside of memory, one
    at a time. Jobs: one a level that more than NARROW conversations reach, and one for every
    NARROW turns of the deeper levels.
    """
    own = materialize(numbered(conversations))
    prefixes, turnless = rebuilt(own)
    prefixes = materialize(prefixes)
    zero = F.lit(0).cast("long")
    ended = prefixes.where("depth = n").select("depth", "k1", "k2", "conv_id").unionByName(
        turnless.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    )
    # as many rows as there are different lengths: at most the root of twice the turns
    lengths = {r["depth"]: r["count"] for r in ended.groupBy("depth").count().collect()}
    ends = ended.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
    )
    ends = materialize(
        ends.select("*", *(zero.alias(n) for n in ("n_children", "n_leaves", "saved_tokens")))
    )
    nodes: list[DataFrame] = []
    left = None
    for band in bands(lengths, NARROW, BAND):
        rows = ends.where(F.col("depth").between(band.low + 1, band.high))
        if left is not None:
            rows = rows.unionByName(left)
        rows = rows.join(_paths(prefixes, band), F.col("conv_id") == F.col("of")).drop("of")
        # a representative may go on below: its path ends at the node
        rows = rows.withColumn(
            "path", F.slice("path", F.lit(1), (F.col("depth") - max(band.low, 1) + 1).cast("int"))
        )
        if band.narrow:
            top = rows.select(
                *ends.columns, *(F.col(f"path.{n}").alias(p) for n, p in (("k1", "p1"), ("k2", "p2"), ("words", "pw")))
            ).select("*", F.col("p1")[0].alias("g1"), F.col("p2")[0].alias("g2"))
            top = top.repartition("g1", "g2").sortWithinPartitions("g1", "g2")
            found = materialize(top.mapInArrow(partial(_peels, low=band.low), _NODE))
            nodes.append(found)
            left = _stripped(found.where(F.col("depth") == band.low + 1))
            continue
        rows = materialize(rows)
        survivors = rows.where("false")
        for depth in range(band.high, band.low, -1):
            found = materialize(_level(rows.unionByName(survivors), band, depth))
            nodes.append(found.drop("path"))
            survivors = _stripped(found)
        left = survivors.drop("path")
    root = ends.where("depth = 0")
    root = root.unionByName(left) if left is not None else root
    root = root.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"),
        *(F.sum(n).alias(n) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    nothing = F.lit(None).cast("long")
    nodes.append(
        root.withColumn("n_leaves", F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(1))
        .select("depth", "k1", "k2", nothing.alias("up1"), nothing.alias("up2"), *_NODE_NAMES[5:])
    )
    whole = nodes[0]
    for more in nodes[1:]:
        whole = whole.unionByName(more)
    whole = materialize(whole)
    parents = whole.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    digests = (
        ended.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "conv_id")
        .mapInArrow(_digest, "depth long, k1 long, k2 long, ends_sha256 string")
    )
    return (
        whole.join(digests, ["depth", "k1", "k2"], "left").join(parents, ["depth", "up1", "up2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
