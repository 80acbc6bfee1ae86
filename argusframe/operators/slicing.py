"""Ordered per-key logic that does not put one hot key into one task.

A plain `Window.partitionBy(key).orderBy(ts)` moves a whole key to a single task. Here each
key is cut into slices of its order column (time or byte offset); the full data is shuffled
once by (key, slice), and only the two edge rows of each slice meet again per key. The number
of edge rows is bounded by the extent of the key divided by the slice width, not by its rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE = "_slice"
DEFAULT_SLICE_SECONDS = 900


def sequence_key(ts: Column, row_id: Column) -> Column:
    """One number ordered by (time, row id): microseconds, then all 64 bits of the id.

    A decimal, so it is unique where ids are, and still a fixed-width aggregation buffer.
    """
    wide = "decimal(38,0)"
    low = F.lit(str(1 << 63)).cast(wide)
    scale = F.lit(str(1 << 64)).cast("decimal(20,0)")
    us = F.unix_micros(ts).cast("decimal(18,0)")
    return (us * scale + row_id.cast(wide) + low).cast(wide)


def time_slice(ts: Column, seconds: float = DEFAULT_SLICE_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000)))


def range_slice(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def null_safe_join(
    left: DataFrame, right: DataFrame, names: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on `names` in which nulls match nulls; the left key columns are kept."""
    renamed = right.select(
        *(F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns)
    )
    cond = reduce(
        lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names)
    )
    return left.join(renamed, cond, how).drop(*(f"_r_{n}" for n in names))


def lag_in_slices(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fields: list[str],
    slice_by: Column,
    name: str = "prev",
) -> DataFrame:
    """Add `name`, a struct of `fields` of the previous row of the key (null on the first).

    `slice_by` must grow with `order`.
    """
    inner = Window.partitionBy(*keys, SLICE).orderBy(*order)
    marked = (
        df.withColumn(SLICE, slice_by)
        .withColumn(name, F.lag(F.struct(*fields)).over(inner))
        .withColumn("_last", F.lead(F.lit(1)).over(inner).isNull())
    )
    body = marked.where(F.col(name).isNotNull())
    across = Window.partitionBy(*keys).orderBy(SLICE, *order)
    heads = (
        marked.where(F.col(name).isNull() | F.col("_last"))
        .withColumn("_head", F.col(name).isNull())
        .withColumn(name, F.lag(F.struct(*fields)).over(across))
        .where("_head")
        .drop("_head")
    )
    return body.unionByName(heads).drop("_last", SLICE)


def _mark(df, keys, seq, fields, starts, slice_by) -> DataFrame:
    """Rows with their predecessor in the slice and the last opening seen in the slice."""
    inner = Window.partitionBy(*keys, SLICE).orderBy(seq)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn(SLICE, slice_by)
        .withColumn("_prev", F.lag(F.struct(*fields)).over(inner))
        .withColumn("_last", F.lead(F.lit(1)).over(inner).isNull())
        .withColumn(
            "_opens", F.when(F.col("_prev").isNotNull() & starts(F.col("_prev")), F.col(seq))
        )
        .withColumn("_local", F.max("_opens").over(upto))
    )


def _resolve_heads(marked, keys, seq, fields, starts) -> DataFrame:
    """Island of the first row of every slice, from the edge rows of the slices alone."""
    across = Window.partitionBy(*keys).orderBy(SLICE, seq)
    upto = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(
        F.col("_head"),
        F.when(F.col("_prev").isNull() | starts(F.col("_prev")), F.col(seq)),
    )
    return (
        marked.where(F.col("_prev").isNull() | F.col("_last"))
        .withColumn("_head", F.col("_prev").isNull())
        .withColumn("_prev", F.lag(F.struct(*fields)).over(across))
        .withColumn("_opened", F.greatest(opened, F.col("_local")))
        .withColumn("_resolved", F.max("_opened").over(upto))
        .where("_head")
        .select(*keys, SLICE, "_resolved")
    )


def islands(
    df: DataFrame,
    keys: list[str],
    seq: str,
    fields: list[str],
    starts: Callable[[Column], Column],
    slice_by: Column,
    partial: dict[str, Column],
    merge: dict[str, Column],
    island: str = "island",
) -> DataFrame:
    """Group consecutive rows into islands; a row opens one when `starts(prev)` is true.

    `seq` is a number column, unique and ordered within the key; the island is identified by
    the `seq` of its first row. `partial` are aggregates over rows, `merge` aggregates over
    the partial results of the same names. `prev` is a struct of `fields` of the row before.
    """
    marked = _mark(df, keys, seq, fields, starts, slice_by)
    parts = marked.groupBy(*keys, SLICE, "_local").agg(
        *(c.alias(n) for n, c in partial.items())
    )
    heads = _resolve_heads(marked, keys, seq, fields, starts)
    # at most one head part per (key, slice): both sides of this join are edge-sized
    open_parts = parts.where(F.col("_local").isNull()).drop("_local")
    joined = null_safe_join(open_parts, heads, [*keys, SLICE]).select(
        *keys, F.col("_resolved").alias(island), *partial
    )
    closed = parts.where(F.col("_local").isNotNull()).select(
        *keys, F.col("_local").alias(island), *partial
    )
    return (
        closed.unionByName(joined)
        .groupBy(*keys, island)
        .agg(*(c.alias(n) for n, c in merge.items()))
    )


def sessions(
    df: DataFrame,
    keys: list[str],
    position: Column,
    horizon: int,
    width: int,
    fields: list[str],
    opens: Callable[[Column], Column],
    values: Callable[[Column], dict[str, Column]],
    partial: dict[str, Column],
    merge: dict[str, Column],
    tie: tuple[str, ...] = (),
    island: str = "island",
) -> DataFrame:
    """Islands whose rows are linked only when at most `horizon` apart; one full shuffle.

    `position` is a long (microseconds, bytes). Rows within `horizon` of the end of a slice
    are repeated in the next slice as context, so every row sees the row it may be linked to.
    `opens(prev)` decides whether a row starts an island, `values(prev)` adds row columns
    (prev is null when the row starts one), `partial`/`merge` aggregate as in `islands`.
    """
    assert horizon <= width
    at = F.floor(F.col("_pos") / F.lit(width))
    near_end = F.col("_pos") >= (at + 1) * width - horizon
    copies = F.when(near_end, F.array(at, at + 1)).otherwise(F.array(at))
    spread = (
        df.withColumn("_pos", position)
        .withColumn(SLICE, F.explode(copies))
        .withColumn("_own", F.col(SLICE) == at)
    )
    inner = Window.partitionBy(*keys, SLICE).orderBy("_pos", *tie)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = spread.withColumn("_prev", F.lag(F.struct(*fields)).over(inner))
    first = F.col("_prev").isNull() | opens(F.col("_prev"))
    linked = (
        linked.withColumn("_opens", F.when(F.col("_own") & first, F.col("_pos")))
        .withColumn("_local", F.max("_opens").over(upto))
        .where("_own")
        .withColumn("prev", F.when(F.col("_opens").isNull(), F.col("_prev")))
    )
    linked = linked.withColumns(values(F.col("prev")))
    parts = linked.groupBy(*keys, SLICE, "_local").agg(*(c.alias(n) for n, c in partial.items()))
    last_open = parts.groupBy(*keys, SLICE).agg(F.max("_local").alias("_lo"))
    before = (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = last_open.select(*keys, SLICE, F.max("_lo").over(before).alias("_carry"))
    # at most one part without an opening row per (key, slice)
    open_parts = parts.where(F.col("_local").isNull()).drop("_local")
    continued = null_safe_join(open_parts, carry, [*keys, SLICE]).select(
        *keys, F.col("_carry").alias(island), *partial
    )
    closed = parts.where(F.col("_local").isNotNull()).select(
        *keys, F.col("_local").alias(island), *partial
    )
    return (
        closed.unionByName(continued)
        .groupBy(*keys, island)
        .agg(*(c.alias(n) for n, c in merge.items()))
    )


def island_rows(
    df: DataFrame,
    keys: list[str],
    seq: str,
    fields: list[str],
    starts: Callable[[Column], Column],
    slice_by: Column,
    island: str = "island",
) -> DataFrame:
    """Rows labelled with the `seq` of the first row of their island (keys must not be null).

    The rows stay partitioned by (keys, slice); only one resolved row per slice joins in.
    """
    marked = _mark(df, keys, seq, fields, starts, slice_by)
    heads = _resolve_heads(marked, keys, seq, fields, starts)
    return (
        marked.join(heads, [*keys, SLICE], "left")
        .withColumn(island, F.coalesce("_local", "_resolved"))
        .select(*df.columns, island)
    )


def running_rank(
    df: DataFrame, keys: list[str], order: list[str], slice_by: Column, name: str = "rank"
) -> DataFrame:
    """1-based position of each row within its key, via per-slice counts and prefix sums."""
    inner = Window.partitionBy(*keys, SLICE).orderBy(*order)
    base = df.withColumn(SLICE, slice_by)
    counts = base.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys, SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = base.withColumn("_local", F.row_number().over(inner))
    return null_safe_join(local, offsets, [*keys, SLICE]).select(
        *df.columns, (F.col("_local") + F.col("_before")).alias(name)
    )


def running_max(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    slice_by: Column,
    name: str,
    strict: bool = False,
) -> DataFrame:
    """Largest `value` of the rows up to each row (before it, when `strict`) within its key."""
    inner = Window.partitionBy(*keys, SLICE).orderBy(*order)
    frame = inner.rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    base = df.withColumn(SLICE, slice_by)
    tops = base.groupBy(*keys, SLICE).agg(F.max(value).alias("_top"))
    before = (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = tops.select(*keys, SLICE, F.max("_top").over(before).alias("_carry"))
    local = base.withColumn("_local", F.max(value).over(frame))
    return null_safe_join(local, carry, [*keys, SLICE]).select(
        *(c for c in df.columns if c != name), F.greatest("_local", "_carry").alias(name)
    )


def next_after(
    df: DataFrame, keys: list[str], at: str, interval: float, slice_width: float
) -> DataFrame:
    """Positions visited when each visit is the first one at least `interval` past the last.

    Returns the distinct `keys` and `at` (as double) of the visited rows. The walk depends on
    the visit before, so each slice is walked for every position it could be entered at (those
    within its first interval), the walks are chained over the slices of a key, and a last
    pass emits the true walk. A group is one slice, or the few exits of each slice of a key.
    """
    assert slice_width >= interval
    schema = df.schema
    types = ", ".join(f"{k} {schema[k].dataType.simpleString()}" for k in keys)
    cut = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias(at)).withColumn(
        SLICE, F.floor(F.col(at) / F.lit(float(slice_width)))
    )
    parts = [*keys, SLICE]

    def walk(pos: list[float], i: int) -> Iterator[int]:
        while i < len(pos):
            yield i
            i = bisect_left(pos, pos[i] + interval, i)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_groups(batches, parts):
            place = rows.column(at).to_numpy()
            of, upto, due = [], [], []
            for a, b in pairwise(bounds):
                pos = np.unique(place[a:b]).tolist()
                last = min(len(pos) - 1, bisect_left(pos, pos[0] + interval))
                exits = [pos[deque(walk(pos, e), maxlen=1)[0]] + interval for e in range(last + 1)]
                # walks soon run together: one row per run of entries with the same exit
                for e in range(last + 1):
                    if e == last or exits[e] != exits[e + 1]:
                        of.append(a)
                        upto.append(pos[e])
                        due.append(exits[e])
            yield _beside(rows, parts, of, {"upto": upto, "due": due})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_groups(batches, keys):
            slices, upto, exits = (rows.column(c).to_pylist() for c in (SLICE, "upto", "due"))
            of, entry = [], []
            for a, b in pairwise(bounds):
                due = -np.inf
                while a < b:
                    end = bisect_right(slices, slices[a], a, b)
                    k = bisect_left(upto, due, a, end)
                    if k < end:
                        of.append(a)
                        entry.append(due)
                        due = exits[k]
                    a = end
            yield _beside(rows, parts, of, {"entry": entry})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_groups(batches, parts):
            place, entry = (rows.column(c).to_numpy() for c in (at, "entry"))
            of, seen = [], []
            for a, b in pairwise(bounds):
                pos = np.unique(place[a:b]).tolist()
                visited = [pos[i] for i in walk(pos, bisect_left(pos, entry[a]))]
                of += [a] * len(visited)
                seen += visited
            yield _beside(rows, keys, of, {at: seen})

    def over(rows: DataFrame, by: list[str], order: list[str], run: Callable, schema: str) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*order).mapInArrow(run, schema)

    possible = over(cut, parts, parts, entries, f"{types}, {SLICE} BIGINT, upto DOUBLE, due DOUBLE")
    actual = over(possible, keys, [*parts, "upto"], chain, f"{types}, {SLICE} BIGINT, entry DOUBLE")
    return over(null_safe_join(cut, actual, parts), parts, parts, emit, f"{types}, {at} DOUBLE")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by `names` as tables of whole groups, with the bounds of the groups.

    A batch holds many groups, so that a small one costs no table of its own.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if held[0] is not batch and all(held[0].column(n)[0] == batch.column(n)[-1] for n in names):
            continue  # still one group
        rows, first = _first_rows(held, names)
        if len(first) > 1:
            yield rows.slice(0, first[-1]), first
        held = rows.slice(first[-1]).to_batches()
    if held:
        rows, first = _first_rows(held, names)
        yield rows, [*first, rows.num_rows]


def _first_rows(held: list[pa.RecordBatch], names: list[str]) -> tuple[pa.Table, list[int]]:
    rows = pa.Table.from_batches(held).combine_chunks()
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for n in names:
        code = rows.column(n).combine_chunks().dictionary_encode(null_encoding="encode").indices
        new[1:] |= np.diff(code.to_numpy()) != 0
    return rows, np.flatnonzero(new).tolist()


def _beside(rows: pa.Table, names: list[str], of: list[int], values: dict[str, list[float]]) -> pa.RecordBatch:
    """`values` beside columns of the rows they belong to."""
    kept = rows.select(names).take(pa.array(of, pa.int64())).combine_chunks()
    columns = [pa.concat_arrays(kept.column(n).chunks) if kept.num_rows else pa.array([], kept.schema.field(n).type) for n in names]
    columns += [pa.array(v, pa.float64()) for v in values.values()]
    return pa.RecordBatch.from_arrays(columns, [*names, *values])


def overlap_clusters(
    df: DataFrame, keys: list[str], start: str, end: str, slice_by: Column, name: str = "cluster"
) -> DataFrame:
    """Label intervals by runs in which each one overlaps something before it.

    A row that starts at or after every earlier end depends on none of them, so the runs can
    be folded apart.
    """
    order = [start, end]
    seen = running_max(df, keys, order, end, slice_by, "_reach", strict=True)
    marked = seen.withColumn(
        "_open",
        F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), F.col(start)),
    )
    return running_max(marked, keys, order, "_open", slice_by, name).drop("_reach", "_open")


def value_at_rank(
    df: DataFrame, keys: list[str], value: str, ranks: DataFrame, bin_width: float
) -> DataFrame:
    """Exact order statistics per key without sorting a key in one task.

    `ranks` holds the keys and a 1-based `rank` (one or several rows per key). Values are
    counted (map-side combined), counts are summed per bin of `bin_width`, the bin holding
    the rank is found from the bin totals, and only the distinct values of that bin are
    ordered. Returns keys, rank, `value`.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    binned = counted.withColumn("_bin", F.floor(F.col(value) / F.lit(bin_width)))
    totals = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.select(
        *keys, "_bin", "_bn", F.coalesce(F.sum("_bn").over(upto), F.lit(0)).alias("_lo")
    )
    hit = (
        null_safe_join(ranks.select(*keys, "rank"), spans, keys)
        .where((F.col("rank") > F.col("_lo")) & (F.col("rank") <= F.col("_lo") + F.col("_bn")))
        .select(*keys, "_bin", "_lo", "rank")
    )
    cand = null_safe_join(hit, binned, [*keys, "_bin"]).select(
        *keys, "rank", "_lo", value, "_n"
    )
    within = Window.partitionBy(*keys, "rank").orderBy(value)
    upto_value = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cand.withColumn("_hi", F.col("_lo") + F.sum("_n").over(upto_value))
        .where((F.col("_hi") >= F.col("rank")) & (F.col("_hi") - F.col("_n") < F.col("rank")))
        .select(*keys, "rank", F.col(value).alias("value"))
    )
