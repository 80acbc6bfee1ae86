"""Quality rules with limits learned from the corpus.

Every document gets counts over its whole text. Their distribution is kept per (lang, source)
in log-bucket quantile sketches: a sketch is a set of (bucket, count) rows, two sketches merge by
adding counts, and a quantile is right to within the bucket width (`GAMMA`). Limits are fences
around the quartiles of the own group, joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.llm.words import U64, Piece, mix, pieces, span_hash, windows
from argusframe.sources.session import materialize

GAMMA = 1.02
#: Measures and the widening of their fences: a group without any spread still allows this much.
MEASURES = {"symbol_rate": 0.3, "dup_line_rate": 0.3, "repeat_rate": 0.15, "word_length": 3.0}
#: Quartile distances beyond the quartiles at which a document is an outlier of its group.
REACH = 4.0
MIN_WORDS = 20
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeats(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, value): does it occur more than once, and is there an earlier one."""
    key = mix(value ^ mix(row.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def _lines(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word: how many, and how many equal an earlier one."""
    breaks = np.flatnonzero(p.data == 10)
    start = np.unique(np.concatenate((p.offsets[:-1], breaks + 1)))
    start = start[start < len(p.data)]
    end = np.append(start[1:], len(p.data))[: len(start)]
    end = end - (p.data[end - 1] == 10)
    first = np.searchsorted(p.start, start, "left")
    with_word = first < np.searchsorted(p.start, end, "left")
    start, end = start[with_word], end[with_word]
    row = np.searchsorted(p.offsets, start, "right") - 1
    _, later = _repeats(row, span_hash(p.data, start, end, lower=False))
    return (
        np.bincount(row, minlength=p.rows).astype(np.int64),
        np.bincount(row[later], minlength=p.rows).astype(np.int64),
    )


def _repeat_words(p: Piece) -> np.ndarray:
    value, at = windows(p.hash, p.row, WINDOW)
    twice, _ = _repeats(p.row[at], value)
    depth = np.zeros(len(p.row) + WINDOW + 1, np.int64)
    np.add.at(depth, at[twice], 1)
    np.add.at(depth, at[twice] + WINDOW, -1)
    covered = np.cumsum(depth)[: len(p.row)] > 0
    return np.bincount(p.row[covered], minlength=p.rows).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for p in pieces(texts, lower=False):
            lines, dup_lines = _lines(p)
            word_char = ((p.data & 0xC0) != 0x80) & ~np.isin(p.data, (32, 9, 10, 11, 12, 13))
            columns = {
                "n_words": p.word_counts(),
                "word_chars": p.per_row(word_char),
                "n_symbols": p.per_row(_SYMBOL[p.data]),
                "n_lines": lines,
                "n_dup_lines": dup_lines,
                "n_repeat_words": _repeat_words(p),
            }
            part = batch.slice(p.row0, p.rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "lang", "source")]
                + [pa.array(v) for v in columns.values()],
                ["doc_id", "lang", "source", *columns],
            )


def text_counts(documents: DataFrame) -> DataFrame:
    """Word, symbol, line and repeat counts of every document; one row per row given."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return documents.select("doc_id", "lang", "source", "text").mapInArrow(_count, schema)


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    # one repeated line says nothing about a text of a few lines
    repeated = F.greatest(F.col("n_dup_lines") - 1, F.lit(0))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": repeated / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def sketches(counts: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: (lang, source, measure, bucket, n); bucket null is zero."""
    pairs = F.explode(
        F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in _measures().items()))
    )
    bucket = F.when(
        F.col("m.x") > 0, F.ceil(F.round(F.log(F.col("m.x")) / float(np.log(GAMMA)), 6)).cast("int")
    )
    return (
        counts.where(F.col("n_words") >= MIN_WORDS)
        .select("lang", "source", pairs.alias("m"))
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """One sketch from several, whatever rows each of them was built from."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """Fences per (lang, source): low and high bound of each measure."""
    group = Window.partitionBy("lang", "source", "measure")
    ordered = group.orderBy(F.col("bucket").asc_nulls_first())
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA)
    )
    ranked = sketch.select(
        "*",
        value.alias("value"),
        F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    quartile = {
        f"q{q}": F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("value")))
        for q in (25, 75)
    }
    fences = ranked.groupBy("lang", "source", "measure").agg(
        *(v.alias(k) for k, v in quartile.items())
    )
    slack = F.lit(0.0)
    for name, margin in MEASURES.items():
        slack = F.when(F.col("measure") == name, F.lit(margin)).otherwise(slack)
    spread = REACH * (F.col("q75") - F.col("q25")) + slack
    bounds = fences.select(
        "lang", "source", "measure",
        (F.col("q25") - spread).alias("low"), (F.col("q75") + spread).alias("high"),
    )
    one = [
        F.max(F.when(F.col("measure") == m, F.col(b))).alias(f"{m}_{b}")
        for m in MEASURES
        for b in ("low", "high")
    ]
    return bounds.groupBy("lang", "source").agg(*one)


def quality_rules(documents: DataFrame) -> DataFrame:
    """Counts, the fixed base rule and the adaptive verdict of every document.

    Null text: no words, so the base rule fails. Null lang or source: a group of its own. Empty
    table: no rows. Repeated rows: each is judged and returned. A document passes if no measure
    lies outside the fences of its (lang, source) group, learned from all documents of the group
    with at least MIN_WORDS words.
    """
    counts = materialize(text_counts(documents))
    bounds = limits(sketches(counts))
    bounds = bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(
        bounds,
        counts["lang"].eqNullSafe(bounds["_lang"]) & counts["source"].eqNullSafe(bounds["_source"]),
        "left",
    )
    outlier = F.lit(False)
    for name, x in _measures().items():
        high = F.coalesce(x > F.col(f"{name}_high"), F.lit(False))
        outlier = outlier | high
        if name == "word_length":
            outlier = outlier | F.coalesce(x < F.col(f"{name}_low"), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~outlier).alias("kept"),
        "lang", "source", "n_lines",
    )
