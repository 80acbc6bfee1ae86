"""Language of texts, word by word, with a linear-chain conditional random field.

Each word is described by its first and last letters, its character n-grams and a lexicon of
short words counted over the corpus; learned transitions tie neighbouring words, so a text may
switch languages. Forward-backward gives every word's distribution over languages; a text gets
the language with the most expected words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from argusframe.llm.words import SPACE, U64, Piece, pieces, span_hash

#: Bounds of the fitted sample (documents per language) and of the lexicon (words per language).
SAMPLE, LEXICON = 300, 2000
#: Longest word of the lexicon, in bytes; it holds function words.
SHORT = 5
TRI, AFFIX = 17, 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"'()")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_LETTER[65:91] = True


@dataclass
class LanguageModel:
    languages: list[str]
    bigram: np.ndarray
    trigram: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexicon_value: np.ndarray
    lexicon_weight: float
    transition: np.ndarray  # scores, from row to column


@dataclass
class Features:
    """Feature numbers of the bytes and words of a piece, the same in fitting and use."""

    bigram: np.ndarray
    trigram: np.ndarray
    first: np.ndarray  # bounds of each word among the bytes kept
    prefix: np.ndarray
    suffix: np.ndarray
    core: np.ndarray  # hash of the word without a closing mark
    short: np.ndarray
    lettered: np.ndarray


def extract(p: Piece) -> Features:
    data = _LOWER[p.data]
    n = len(data)
    solid = ~SPACE[p.data]
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[p.start], tail[p.end - 1] = True, True
    before = np.empty(n, np.uint32)
    before[1:] = data[:-1]
    after = np.empty(n, np.uint32)
    after[:-1] = data[1:]
    before[head], after[tail] = 32, 32
    before, after, here = before[solid], after[solid], data[solid].astype(np.uint32)
    size = p.end - p.start
    first = np.cumsum(size) - size

    def affix(at: np.ndarray) -> np.ndarray:
        code = (at[0] << np.uint32(16)) | (at[1] << np.uint32(8)) | at[2]
        return (code * np.uint32(2654435761)) >> np.uint32(32 - AFFIX)

    last = first + size - 1
    two, three = np.minimum(first + 1, last), np.minimum(first + 2, last)
    prefix = affix([here[first], here[two], here[three]])
    two, three = np.maximum(last - 1, first), np.maximum(last - 2, first)
    suffix = affix([here[three], here[two], here[last]])
    end = p.end - (_MARK[p.data[p.end - 1]] & (size > 1))
    letters = np.concatenate(([0], np.cumsum(_LETTER[p.data], dtype=np.int64)))
    tri = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    return Features(
        (before << np.uint32(8)) | here,
        (tri * np.uint32(2654435761)) >> np.uint32(32 - TRI),
        first, prefix, suffix,
        span_hash(p.data, p.start, end, lower=True),
        end - p.start <= SHORT,
        letters[p.end] > letters[p.start],
    )


def _lexicon_rows(lexicon: np.ndarray, value: np.ndarray, f: Features) -> np.ndarray:
    """Lexicon values of each word, zero where it has none."""
    out = np.zeros((len(f.core), value.shape[1]), np.float32)
    at = np.flatnonzero(f.short)
    if len(lexicon) and len(at):
        place = np.minimum(np.searchsorted(lexicon, f.core[at]), len(lexicon) - 1)
        hit = lexicon[place] == f.core[at]
        out[at[hit]] = value[place[hit]]
    return out


def emissions(m: LanguageModel, f: Features) -> np.ndarray:
    """Score of each word in each language; words without a letter are neutral."""
    if not len(f.first):
        return np.zeros((0, len(m.languages)), np.float32)
    per_byte = m.bigram[f.bigram] + m.trigram[f.trigram]
    score = np.add.reduceat(per_byte, f.first, axis=0)
    score += m.prefix[f.prefix] + m.suffix[f.suffix]
    score += m.lexicon_weight * _lexicon_rows(m.lexicon, m.lexicon_value, f)
    score[~f.lettered] = 0
    return score


def posteriors(
    score: np.ndarray, first: np.ndarray, size: np.ndarray, transition: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences side by side.

    first, size: where each sequence starts in `score` and how long it is. Returns, per word, the
    distribution over languages, the scaled forward values, and the scaled backward values
    times the word's own gain (what a pair of neighbours is weighed by).
    """
    gain = np.exp(score - score.max(1, keepdims=True)) if len(score) else score
    step = np.exp(transition).astype(score.dtype)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")
    forward, backward = np.empty_like(gain), np.ones_like(gain)
    state = None
    for t in range(longest):
        at = first[: active[t]] + t
        state = gain[at] if t == 0 else (state[: active[t]] @ step) * gain[at]
        state /= state.sum(1, keepdims=True)
        forward[at] = state
    back = step.T.copy()
    ahead = np.zeros((0, gain.shape[1]), gain.dtype)
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        at = first[:n] + t
        if n > len(ahead):
            ahead = np.concatenate((ahead, np.ones((n - len(ahead), gain.shape[1]), gain.dtype)))
        ahead = (ahead * gain[at + 1]) @ back
        ahead /= ahead.sum(1, keepdims=True)
        backward[at] = ahead
    both = forward * backward
    return both / both.sum(1, keepdims=True), forward, gain * backward


def _short_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in names]
        for p in pieces(batch.column(batch.schema.get_field_index("text"))):
            f = extract(p)
            of = code[p.row0 : p.row0 + p.rows][p.row]
            for k in range(len(names)):
                parts[k].append(f.core[f.short & f.lettered & (of == k)])
        for k, name in enumerate(names):
            word, n = np.unique(np.concatenate(parts[k] or [np.zeros(0, U64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(word), pa.string()), pa.array(word.view(np.int64)), pa.array(n)],
                ["lang", "word", "n"],
            )


def trainable(documents: DataFrame) -> DataFrame:
    """Documents that may be learned from: labelled, and crc32(doc_id) % 5 != 0."""
    key = F.col("doc_id").cast("string").cast("binary")
    return documents.where(F.col("lang").isNotNull() & (F.crc32(key) % 5 != 0))


def lexicon(documents: DataFrame) -> list:
    """The most frequent short words of each language over all training texts: (lang, word, n)."""
    counts = trainable(documents).select("lang", "text").mapInArrow(
        _short_words, "lang string, word long, n long"
    )
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= LEXICON).collect()


def training_sample(documents: DataFrame) -> list:
    """At most SAMPLE whole documents of each language, least in hash: (lang, text)."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = trainable(documents).select("lang", "doc_id").withColumn("rank", F.row_number().over(order))
    ids = ids.where(F.col("rank") <= SAMPLE).select("doc_id").distinct()
    # SAMPLE ids a language: every machine can hold them
    rows = trainable(documents).select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    return rows.select("doc_id", "lang", "text").collect()


def fit(documents: DataFrame, epochs: int = 3) -> LanguageModel | None:
    """The field fitted on the bounded sample, its lexicon counted over all training texts."""
    rows = sorted(training_sample(documents), key=lambda r: (r["doc_id"], r["lang"], r["text"] or ""))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    words: dict[int, np.ndarray] = {}
    total = np.ones(k)
    for r in lexicon(documents):
        if r["lang"] in number:
            words.setdefault(r["word"], np.zeros(k))[number[r["lang"]]] += r["n"]
            total[number[r["lang"]]] += r["n"]
    lex = np.array(list(words), np.int64).view(U64)
    value = np.array(list(words.values())).reshape(len(lex), k)
    value = np.log((value + 1) / (total + len(lex)))
    value = np.clip(value - value.mean(1, keepdims=True), -4, 4).astype(np.float32)
    order = np.argsort(lex)
    m = LanguageModel(
        languages,
        np.zeros((1 << 16, k), np.float32), np.zeros((1 << TRI, k), np.float32),
        np.zeros((1 << AFFIX, k), np.float32), np.zeros((1 << AFFIX, k), np.float32),
        lex[order], value[order], 0.2, np.zeros((k, k)),
    )
    parts = []
    for p in pieces(pa.array([r["text"] for r in rows], pa.string())):
        parts.append((extract(p), np.array([number[rows[p.row0 + i]["lang"]] for i in p.row], np.int64)))
    rng = np.random.default_rng(7)
    squares = {name: np.full(getattr(m, name).shape, 1e-6, np.float32) for name in ("bigram", "trigram", "prefix", "suffix")}
    square_t, square_l = np.full((k, k), 1e-6), 1e-6
    for _ in range(epochs):
        for i in rng.permutation(len(parts)).tolist():
            f, label = parts[i]
            for batch in _switched(label, rng):
                square_l = _learn(m, f, label, batch, squares, square_t, square_l)
    return m


def _switched(label: np.ndarray, rng: np.random.Generator, length: int = 96, lanes: int = 128) -> Iterator[np.ndarray]:
    """Sequences of word numbers made of runs of 6 to 40 words from anywhere in the sample."""
    n = len(label)
    start = np.concatenate([np.arange(0, n, 24) + int(rng.integers(24))]) % n
    rng.shuffle(start)
    size = rng.integers(6, 41, len(start))
    stream = np.concatenate([np.arange(a, min(a + s, n)) for a, s in zip(start.tolist(), size.tolist(), strict=True)])
    usable = len(stream) // length * length
    for at in range(0, usable, length * lanes):
        yield stream[at : min(at + length * lanes, usable)].reshape(-1, length)


def _learn(m, f: Features, label: np.ndarray, batch: np.ndarray, squares: dict, square_t: np.ndarray, square_l: float) -> float:
    """One adaptive gradient step on a batch of sequences."""
    k = len(m.languages)
    lanes, length = batch.shape
    flat = batch.reshape(-1)
    size = np.diff(f.first, append=len(f.bigram))[flat]
    word = np.repeat(np.arange(len(flat)), size)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    byte = np.repeat(f.first[flat], size) + inside
    lex = _lexicon_rows(m.lexicon, m.lexicon_value, Features(f.bigram, f.trigram, f.first, f.prefix, f.suffix, f.core[flat], f.short[flat], f.lettered[flat]))
    score = np.zeros((len(flat), k), np.float32)
    per_byte = m.bigram[f.bigram[byte]] + m.trigram[f.trigram[byte]]
    score += np.add.reduceat(per_byte, np.cumsum(size) - size, axis=0)
    score += m.prefix[f.prefix[flat]] + m.suffix[f.suffix[flat]] + m.lexicon_weight * lex
    score[~f.lettered[flat]] = 0
    first = np.arange(lanes) * length
    p, forward, ahead = posteriors(score, first, np.full(lanes, length), m.transition)
    y = label[flat]
    error = p.copy()
    error[np.arange(len(flat)), y] -= 1
    error[~f.lettered[flat]] = 0
    error /= lanes
    for name, index, rows in (
        ("bigram", f.bigram[byte], error[word]), ("trigram", f.trigram[byte], error[word]),
        ("prefix", f.prefix[flat], error), ("suffix", f.suffix[flat], error),
    ):
        used, at = np.unique(index, return_inverse=True)
        g = np.stack([np.bincount(at, rows[:, c], len(used)) for c in range(k)], 1).astype(np.float32)
        squares[name][used] += g * g
        getattr(m, name)[used] -= 0.15 * g / np.sqrt(squares[name][used])
    g_lex = float((error * lex).sum())
    square_l += g_lex * g_lex
    m.lexicon_weight -= 0.05 * g_lex / np.sqrt(square_l)
    # expected minus seen transitions
    left = forward.reshape(lanes, length, k)[:, :-1].reshape(-1, k)
    right = ahead.reshape(lanes, length, k)[:, 1:].reshape(-1, k)
    joint = left[:, :, None] * np.exp(m.transition) * right[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    seen = np.zeros((k, k))
    pairs = y.reshape(lanes, length)
    np.add.at(seen, (pairs[:, :-1].reshape(-1), pairs[:, 1:].reshape(-1)), 1)
    g_t = (joint.sum(0) - seen) / lanes
    square_t += g_t * g_t
    m.transition -= 0.1 * g_t / np.sqrt(square_t)
    return square_l


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column(batch.schema.get_field_index("text"))):
            part = batch.slice(p.row0, p.rows)
            texts = part.column(part.schema.get_field_index("text"))
            names: list[str] = ["und"] * p.rows
            score = np.zeros(p.rows)
            if model is not None and len(p.row):
                f = extract(p)
                size = p.word_counts()
                first = np.cumsum(size) - size
                own = size > 0
                post, _, _ = posteriors(emissions(model, f), first[own], size[own], model.transition)
                k = len(model.languages)
                vote = np.stack(
                    [np.bincount(p.row, post[:, c] * f.lettered, p.rows) for c in range(k)], 1
                )
                counted = np.bincount(p.row, f.lettered, p.rows)
                plain = p.per_row(_LETTER[p.data] & (p.data < 128)) > 0
                best = vote.argmax(1)
                share = vote[np.arange(p.rows), best] / np.maximum(counted, 1)
                for i in np.flatnonzero(counted > 0).tolist():
                    if plain[i] or any(c.isalpha() for c in texts[i].as_py()):
                        names[i], score[i] = model.languages[best[i]], min(1.0, share[i])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(score)],
                [*part.schema.names, "_lang_pred", "_score"],
            )


def label(documents: DataFrame, model: LanguageModel | None, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns with `_lang_pred` and `_score` of `text`, by a fitted model."""
    wanted = list(dict.fromkeys((*keep, "text")))
    rows = documents.select(*wanted)
    schema = T.StructType(list(rows.schema.fields)).add("_lang_pred", "string").add("_score", "double")
    out = rows.mapInArrow(partial(_predict, model=model), schema)
    return out.select(*keep, "_lang_pred", "_score")


def predict(
    documents: DataFrame, model: LanguageModel | None = None, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """`keep` columns with `_lang_pred` and `_score`, the share of expected words in that language.

    Null text, or one without a letter: und, 0. Null doc_id or lang: predicted, not learned from.
    No labelled document at all: und for every text. Empty table: no rows. Repeated rows: each is
    predicted. Equal shares: the first language in order. model: fitted on the documents if none.
    """
    return label(documents, fit(documents) if model is None else model, keep)
