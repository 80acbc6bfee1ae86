"""Toxicity of texts whose words may be disguised.

A noisy channel undoes the disguise: a suspicious word becomes a lattice of what each of its
characters may stand for (itself, the letter a digit or symbol imitates, nothing for a separator
or a repeated letter), and Viterbi picks the path likeliest under a character trigram model
counted over the whole corpus. A logistic model then scores the restored words of the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from argusframe.llm.words import pieces
from argusframe.sources.session import materialize

#: The letters that digits and symbols imitate.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
}
#: Costs, in nats, of each thing the channel may do to a letter.
SWAP, DROP, DROP_DIGIT, REPEAT, LITERAL = 0.2, 3.0, 8.0, 0.3, 6.0
#: Bounds of the fitted sample: documents of each label; features of the model.
SAMPLE_TOXIC, SAMPLE_CLEAN, FEATURES = 6000, 9000, 20_000
#: Least likelihood ratio statistic of a feature.
EVIDENCE = 20.0
REMEMBERED = 150_000

A = 28  # boundary, a-z, any other letter
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27

EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET) + "¿¡«»…“”"
DECOR = re.compile(r"([^\w\s])\1\1+$|^([^\w\s])\2\2+")
SUSPECT = re.compile(r"[0-9@$!|+(<€]|(\w)\1\1|^\w(?:[^\w\s]\w){2,}")
SPACED = re.compile(r"(?<!\S)(?:[^\s|](?: [^\s|]){3,})(?!\S)")
LETTER = re.compile(r"[^\W\d_]")


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(A**3, np.int64)
    for batch in batches:
        for p in pieces(batch.column(0)):
            c = _CLASS[p.data]
            c = np.concatenate(([0, 0], c, [0]))
            keep = np.ones(len(c), bool)
            keep[1:] = (c[1:] != 27) | (c[:-1] != 27)  # a letter of several bytes counts once
            keep[1:] &= (c[1:] != 0) | (c[:-1] != 0)
            c = c[keep]
            total += np.bincount(c[:-2] * A * A + c[1:-1] * A + c[2:], minlength=A**3) if len(c) > 2 else 0
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["gram", "n"])


def letter_model(documents: DataFrame) -> np.ndarray:
    """Log probability of each letter after two others, from the trigrams of all texts."""
    grams = documents.select("text").mapInArrow(_letter_counts, "gram long, n long")
    counts = np.zeros(A**3)
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most A**3 rows
        counts[r["gram"]] = r["n"]
    tri = counts.reshape(A, A, A)
    bi = tri.sum(0)
    uni = (bi.sum(0) + 1) / (bi.sum() + A)
    after = (bi + 20 * uni) / (bi.sum(1, keepdims=True) + 20)
    return np.log((tri + 5 * after[None]) / (tri.sum(2, keepdims=True) + 5))


@dataclass
class Restorer:
    """Viterbi decoding of disguised words under a letter model."""

    model: np.ndarray
    table: list = field(init=False)

    def __post_init__(self) -> None:
        self.table = self.model.reshape(-1).tolist()

    @staticmethod
    def _class(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """What each character may stand for, with costs."""
        steps = []
        run = 0
        for i, c in enumerate(token):
            run = run + 1 if i and c == token[i - 1] else 1
            stretched = token[i - run + 1 : i + 4 - run] == 3 * c
            if stretched and run > 2:
                options = [("", 0.0)]
            elif c.isalpha():
                options = [(c, 0.0)]
            else:
                options = [(x, SWAP) for x in LEET.get(c, "")]
                options.append(("", DROP_DIGIT if c.isdigit() else DROP))
                if c.isdigit():
                    options.append((c, LITERAL))
            if stretched and run == 2:
                options.append(("", REPEAT))
            steps.append(options)
        return steps

    def restore(self, token: str) -> str:
        table = self.table
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(token):
            best: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in paths.items():
                for c, cost in options:
                    if c == "":
                        state, value, out = (a, b), score - cost, text
                    else:
                        k = self._class(c)
                        value = score - cost + table[(a * A + b) * A + k]
                        state, out = (b, k), text + c
                    if state not in best or best[state][0] < value:
                        best[state] = (value, out)
            paths = best
        return max((s + table[(a * A + b) * A], t) for (a, b), (s, t) in paths.items())[1]

    def word(self, token: str) -> str:
        """The restored form of one word without white space, in lower case."""
        token = DECOR.sub("", token.strip(EDGE))
        if SUSPECT.search(token) and LETTER.search(token):
            return self.restore(token)
        return token.strip("!|$+(<")

    def spaced(self, text: str) -> list[str]:
        """Words written letter by letter with blanks between."""
        return [self.restore(m.group().replace(" ", "")) for m in SPACED.finditer(text)]


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k)] if word else []


def document_features(restorer: Restorer, text: str) -> set[str]:
    small = text.lower()
    restored = {restorer.word(w) for w in set(small.split())}
    restored.update(restorer.spaced(small))
    return {f for w in restored for f in features(w)}


def _feature_counts(
    batches: Iterator[pa.RecordBatch], model: np.ndarray
) -> Iterator[pa.RecordBatch]:
    restorer = Restorer(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200).to_pydict()
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                for f in document_features(restorer, text or ""):
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(seen), pa.string()),
                    pa.array([v[0] for v in seen.values()], pa.int64()),
                    pa.array([v[1] for v in seen.values()], pa.int64()),
                ],
                ["feature", "clean", "toxic"],
            )


def _chosen(
    batches: Iterator[pa.RecordBatch], model: np.ndarray, number: dict[str, int]
) -> Iterator[pa.RecordBatch]:
    restorer = Restorer(model)
    for batch in batches:
        part = batch.to_pydict()
        found = [
            sorted(number[f] for f in document_features(restorer, t or "") if f in number)
            for t in part["text"]
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part["toxic"], pa.int32()), pa.array(found, pa.list_(pa.int32()))],
            ["toxic", "found"],
        )


@dataclass
class ToxicityModel:
    letters: np.ndarray
    weights: dict[str, float]
    bias: float


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounded sample (text, toxic) of labelled training documents, least in hash per label.

    A label that is not 0 or 1 is none; a document with both counts as toxic.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = own.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC)
    chosen = chosen.unionByName(own.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))
    # the sample has at most SAMPLE_TOXIC + SAMPLE_CLEAN ids, so every machine can hold it
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _evidence(toxic: Column, clean: Column, pos: int, neg: int) -> Column:
    """Likelihood ratio statistic of a feature against independence of the label."""

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    total = F.lit(float(pos + neg))
    present = toxic + clean
    return 2 * (
        part(toxic) + part(clean) + part(pos - toxic) + part(neg - clean) + part(total)
        - part(present) - part(total - present) - part(F.lit(float(pos))) - part(F.lit(float(neg)))
    )


def fit(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Letter model from all texts; features and weights from the labelled sample."""
    letters = letter_model(documents)
    rows = materialize(training_rows(documents, labels))
    counts = rows.mapInArrow(
        partial(_feature_counts, model=letters), "feature string, clean long, toxic long"
    )
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in total}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return ToxicityModel(letters, {}, math.log((pos + 0.5) / (neg + 0.5)))
    top = (
        counts.where(F.col("toxic") + F.col("clean") >= 4)
        .withColumn("evidence", _evidence(F.col("toxic"), F.col("clean"), pos, neg))
        .where(F.col("evidence") >= EVIDENCE)
        .orderBy(F.col("evidence").desc(), "feature").limit(FEATURES).collect()
    )
    if not top:
        return ToxicityModel(letters, {}, math.log((pos + 0.5) / (neg + 0.5)))
    number = {r["feature"]: i for i, r in enumerate(top)}
    found = rows.mapInArrow(
        partial(_chosen, model=letters, number=number), "toxic int, found array<int>"
    ).collect()  # one short list per sampled document
    weights, bias = _logistic([r["found"] for r in found], [r["toxic"] for r in found], len(top))
    return ToxicityModel(letters, dict(zip(number, weights.tolist(), strict=True)), bias)


def _logistic(rows: list[list[int]], labels: list[int], n: int) -> tuple[np.ndarray, float]:
    """L2-regularized logistic regression on present features, full-batch adaptive steps."""
    order = sorted(range(len(rows)), key=lambda i: (labels[i], rows[i]))
    size = np.array([len(rows[i]) for i in order], np.int64)
    at = np.repeat(np.arange(len(order)), size)
    feature = np.array([f for i in order for f in rows[i]], np.int64)
    y = np.array([labels[i] for i in order], float)
    w, bias = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    step, step_bias = np.full(n, 1e-8), 1e-8
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    for _ in range(400):
        z = bias + np.bincount(at, w[feature], len(y))
        error = (1 / (1 + np.exp(-z)) - y) * share
        g = np.bincount(feature, error[at], n) + 1e-5 * w
        g_bias = error.sum()
        step += g * g
        step_bias += g_bias * g_bias
        w -= 0.3 * g / np.sqrt(step)
        bias -= 0.3 * g_bias / math.sqrt(step_bias)
    return w, float(bias)


class Scorer:
    """Scores texts; remembers which features each word has."""

    def __init__(self, model: ToxicityModel):
        self.restorer, self.model = Restorer(model.letters), model
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, token: str) -> tuple[str, ...]:
        weights = self.model.weights
        found = tuple(f for f in features(self.restorer.word(token)) if f in weights)
        if len(token) <= 40:
            self.known[token] = found
        return found

    def score(self, text: str) -> float:
        small = text.lower()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, weights, present = self.known, self.model.weights, set()
        for w in set(small.split()):
            f = known.get(w)
            if f is None:
                f = self._of(w)
            if f:
                present.update(f)
        for w in self.restorer.spaced(small):
            present.update(f for f in features(w) if f in weights)
        z = self.model.bias + sum(weights[f] for f in sorted(present))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            scores = pa.array([scorer.score(t or "") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), scores], ["doc_id", "score"]
            )


def toxicity(
    documents: DataFrame, labels: DataFrame, model: ToxicityModel | None = None
) -> DataFrame:
    """Score and verdict of every document; trained on documents with crc32(doc_id) % 5 != 0.

    Null or empty text: the score of a text without evidence. Null doc_id: scored, never learned
    from, held_out null. Empty table: no rows. Repeated rows: each is scored. No usable label of
    one kind: every score is the prior.
    """
    if model is None:
        model = fit(documents, labels)
    scored = documents.select("doc_id", "text").mapInArrow(
        partial(_score, model=model), "doc_id long, score double"
    )
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
