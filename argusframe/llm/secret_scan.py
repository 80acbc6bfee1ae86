"""Secrets by pattern and by inferred format.

Patterns find the known kinds. The values they find label a grammar inference: per kind a prefix
tree over character classes is built from a bounded sample of values, and states whose futures
are statistically alike (Hoeffding bounds on ending and on every class) are merged into a
probabilistic automaton; one more is inferred from unlabelled runs. Every remaining run of
credential characters is then a secret if its format is far likelier under a credential automaton.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from argusframe.llm.words import with_text

#: Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Anything that can be a credential: every access or hex match lies inside one such run.
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
STEMS = ("passw", "secret", "token", "api")

#: Bounds of the fitted sample: distinct values per kind, and symbols of a value.
SAMPLE = 600
LONGEST = 128
#: Confidence of the merge test, and the log odds at which a run is a secret.
ALPHA = 0.01
ODDS = 9.0

_CLASS = {c: "d" for c in "0123456789"}
_CLASS |= {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
_CLASS |= {c: "H" for c in "ABCDEF"} | {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS |= {c: c for c in "+/_.=-"}
CLASSES = "".join(sorted(set(_CLASS.values())))
#: Characters of each class, so that two automata are compared on the characters themselves.
_SIZE = {k: sum(v == k for v in _CLASS.values()) for k in CLASSES}


def classes(value: str) -> str:
    return "".join(_CLASS[c] for c in value)


class Automaton:
    """A probabilistic automaton: per state, passes, endings and (class -> state, passes)."""

    def __init__(self, words: dict[str, int], alpha: float = ALPHA):
        self.n, self.end, self.go = [0], [0], [{}]
        self.uses: list[dict[str, int]] = [{}]
        for word, times in words.items():
            self._add(word, times)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _add(self, word: str, times: int) -> None:
        at = 0
        self.n[0] += times
        for c in word:
            if c not in self.go[at]:
                self.go[at][c] = len(self.n)
                self.n.append(0)
                self.end.append(0)
                self.go.append({})
                self.uses.append({})
            self.uses[at][c] = self.uses[at].get(c, 0) + times
            at = self.go[at][c]
            self.n[at] += times
        self.end[at] += times

    def _alike(self, a: int, b: int) -> bool:
        """Whether no frequency of the two states, or of states after them, differs too much."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.n[a], self.n[b]
            if min(na, nb) < 8:
                continue
            gap = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.end[a] / na - self.end[b] / nb) > gap:
                return False
            for c in self.uses[a].keys() | self.uses[b].keys():
                ua, ub = self.uses[a].get(c, 0), self.uses[b].get(c, 0)
                if abs(ua / na - ub / nb) > gap:
                    return False
                if ua and ub:
                    todo.append((self.go[a][c], self.go[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree to a state and the states after it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, target in self.go[b].items():
                self.uses[a][c] = self.uses[a].get(c, 0) + self.uses[b][c]
                if c in self.go[a]:
                    todo.append((self.go[a][c], target))
                else:
                    self.go[a][c] = target

    def _infer(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [
                (self.n[t], -t, s, c)
                for s in red
                for c, t in self.go[s].items()
                if t not in known
            ]
            if not blue:
                break
            _, neg, source, symbol = max(blue)
            for r in red:
                if self._alike(r, -neg):
                    self.go[source][symbol] = r
                    self._fold(r, -neg)
                    break
            else:
                red.append(-neg)
        number = {s: i for i, s in enumerate(red)}
        steps, stop = [], []
        for s in red:
            total = self.n[s] + 0.5 * (len(CLASSES) + 1)
            steps.append(
                {
                    c: (
                        math.log((self.uses[s].get(c, 0) + 0.5) / total / _SIZE[c]),
                        number.get(self.go[s].get(c, 0), 0),
                    )
                    for c in CLASSES
                }
            )
            stop.append(math.log((self.end[s] + 0.5) / total))
        self.steps, self.stop = steps, stop
        del self.n, self.end, self.go, self.uses

    def log_likelihood(self, word: str) -> float:
        at, total = 0, 0.0
        for c in word:
            p, at = self.steps[at][c]
            total += p
        return total + self.stop[at]


def base_matches(text: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Pattern matches as (start, kind, end, start of the value), and all credential runs."""
    found = []
    small = text.lower()
    if any(s in small for s in STEMS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), 0, m.end(), m.start(2)))
    runs = [m.span() for m in RUN.finditer(text)]
    for a, b in runs:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text, a, b)]
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text, a, b)]
    found.sort()
    return found, runs


def _candidates(text: str, found: list, runs: list) -> Iterator[tuple[int, int]]:
    """Runs with a digit and a letter that touch no pattern match, without closing dots."""
    for a, b in runs:
        while b > a and text[b - 1] in ".-":
            b -= 1
        if b - a < 16 or not MIXED.match(text, a, b):
            continue
        if not any(s < b and a < e for s, _, e, _ in found):
            yield a, b


SPAN = "array<struct<kind:string,start:long,end:long,value_start:long,log_odds:double>>"
_SPAN_TYPE = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("value_start", pa.int64()), ("log_odds", pa.float64()),
        ]
    )
)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for at in range(0, batch.num_rows, 128):
        part = batch.slice(at, 128)
        column = part.column(part.schema.get_field_index("text"))
        yield part, [t or "" for t in column.to_pylist()]


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[int, str], int] = {}
        for _, texts in _texts(batch):
            for text in texts:
                found, runs = base_matches(text)
                for _, kind, end, start in found:
                    if end - start <= LONGEST:
                        key = (kind, text[start:end])
                        seen[key] = seen.get(key, 0) + 1
                for a, b in _candidates(text, found, runs):
                    if b - a <= LONGEST:
                        key = (3, text[a:b])
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in seen], pa.int32()),
                pa.array([v for _, v in seen], pa.string()),
                pa.array(list(seen.values()), pa.int64()),
            ],
            ["kind", "value", "n"],
        )


def labelled_values(documents: DataFrame) -> DataFrame:
    """(kind, value, n): every distinct pattern value and unlabelled run of the whole corpus."""
    found = documents.select("text").mapInArrow(_values, "kind int, value string, n long")
    return found.groupBy("kind", "value").agg(F.sum("n").alias("n"))


def infer(values: DataFrame) -> dict[str, Automaton]:
    """One automaton per kind from its SAMPLE distinct values least in hash."""
    least = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    rows = values.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= SAMPLE)
    words: dict[int, dict[str, int]] = {}
    for r in rows.select("kind", "rank", "value").orderBy("kind", "rank").collect():
        own, form = words.setdefault(r["kind"], {}), classes(r["value"])
        own[form] = own.get(form, 0) + 1
    automata = {KINDS[k]: Automaton(own) for k, own in words.items()}
    return automata


def _scan(
    batches: Iterator[pa.RecordBatch], automata: dict[str, Automaton]
) -> Iterator[pa.RecordBatch]:
    plain = automata.get("format")
    known = [a for k, a in automata.items() if k != "format"]
    for batch in batches:
        for part, texts in _texts(batch):
            rows = []
            for text in texts:
                found, runs = base_matches(text)
                spans = [(s, k, e, v, None) for s, k, e, v in found]
                for a, b in _candidates(text, found, runs) if plain and known else ():
                    form = classes(text[a:b])
                    odds = max(m.log_likelihood(form) for m in known) - plain.log_likelihood(form)
                    if odds >= ODDS:
                        spans.append((a, 3, b, a, odds))
                spans.sort(key=lambda s: s[:2])
                rows.append(
                    [
                        {"kind": KINDS[k], "start": s, "end": e, "value_start": v, "log_odds": o}
                        for s, k, e, v, o in spans
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(rows, _SPAN_TYPE)], [*part.schema.names, "_spans"]
            )


def scan(
    documents: DataFrame,
    automata: dict[str, Automaton] | None = None,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """`keep` columns and `_spans`: kind, code-point bounds, start of the value, log odds.

    Null or empty text: no spans. Empty table: no rows, nothing inferred. Repeated rows: each is
    scanned. Where no pattern occurs in the corpus there is no label, and so no format span.
    """
    if automata is None:
        automata = infer(labelled_values(documents))
    wanted = list(dict.fromkeys((*keep, "text")))
    rows = documents.select(*wanted)
    schema = T.StructType(list(rows.schema.fields)).add("_spans", T.DataType.fromDDL(SPAN))
    scanned = rows.mapInArrow(partial(_scan, automata=automata), schema)
    return scanned.select(*keep, "_spans")


def digest(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(documents: DataFrame, automata: dict[str, Automaton] | None = None) -> DataFrame:
    """Documents with the value of every secret replaced by [REDACTED], all rows kept."""
    if automata is None:
        automata = infer(labelled_values(documents))
    whole = documents.select(F.struct("*").alias("whole"), "text")
    found = scan(whole, automata, ("whole", "text"))

    def put(state: Column, span: Column) -> Column:
        start = F.greatest(span["value_start"], state["at"])
        text = F.when(
            span["end"] > state["at"],
            F.concat(
                state["out"],
                F.substring(F.col("text"), state["at"].cast("int") + 1, (start - state["at"]).cast("int")),
                F.lit("[REDACTED]"),
            ),
        ).otherwise(state["out"])
        return F.struct(text.alias("out"), F.greatest(span["end"], state["at"]).alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        "_spans", zero, put,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"].cast("int") + 1, F.length("text"))),
    )
    text = F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))
    return with_text(found.withColumn("text", text), documents.columns)
