"""Byte-level BPE by forced-boundary splitting.

A merge only ever makes a token of the vocabulary, so two neighbouring bytes that stand next to
each other inside no token can never end up in one: between them a cut is certain. Texts are cut
at special tokens, at the vocabulary's own word pattern and then at every such byte pair; the
fragments are merged independently, remembered, and their ids concatenated.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

#: Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same words, for texts of ASCII and Latin letters only, where `re` has no other classes.
USUAL_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
USUAL = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")
REMEMBERED = 200_000
PIECE_CHARS = 1 << 18
LONG = 40
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges, token bytes and the certain cuts of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = byte_letters()
        value = {c: b for b, c in enumerate(letter)}
        ids = spec["model"]["vocab"]
        self.of_byte = [ids[c] for c in letter]
        self.token: dict[int, bytes] = {i: bytes(value[c] for c in s) for s, i in ids.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        joined = np.zeros((256, 256), bool)
        for t in self.token.values():
            for a, b in pairwise(t):
                joined[a, b] = True
        self.cut = ~joined
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.token[i] = s.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")
        self.words = regex.compile(PATTERN).findall
        self.unusual = USUAL.search
        self.usual_words = re.compile(USUAL_PATTERN).findall
        self.byte_ids = np.asarray(self.of_byte, np.int64)
        pairs = sorted((a << 32 | b, rank, made) for (a, b), (rank, made) in self.merge.items())
        self.pair_key, self.pair_rank, self.pair_made = np.array(pairs, np.int64).T.copy()
        self.known: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed. All fragments are merged side by side, one merge a round."""
        text = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(word) > 0) | self.cut[text[:-1], text[1:]]
        part, ids = np.cumsum(new), self.byte_ids[text]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(text))
        keep = np.ones(len(ids), bool)
        for n in np.flatnonzero(size > LONG).tolist():
            at = slice(first[n], first[n] + size[n])
            out = self._merged_long(ids[at].tolist())
            keep[at] = False
            keep[first[n] : first[n] + len(out)] = True
            ids[first[n] : first[n] + len(out)] = out
        done = (size > LONG)[part - 1]
        ids, part, word, done = ids[keep], part[keep], word[keep], done[keep]
        rank, made = self._pairs(ids, part, np.arange(len(ids)))
        rank[done] = _NEVER
        while len(ids):
            first = np.flatnonzero(np.diff(part, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(ids))
            at = np.flatnonzero((rank == np.repeat(least, size)) & (rank < _NEVER))
            if not len(at):
                break
            at = at[np.diff(part[at], prepend=-1) > 0]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            ids, part, word = ids[keep], part[keep], word[keep]
            rank, made = rank[keep], made[keep]
            changed = np.concatenate((at, at[at > 0] - 1))
            rank[changed], made[changed] = self._pairs(ids, part, changed)
        bounds = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[i:j] for i, j in pairwise(bounds)]

    def _pairs(
        self, ids: np.ndarray, part: np.ndarray, at: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of each chosen id with the next one, if there is one."""
        last = len(ids) - 1
        after = np.minimum(at + 1, last)
        key = (ids[at] << 32) | ids[after]
        place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = (self.pair_key[place] == key) & (part[at] == part[after]) & (at < last)
        return np.where(found, self.pair_rank[place], _NEVER), self.pair_made[place]

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for long fragments: a heap of merges over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in ids if t >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit values."""
        cut = []
        for t in texts:
            find = self.words if self.unusual(t) else self.usual_words
            cut.append([(s, find(plain)) for s, plain in self._parts(t)])
        new = {w for parts in cut for _, words in parts for w in words} - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            new = {w for parts in cut for _, words in parts for w in words}
            self.known.clear()
        ordered = list(new)
        self.known.update(zip(ordered, self.merged([w.encode() for w in ordered]), strict=True))
        find, out = self.known.__getitem__, []
        for parts in cut:
            out.append(
                b"".join(
                    b"".join(map(find, words)) if s is None else s.to_bytes(4, "little")
                    for s, words in parts
                )
            )
        for w in ordered:
            if len(w) > 256:
                del self.known[w]
        return out

    def _parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        at = 0
        for m in self.special_at.finditer(text):
            if m.start() > at:
                yield None, text[at : m.start()]
            yield self.special[m.group()], ""
            at = m.end()
        if at < len(text):
            yield None, text[at:]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _replace(batch: pa.RecordBatch, name: str, old: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(old)
    columns, names = list(batch.columns), list(batch.schema.names)
    columns[at], names[at] = values, name
    return pa.RecordBatch.from_arrays(columns, names)


def _some(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows of a batch, some at a time, with the values of one column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + PIECE_CHARS, "right")))
        part = batch.slice(at, end - at)
        yield part, part.column(part.schema.get_field_index(name)).to_pylist()
        at = end


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        for part, texts in _some(batch, "text"):
            packed = v.encode([t or "" for t in texts])
            yield _replace(part, "tokens", "text", pa.array(packed, pa.binary()))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        for part, packed in _some(batch, "tokens"):
            texts = [v.decode(np.frombuffer(t or b"", "<u4")) for t in packed]
            columns, names = [*part.columns, pa.array(texts, pa.string())], part.schema.names
            yield pa.RecordBatch.from_arrays(columns, [*names, "decoded"])


def encode(documents: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every whole text, as `tokens`: little-endian unsigned 32-bit values.

    path: a vocabulary file that every machine has. Special tokens in a text become their ids.
    Null or empty text: no tokens. Empty table: no rows. Repeated rows: encoded each. keep: the
    columns carried along; any other column is left out.
    """
    rows = documents.select(*keep, "text")
    schema = T.StructType(rows.schema.fields[:-1]).add("tokens", "binary")
    return rows.mapInArrow(partial(_encode, path=path), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`, the text of `tokens`; ill-formed byte sequences become U+FFFD."""
    schema = T.StructType(list(encoded.schema.fields)).add("decoded", "string")
    return encoded.mapInArrow(partial(_decode, path=path), schema)
