"""The conversation trie against a plain one."""

import hashlib
import math
import random
import re
import zlib

import pytest

from argusframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int, path int, n int, words string"


def plain_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(p))))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs),
            sum(len(q) == len(p) + 1 for q in below), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "d", 1, 2, 3, "w") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(table).collect()), key=str)


def conversations(seed, n=70):
    rng = random.Random(seed)
    texts = ["", "a", "b c", "d  e\tf", "ü g"]
    rows = []
    for c in rng.sample(range(100), n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"][t % 2 : t % 2 + 1]), rng.choice(texts[:3] if t < 3 else texts)))
    deep = [(t, "user", rng.choice(texts)) for t in range(60)]
    for c, cut in ((200, 60), (220, 60), (240, 45), (241, 58)):
        rows += [(c, *t) for t in deep[:cut]] + [(c, cut, "user", str(c))]
    rows += [(260 + i, t, "user", "same") for i in range(30) for t in range(5)]  # copies
    return rows


@pytest.mark.parametrize("narrow, band", [(1 << 14, 16), (40, 3), (1, 2)])
def test_trie_equals_plain_trie(spark, monkeypatch, narrow, band):
    if narrow == 1:
        rows = conversations(1, 20)[:60]
    else:
        rows = conversations(narrow)
    monkeypatch.setattr(trie, "NARROW", narrow)
    monkeypatch.setattr(trie, "BAND", band)
    assert found(spark, rows) == plain_trie(rows)


def test_a_conversation_over_many_tasks(spark):
    """Keys do not depend on where ranges cut a conversation."""
    rows = [(c, t, "user", f"{t * t % 7}") for c in (3, 43) for t in range(3000)] + [(3, None, "user", "x")]
    parts = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {(r["conv_id"], r["place"]): (r["k1"], r["k2"]) for r in trie.numbered(table).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", parts)
    assert len(got) == 6001
    plain = {}
    for c in (3, 43):
        one = two = 0
        turns = ([(-1, "x")] if c == 3 else []) + [(t, f"{t * t % 7}") for t in range(3000)]
        for i, (_, x) in enumerate(turns, 1):
            h = hashlib.blake2b(b"4:user" + x.encode(), digest_size=16).digest()
            one += int.from_bytes(h[:8], "little") * pow(trie._ONE, i, 1 << 64)
            two += int.from_bytes(h[8:], "little") * pow(trie._TWO, i, 1 << 64)
            plain[(c, i)] = tuple((v + (1 << 63)) % (1 << 64) - (1 << 63) for v in (one, two))
    assert got == plain


def test_bands_cover_all_levels_once():
    rng = random.Random(5)
    for _ in range(300):
        lengths = {rng.randint(0, 60): rng.randint(1, 50) for _ in range(rng.randint(0, 6))}
        narrow, wide = rng.randint(1, 200), rng.randint(1, 9)
        bands = trie.bands(lengths, narrow, wide)
        deepest = max([n for n in lengths if n], default=0)
        assert [d for b in bands for d in range(b.high, b.low, -1)] == list(range(deepest, 0, -1))
        for b in bands:
            turns = sum(n for d in range(b.low + 1, b.high + 1) for size, n in lengths.items() if size >= d)
            assert (turns <= narrow and b.low >= 1) if b.narrow else b.high - b.low <= wide


def test_trie_edges(spark):
    rows = [
        (None, 0, "user", "lost"), (0, 1, None, None), (0, None, "user", "first"), (0, 1, None, None), (0, 1, "a", ""),
        (1, 0, "user", "word " * 60000), (2, 0, "user", "word " * 60000), (21, 5, "user", "x"), (22, 5, "user", "x"),
        (23, 5, "user", "x"), (24, 1, "a", None), (-3, 0, "user", "minus"),
    ]
    assert found(spark, rows) == plain_trie(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
