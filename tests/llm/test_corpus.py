"""Search, packing, deduplication, language model and the pipeline against plain versions."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import EDGES, LONG
from argusframe.llm import graph, lm, neardup, packing, recurrent, substrings, topk

# ---------------------------------------------------------------- search


def plain_top(rows, k):
    out = []
    for q, a in rows:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in rows if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 40)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 70)
    monkeypatch.setattr(topk, "BATCH", 16)
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-20, 21, 6)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]  # ties
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 5 == 0, 7).collect())
    assert got == [t for t in plain_top(rows, 7) if t[0] % 5 == 0]


def test_pivots_leave_most_candidates_unseen():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 8)) * 40
    x = np.rint(centre[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 8)))
    pivots = x[:16]
    d = topk._distances(x, pivots)
    ids = np.arange(4000)
    found, scores, evaluated = topk.search_block(ids[:20], x[:20], d[:20], ids, x, d, 10)
    for i in range(20):
        want = sorted((-float(x[i] @ x[j]), j) for j in range(4000) if j != i)[:10]
        assert [(-s, j) for s, j in zip(scores[i], found[i], strict=True)] == want
    assert evaluated < 0.6 * 20 * 4000


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>, rank int, score long, v string"
    rows = [
        (0, [0.5, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]),
        (5, [1.0]), (6, []), (7, [0.5, 1.0]), (7, [0.5, 1.0]), (None, [1.0, 1.0]), (8, [-0.01, 2.0]),
    ]
    raw = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    table = raw.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 8160), (0, 2, 7, 5120), (0, 3, 5, 2048), (0, 4, 6, 0)]
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0, 20).count() == 0


# ---------------------------------------------------------------- packing


def plain_pack(rows, capacity):
    """(rest, doc, source, cluster) longest first, by looking at every bin."""
    bins = []
    for rest, doc, source, cluster in sorted(rows, key=lambda r: (-r[0], r[1])):
        fits = [
            (capacity - b["used"] - rest, i) for i, b in enumerate(bins)
            if b["used"] < capacity and b["used"] + rest <= capacity
            and source not in b["sources"] and cluster not in b["clusters"]
        ]
        if fits:
            b = bins[min(fits)[1]]
        else:
            b = {"used": 0, "sources": set(), "clusters": set(), "docs": []}
            bins.append(b)
        b["docs"].append((doc, b["used"]))
        b["used"] += rest
        b["sources"].add(source)
        b["clusters"].add(cluster)
    return {doc: (i, at) for i, b in enumerate(bins) for doc, at in b["docs"]}


def test_packing_equals_looking_at_every_bin():
    rng = random.Random(3)
    rows = [(rng.randint(1, 60), i, f"s{min(rng.randint(0, 9), 4)}", rng.randint(0, 60)) for i in range(300)]
    frame = pd.DataFrame(
        [(d, s, n, c, n) for n, d, s, c in rows], columns=["doc_id", "source", "n_words", "cluster", "rest"]
    )
    got = packing.pack_rows(frame, 100)
    assert {r.doc_id: (r.bin, r.bin_offset) for r in got.itertuples()} == plain_pack(rows, 100)


def check_places(places, sizes, capacity):
    by_doc, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in places:
        by_doc[r["doc_id"]].append((r["start_word"], r["n_words"]))
        bins[r["shard"], r["bin"]].append((r["bin_offset"], r["n_words"], r["source"]))
    for doc, n in sizes.items():
        at = 0
        for start, size in sorted(by_doc[doc]):
            assert start == at
            at += size
        assert at == n
    for parts in bins.values():
        at = 0
        for offset, size, _ in sorted(parts):
            assert offset >= at
            at = offset + size
        assert at <= capacity
        named = [s for _, _, s in parts if s is not None]
        assert len(named) == len(set(named))


def test_packing_places_every_word_once(docs, words, edges, nothing, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    rows = [(i, words(random.Random(i).randint(0, 250), i), "en", f"s{i % 3 if i % 2 else 0}") for i in range(300)]
    places = packing.pack(docs(rows), 100).collect()
    check_places(places, {i: len((t or "").split()) for i, t, *_ in rows}, 100)
    assert len({r["shard"] for r in places}) > 2
    got = packing.pack(edges, 2048).collect()
    assert sum(r["n_words"] for r in got) == sum(len((r["text"] or "").encode().split()) for r in edges.collect())
    assert packing.pack(nothing).count() == 0


def test_a_shard_of_any_length_is_packed_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 10)
    frame = pd.DataFrame({"doc_id": range(95), "source": ["a"] * 95, "n_words": 5, "cluster": range(95), "rest": 5, "shard": 3})
    out = pd.concat(packing._pack(iter([frame[:33], frame[33:]]), 100))
    assert len(out) == 95 and out["shard"].nunique() == 5


# ---------------------------------------------------------------- near-duplicates


def plain_components(rows, k):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[d] = own
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 999)}" for w in text.split())


@pytest.mark.parametrize("small_bucket", [1, 8])
def test_near_duplicates_equal_all_pairs(docs, words, monkeypatch, small_bucket):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small_bucket)
    base = [words(80, i) for i in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[i % 6], random.Random(i).choice([0.0, 0.02, 0.05, 0.08, 0.2]), i)) for i in range(70)]
    rows += [(300, "Aa bb"), (301, "aA  BB"), (302, "aa"), (303, "AA"), (304, None), (305, ""), (306, "aa bb cc")]
    for k in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(rows), k).collect()}
        assert got == plain_components(rows, k)


def test_near_duplicates_of_edges(docs, edges, nothing):
    got = neardup.near_duplicates(edges, 2).collect()
    assert len(got) == edges.count()
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert by[0, 0] == (0, True) and by[4, 1] == (4, True) and by[6, 1] == (4, False)
    assert by[None, 2] == (None, True)
    assert neardup.near_duplicates(nothing, 2).count() == 0
    # two texts under one doc_id are one document
    two = docs([(1, "a b c d"), (2, "a b c d"), (2, "p q r s"), (3, "p q r s")])
    assert {r["component_id"] for r in neardup.near_duplicates(two, 2).collect()} == {1}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (400, 401), (401, 402), (402, 400)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)} | {400 + i: 400 for i in range(3)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- passages


def test_chains_are_collinear_and_best():
    own = [0, 40, 80, 120, 160, 5000]
    other = [1000, 1040, 300, 1120, 1160, 1200]
    runs = [(a, a, b, b, 1) for a, b in zip(own, other, strict=True)]
    assert substrings.chains(runs)[0] == [0, 1, 3, 4]
    assert [5] in substrings.chains(runs)


def test_chains_score_the_best_of_all_orders():
    rng = random.Random(9)
    for _ in range(80):
        runs = []
        for _ in range(rng.randint(1, 7)):
            a, b, n = rng.randrange(60), rng.randrange(60), rng.randrange(6)
            runs.append((a, a + n, b, b + n, rng.randint(1, 4)))
        cost = 1 / 40

        def score(chain, runs=runs, cost=cost):
            total = sum(runs[m][4] for m in chain)
            for x, y in zip(chain, chain[1:], strict=False):
                gap = runs[y][0] - runs[x][1] + runs[y][2] - runs[x][3]
                total -= cost * gap
            return total

        def follows(x, y, runs=runs):
            return runs[x][1] < runs[y][0] and runs[x][3] < runs[y][2]

        best = max(
            score(c) for n in range(1, len(runs) + 1) for c in itertools.permutations(range(len(runs)), n)
            if all(follows(x, y) for x, y in zip(c, c[1:], strict=False))
        )
        found = substrings.chains(runs, cost, 10**9)
        assert score(found[0]) == pytest.approx(best)
        assert sorted(m for c in found for m in c) == list(range(len(runs)))


def test_fenwick_prefix_maxima_equal_a_scan():
    rng = random.Random(1)
    tree, seen = substrings.PrefixMax(50), {}
    for i in range(300):
        at, value = rng.randrange(50), rng.random()
        tree.add(at, (value, i))
        seen[at] = max(seen.get(at, (-1, -1)), (value, i))
        upto = rng.randrange(51)
        want = max((v for k, v in seen.items() if k < upto), default=(-math.inf, -1))
        assert tree.best(upto) == want


def test_common_words_equal_the_usual_table():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert substrings.common_words(a, b) == row[-1]


def test_shared_passages_are_found_and_taken_out(docs, words, edges, nothing):
    shared, other = words(70, 999), words(90, 998)
    rows = [(i, words(120, i)) for i in range(30)]
    rows += [(100 + i, f"{words(40, 500 + i)} Ünï {shared} {words(60, 600 + i)}") for i in range(12)]
    rows += [(200, other), (201, f"{words(30, 1)} {edited(other, 0.06, 4)} {words(20, 2)}"), (202, words(30, 77) * 1)]
    rows += [(203, f"{words(25, 3)} {' '.join(shared.split()[:25])} {words(25, 4)}")]  # too short a share
    table = docs(rows)
    found = substrings.passages(table).collect()
    assert {r["doc_id"] for r in found} == {101 + i for i in range(11)} | {201}
    assert {r["ref_id"] for r in found} == {100, 200}
    text = dict(rows)
    for r in found:
        assert r["n_words"] >= 50 and r["similarity"] >= 0.8
        if r["ref_id"] == 100:
            assert text[r["doc_id"]][r["start"] : r["end"]].split() == ["Ünï", *shared.split()]
    left = {r["doc_id"]: r["text"] for r in substrings.without_passages(table, substrings.passages(table)).collect()}
    assert set(left) == set(text) and left[100] == text[100] and left[5] == text[5]
    assert sum(" ".join(shared.split()) in " ".join(t.split()) for t in left.values()) == 1
    whole = len(LONG) - 1
    again = docs([*EDGES, (8, LONG), (8, "1 2 3 --"), (9, None)])
    assert [(r["doc_id"], r["start"], r["end"], r["ref_id"], r["similarity"]) for r in substrings.passages(
        again.where("doc_id <> 8 OR text <> '1 2 3 --'")).collect()] == [(8, 0, whole, 5, 1.0)]
    assert substrings.passages(edges).count() == 0
    # of two texts under one doc_id the least is compared, and only that one is cut
    two = docs([(1, LONG), (2, LONG), (2, "z " + LONG)])
    left = substrings.without_passages(two, substrings.passages(two)).collect()
    assert sorted((r["doc_id"], len(r["text"])) for r in left) == [(1, len(LONG)), (2, 1), (2, len(LONG) + 2)]
    assert substrings.passages(nothing).count() == 0


def test_every_long_exact_repeat_of_the_table_is_found(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = collections.defaultdict(list)
    for r in substrings.passages(table).collect():
        found[r["doc_id"]].append((r["start"], r["end"]))
    k, first, texts = 60, {}, {}
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    for d, t in rows:
        w, s, e = substrings._spans(t)
        texts[d] = (w, s, e)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    late = {d for d, (w, _, _) in texts.items() if any(first[tuple(w[i : i + k])] < d for i in range(len(w) - k + 1))}
    assert late and late <= set(found)


def test_alignment_equals_the_length_of_the_common_words(monkeypatch):
    rng = random.Random(12)
    for bits in (1 << 18, 16, 1):
        monkeypatch.setattr(substrings, "TABLE_BITS", bits)
        for _ in range(60):
            a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(0, 30))] for _ in range(2))
            pairs = substrings.matching(a, b)
            assert len(pairs) == substrings.common_words(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_neighbouring_copies_are_passages_of_their_own(docs, words):
    one, two = words(56, 31), words(150, 32)
    rows = [(1, f"{words(40, 33)} {one} {words(30, 34)} {two} {words(40, 35)}")]
    rows += [(2, f"{words(40, 36)} {one} {words(30, 37)} {two} {words(40, 38)}")]
    rows += [(3, f"{words(40, 39)} {words(54, 40)} {words(30, 41)} {words(53, 42)}")]
    rows += [(4, f"{words(20, 43)} {words(54, 40)} {words(30, 44)} {words(53, 42)}")]
    text = dict(rows)
    found = substrings.passages(docs(rows)).orderBy("doc_id", "start").collect()
    assert [r["doc_id"] for r in found] == [2, 2, 4, 4]
    got = [text[r["doc_id"]][r["start"] : r["end"]].split() for r in found]
    for g, want in zip(got, (one, two, words(54, 40), words(53, 42)), strict=True):
        want = want.split()
        assert set(want) <= set(g) and len(g) <= len(want) + 4  # the middle stays out


def test_copies_of_long_words_are_found_whole(docs, words):
    def long(n, seed, letters):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdef/", k=letters)) for _ in range(n))

    rows, want = [], {}
    for i, letters in enumerate((20, 30, 30, 300)):
        shared = long(60 if i < 2 else 200, i, letters)
        rows += [(10 * i + j, f"{long(20, 100 + 10 * i + j, 9)} Ü {shared} {long(20, 200 + 10 * i + j, 9)}") for j in (0, 1)]
        want[10 * i + 1] = f"Ü {shared}"
    text = dict(rows)
    found = substrings.passages(docs(rows)).collect()
    assert {r["doc_id"]: text[r["doc_id"]][r["start"] : r["end"]] for r in found} == want and len(found) == 4
    for r in found:
        assert text[r["ref_id"]][r["ref_start"] : r["ref_end"]] == want[r["doc_id"]]


def test_widening_goes_on_until_words_stop_agreeing():
    own = " ".join(f"word{i}" for i in range(400))
    at = own.index("word200 ")
    place = (200 << 32) | (at << 2)
    for reach in (100, 1500, 9000):
        low = max(0, at - reach)
        part = substrings.Extract(own[low : at + reach], low, len(own))
        got = substrings.align(part, (place, place), part, (place, place), 50, 0.8)
        assert got == ([(0, len(own), 0, len(own), 400, 1.0)] if reach == 9000 else None)


def test_seeds_meet_the_holder_that_agrees_most_whatever_the_batches():
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 9), rng.randint(0, 12), (i << 2) | (i % 5 == 0)) for i in range(300))
    around = {p: [rng.choice([0, 1, 2]) for _ in range(24)] for _, _, p in rows}

    def alike(x, y):
        same = [u == v != 0 for u, v in zip(around[x], around[y], strict=True)]
        return max(sum(same[:12]), sum(same[12:]))

    want = set()
    for s, d, i in rows:
        own = [x for a, b, x in rows if (a, b) == (s, d)]
        before = sorted({b for a, b, _ in rows if a == s and b < d})
        best = None
        for ref in before[:1] + before[-1:]:
            places = [x for a, b, x in rows if (a, b) == (s, ref)]
            for x in (places[min(own.index(i), len(places) - 1)], places[0]):
                if best is None or alike(i, x) > best[0]:
                    best = (alike(i, x), ref, x)
        if best and (i & 1 or best[0] >= 4):
            want.add((d, best[1], i | (2 if i & 1 or best[0] >= 8 else 0), best[2]))
    assert any(not i & 1 for _, _, i, _ in want)
    packed = {p: np.array(c, np.uint8).view(np.int64).tolist() for p, c in around.items()}
    full = [(*r, *packed[r[2]]) for r in rows]
    names = ["seed", "doc_id", "place", "c0", "c1", "c2"]
    for size in (1, 2, 7, 300):
        cut = [full[a : a + size] for a in range(0, 300, size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*b, strict=True)], names) for b in cut]
        got = [tuple(r.values()) for b in substrings._match(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_recall_of_edited_and_composed_passages(docs, words):
    """Share of planted passages of 60 to 80 words that are found, by kind: at least 0.9 each."""
    rows, want = [], {"exact": set(), "5 %": set(), "15 %": set(), "two blocks": set(), "three blocks": set()}
    for i in range(60):
        for n, (kind, rate) in enumerate((("exact", 0), ("5 %", 0.05), ("15 %", 0.15))):
            shared, d = words(80, 40_000 + 10 * i + n), 1000 * (n + 1) + i
            rows.append((d, f"{words(30, 10 * d)} {shared} {words(30, 10 * d + 1)}"))
            rows.append((d + 500, f"{words(30, 10 * d + 2)} {edited(shared, rate, d) if rate else shared} {words(30, 10 * d + 3)}"))
            want[kind].add((d + 500, d))
    blocks = [words(30, 70_000 + i) for i in range(200)]
    rows += [(10_000 + i, f"{words(20, 71_000 + i)} {b} {words(20, 72_000 + i)}") for i, b in enumerate(blocks)]
    rng = random.Random(8)
    for i in range(60):
        for kind, n, d in (("two blocks", 2, 20_000 + i), ("three blocks", 3, 30_000 + i)):
            run = " ".join(rng.sample(blocks, n))
            rows += [(d + 500 * j, f"{words(30, 3 * d + j)} {run} {words(30, 5 * d + j)}") for j in (0, 1)]
            want[kind].add((d + 500, d))
    found = {(r["doc_id"], r["ref_id"]) for r in substrings.passages(docs(rows)).collect()}
    recall = {k: len(v & found) / len(v) for k, v in want.items()}
    assert recall["exact"] == 1 and min(recall.values()) >= 0.9, recall
    assert not {d for d, _ in found} & {10_000 + i for i in range(200)}


def test_copies_whose_short_seeds_have_earlier_owners_are_found(docs, words):
    rng, rows, want = random.Random(7), [], set()
    for i in range(30):
        shared = words(52, 700 + i)
        w = shared.split()
        for at in range(0, 46):  # most runs of five words also occur in unrelated earlier documents
            if rng.random() < 0.7:
                rows.append((len(rows), f"{words(6, 5000 + 100 * i + at)} {' '.join(w[at : at + 5])} {words(6, 9000 + 100 * i + at)}"))
        rows += [(10_000 + i, f"{words(30, 800 + i)} {shared} {words(30, 900 + i)}")]
        rows += [(20_000 + i, f"{words(30, 300 + i)} {shared} {words(30, 400 + i)}")]
        want.add((20_000 + i, 10_000 + i))
    found = {(r["doc_id"], r["ref_id"]) for r in substrings.passages(docs(rows)).collect()}
    assert want <= found


def test_both_copies_in_a_later_document_are_found(docs, words):
    shared = words(60, 61)
    rows = [(1, f"{words(40, 62)} {shared}"), (2, f"{words(40, 63)} {shared} {words(200, 64)} {shared} {words(40, 65)}")]
    assert substrings.passages(docs(rows)).count() == 2


# ---------------------------------------------------------------- language model


def tiny(items=12, seed=0):
    counts = np.arange(items, 0, -1) * 10.0
    classes = recurrent.Classes.by_frequency(counts, 4)
    net = recurrent.Net.fresh(items, counts, classes, seed)
    rng = np.random.default_rng(seed)
    for p in net.parts():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    return net, classes


def test_next_token_probabilities_sum_to_one():
    net, classes = tiny()
    for prefix in ([], [3], [5, 2, 7]):
        logs = [recurrent.score(net, classes, np.array([*prefix, i]), np.array([len(prefix) + 1]), 0)[0] for i in range(12)]
        rest = recurrent.score(net, classes, np.array(prefix or [0]), np.array([max(len(prefix), 1)]), 0)[0] if prefix else 0.0
        assert np.exp(logs).sum() == pytest.approx(np.exp(rest), rel=1e-4)


def test_scores_do_not_depend_on_lanes_or_neighbours():
    net, classes = tiny()
    rng = np.random.default_rng(4)
    size = np.array([1, 200, 33, 64, 5, 2, 97, 31])
    items = rng.integers(0, 12, size.sum())
    alone, at = [], 0
    for s in size:
        alone.append(recurrent.score(net, classes, items[at : at + s], np.array([s]), 0)[0])
        at += s
    for width in (1, 3, 512):
        assert np.allclose(recurrent.score(net, classes, items, size, 0, width), alone, rtol=1e-4)


def test_gradient_of_a_window_equals_differences(monkeypatch):
    monkeypatch.setattr(recurrent, "F32", np.float64)
    net, classes = tiny()
    net = recurrent.Net(*(p.astype(float) for p in net.parts()))
    items, size = np.array([3, 5, 0, 7, 1, 2, 0]), np.array([3, 4])
    trainer = recurrent.Trainer(net, classes, 0.1)
    window = next(recurrent._windows(items, size, 2, 0))
    args = (*window[:3], window[3] >= 0, np.zeros((2, recurrent.HIDDEN)))
    _, grads, _ = trainer._window(*args)
    rng = np.random.default_rng(0)
    for p, g in zip(net.parts(), grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old, h = p[at], 1e-5
            p[at] = old + h
            up = trainer._window(*args)[0]
            p[at] = old - h
            down = trainer._window(*args)[0]
            p[at] = old
            assert -(up - down) / (2 * h) / len(items) == pytest.approx(g[at], abs=1e-6)


def test_only_items_of_a_window_move_and_as_all_gradients_say():
    net, classes = tiny()
    items, size = np.array([3, 5, 0, 7, 1, 2, 0]), np.array([3, 4])
    window = next(recurrent._windows(items, size, 2, 0))
    trainer = recurrent.Trainer(net, classes, 0.1)
    _, grads, _ = trainer._window(*window[:3], window[3] >= 0, np.zeros((2, recurrent.HIDDEN), np.float32))
    before = [p.copy() for p in net.parts()]
    trainer.learn(items, size, 0, 2)
    for p, old, g in zip(net.parts(), before, grads, strict=True):
        assert np.allclose(p, old - 0.1 * g / np.sqrt(1e-4 + g * g), atol=1e-6)
    still = np.setdiff1d(np.arange(12), window[1])
    assert len(still) and (net.gate[still] == before[0][still]).all()


def test_all_tokens_at_hand_are_scored_together(monkeypatch):
    calls, plain = [], lm.score
    monkeypatch.setattr(lm, "score", lambda *a: calls.append(len(a[2])) or plain(*a))
    monkeypatch.setattr(lm, "CHUNK", 4)
    monkeypatch.setattr("argusframe.llm.words.PIECE_BYTES", 8)
    v = lm.Vocabulary(
        np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(lm.RESTS), np.ones(lm.RESTS),
        np.ones(lm.RESTS + 1), lm._classes(np.ones(lm.RESTS + 1)), 65, 65, 1,
    )
    texts = pa.array(["a b c", "d e f g", "h", None, "i j k l m"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), texts], ["row", "doc_id", "text"])
    list(lm._score(iter([batch]), v, recurrent.Net.fresh(v.items, v.item_count, v.classes).vector()))
    assert calls == [13 + 5]


def test_base_scores_equal_plain_ones_and_the_model_learns(docs, words, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)
    monkeypatch.setattr(lm, "ITEMS", 60)
    rows = [(i, " ".join(w for k in range(30) for w in (f"a{k % 7}", f"b{k % 7}", words(2, 40 * i + k)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "a1 b1 never seen"), (7, rows[7][1])]
    counts = collections.Counter()
    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
    for d, t in rows:
        if train(d):
            counts.update([*(t or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        want.append((-1 if d is None else d, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    got = lm.score_documents(docs(rows)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3], r[4], round(r[5], 6)) for r in got) == sorted(want)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_edges(edges, nothing):
    got = lm.score_documents(edges).collect()
    assert len(got) == edges.count() and all(math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(nothing).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_take_effect(docs, words, spark, edges, nothing):
    shared = words(70, 999)
    rows = [(i, words(100, i)) for i in range(20)]
    rows += [(30, rows[3][1]), (31, rows[4][1].replace(rows[4][1].split()[50], "changed", 1)), (32, "12 34 --"), (33, None)]
    rows += [(40 + i, f"{words(60, 200 + i)} {shared} {words(60, 300 + i)}") for i in range(3)]
    rows += [(50, f"{words(30, 400)} token = \"{'0a1b2c3d' * 5}\" {words(30, 401)}")]
    table = docs(rows)
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "")
        if name != "best_fit_packing":
            assert table.columns == docs(rows).columns
        ids.append({r["doc_id"] for r in table.select("doc_id").collect()})
    whole = {i for i, _ in rows}
    assert ids[0] == whole - {32, 33}
    assert ids[1] == ids[2] == ids[3] == ids[4] == whole - {30, 31, 32, 33}
    for start in (edges, nothing):
        table = start
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, "")
        table.collect()


def test_repeated_rows_leave_one(docs, spark):
    table = docs([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x"), (3, "p q")])
    got = corpus_pipeline.drop_near_duplicates(spark, table, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "x"), (1, "a b c d e f g"), (3, "p q")]


def test_pipeline_runs_over_a_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("shard", "bin").agg(F.sum("n_words").alias("n")).where(f"n > {packing.CAPACITY}").count() == 0
    assert out.select("doc_id").distinct().count() > 100


def test_every_token_of_every_window_gives_a_gradient(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, n)) for n in (0, 1, 700, 90, 2500)]
    keys, n = np.unique(np.concatenate([lm.token_keys(p) for p in lm.pieces(pa.array(texts))]), return_counts=True)
    amount = np.concatenate(([len(texts)], n, np.zeros(lm.RESTS)))
    v = lm.Vocabulary(
        keys, n, np.arange(1, len(keys) + 1), np.zeros(lm.RESTS), np.zeros(lm.RESTS), amount,
        lm._classes(amount), int(amount.sum()), len(keys) + 1, len(texts),
    )
    start = recurrent.Net.fresh(v.items, v.item_count, v.classes)
    learned = []
    window = recurrent.Trainer._window

    def seen(self, target, inputs, fresh, inside, state):
        learned.append(int(inside.sum()))
        return window(self, target, inputs, fresh, inside, state)

    monkeypatch.setattr(recurrent.Trainer, "_window", seen)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    squares = [np.full(p.shape, 1e-4, np.float32) for p in start.parts()]
    assert len(list(lm._teach(iter([batch]), v, start.vector(), squares))) == 1
    assert sum(learned) == sum(len(t.split()) + 1 for t in texts)


def test_long_documents_go_on_beside_the_next_chunk(monkeypatch):
    rng = np.random.default_rng(7)
    sizes = [640, *[10] * 20] * 6
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, n)) for n in sizes]
    keys, n = np.unique(np.concatenate([lm.token_keys(p) for p in lm.pieces(pa.array(texts))]), return_counts=True)
    amount = np.concatenate(([len(texts)], n, np.zeros(lm.RESTS)))
    v = lm.Vocabulary(
        keys, n, np.arange(1, len(keys) + 1), np.ones(lm.RESTS), np.ones(lm.RESTS), amount,
        lm._classes(amount), int(amount.sum()), len(keys) + 1, len(texts),
    )
    net = recurrent.Net.fresh(v.items, v.item_count, v.classes)
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["row", "doc_id", "text"])

    def scored():
        rows = [r for out in lm._score(iter([batch]), v, net.vector()) for r in out.to_pylist() if r["score"] is not None]
        assert [r["row"] for r in rows] == list(range(len(texts)))
        return [r["score"] for r in rows]

    alone = scored()
    monkeypatch.setattr("argusframe.llm.words.PIECE_BYTES", 3000)
    monkeypatch.setattr(lm, "CHUNK", 800)
    monkeypatch.setattr(lm, "SCORED", 800)
    steps, forward = [], recurrent._forward
    monkeypatch.setattr(recurrent, "_forward", lambda *a, **k: steps.append(a[1].shape[1]) or forward(*a, **k))
    assert np.allclose(scored(), alone, rtol=1e-5)
    # six long documents side by side: as many windows as one of them has
    assert len(steps) == 21
    steps.clear()
    squares = [np.full(p.shape, 1e-4, np.float32) for p in net.parts()]
    assert len(list(lm._teach(iter([batch.select(["text"])]), v, net.vector(), squares))) == 1
    assert len(steps) == 21
    # rests are bounded: longer ones are run down before the next chunk
    monkeypatch.setattr(recurrent, "LONGEST_REST", 100)
    steps.clear()
    assert np.allclose(scored(), alone, rtol=1e-5)
    assert 21 < len(steps) <= 6 * 21


@pytest.mark.parametrize("holders", [64, 3])
def test_a_passage_is_found_however_many_documents_hold_its_seeds(docs, words, monkeypatch, holders):
    monkeypatch.setattr(substrings, "HOLDERS", holders)
    rng = random.Random(5)
    passage = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(70)]

    def around(part, seed):
        return words(40, seed) + " " + " ".join(part) + " " + words(40, seed + 500)

    # every seed of the passage, with words beside it, stands in earlier and in later documents too
    cuts = [passage[i : i + 33] for i in range(0, 40, 3)]
    rows = [(i, around(c, i)) for i, c in enumerate(cuts)]
    rows += [(100, around(passage, 100))]
    rows += [(200 + i, around(c, 200 + i)) for i, c in enumerate(cuts)]
    rows += [(300, around(passage, 300))]
    text = dict(rows)
    found = [r for r in substrings.passages(docs(rows)).collect() if r["doc_id"] == 300]
    want = " ".join(passage)
    assert any(r["ref_id"] == 100 and want in text[300][r["start"] : r["end"]] for r in found)


def test_a_stretch_that_many_chains_widen_to_is_aligned_once(words, monkeypatch):
    one = words(300, 3).split()
    two = [w if i % 11 else "other" for i, w in enumerate(one)]
    texts = [" ".join(x) for x in (one, two)]
    starts = [np.cumsum([0, *(len(w) + 1 for w in x[:-1])]) for x in (one, two)]

    def place(side, word):
        return int(word << substrings._WORD_AT | int(starts[side][word]) << substrings._CHAR_AT)

    # seeds of five words between those that differ, as chains by themselves
    seeds = [11 * i + 3 for i in range(2, 25)]
    chains = [dict(zip(("start", "end", "ref_start", "ref_end"), (place(0, w),) * 2 + (place(1, w),) * 2)) for w in seeds]
    row = {"doc_id": 2, "ref_id": 1, "own": texts[0], "own_from": 0, "own_size": len(texts[0]), "other": texts[1],
           "other_from": 0, "other_size": len(texts[1])}
    looked, matching = [], substrings.matching
    monkeypatch.setattr(substrings, "matching", lambda *a: looked.append(a) or matching(*a))

    def found(chains):
        out = substrings._align(iter([pa.RecordBatch.from_pylist([{**row, "chains": chains}])]), 50, 0.8)
        return [r for b in out for r in b.to_pylist()]

    whole = found(chains)
    assert len(looked) == 1 and len(whole) == 1 and whole[0]["n_words"] > 280
    assert all(found([c]) == whole for c in chains)


def test_chains_of_two_documents_come_with_one_extract(spark, words):
    text = " ".join(words(900, 4).split())
    starts = np.cumsum([0, *(len(w) + 1 for w in text.split()[:-1])])
    at = [int(w << substrings._WORD_AT | int(starts[w]) << substrings._CHAR_AT) for w in (10, 40, 70, 850)]
    found = spark.createDataFrame([(2, a, a, 1, a, a) for a in at], substrings._CHAIN)
    texts = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    got = substrings._aligned(found, texts, 600, 50, 0.8).collect()
    # the first three lie side by side: one stretch; all are open at the extract's end
    assert [r["n_words"] for r in got] == [-1] * len(at)
    assert sorted(r["start"] for r in got) == sorted(at)
    got = substrings._aligned(found, texts, 100_000, 50, 0.8).collect()
    assert [(r["start"], r["end"], r["n_words"]) for r in got] == [(0, len(text), 900)]


@pytest.mark.parametrize("window", [1, 2, 5, 15, 16])
def test_least_and_greatest_of_windows_equal_plain_ones(window):
    value = np.random.default_rng(2).integers(0, 9, 60).astype(np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(value, window)
    assert (substrings._over(np.minimum, value, window) == view.min(1)).all()
    assert (substrings._over(np.maximum, value, window) == view.max(1)).all()


def test_shuffle_files_of_written_steps_do_not_stay(spark, docs, words):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        files = manager.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data"))

    table = docs([(i, words(200, i // 2)) for i in range(300)])
    before = left()
    neardup.near_duplicates(table.select("doc_id", "text"))
    # what stays is the shuffle of small questions, not of sets, short keys and texts
    assert left() - before < 100_000, left() - before


def test_places_with_enough_common_words_around_meet(monkeypatch):
    rng = random.Random(8)
    line = rng.sample(range(5000, 9000), 20)
    words, doc = [], []
    for i in range(150):
        # a common line, and of some places the words beside it too, each with words of its own
        kind = i % 6
        rest = random.Random(kind).choices(range(1, 900), k=60)
        rest = [rng.randint(1, 4000) if rng.random() < 0.05 * (i % 7) or kind > 3 else w for w in rest]
        row = [*line, *rest, *[0] * rng.choice([0, 0, 15])]
        words.append(row[:64])
        doc.append(i // 2)
    words.append([7] * 64)
    words.append([0] * 10 + [7] * 54)
    doc += [75, 76]
    late = np.array([rng.random() < 0.7 for _ in words])
    words, doc = np.array(words, np.uint16), np.array(doc)

    def bag(row, n):
        return collections.Counter(g for g in zip(*(row[a:].tolist() for a in range(n)), strict=False) if all(g))

    def reach(one, two, share):
        there = [w in two for w in one]
        return any(
            there[a] and there[b - 1] and sum(there[a:b]) >= share * (b - a) - 1e-9
            for a in range(len(one)) for b in range(a + 35, len(one) + 1)
        )

    for least, common in ((1, 28), (19, 31), (25, 28)):
        want = set()
        for i in np.flatnonzero(late):
            for j in np.flatnonzero(doc < doc[i]):
                one, two = ([w for w in words[k].tolist() if w] for k in (i, j))
                if sum((bag(words[i], 2) & bag(words[j], 2)).values()) < least or substrings.common_words(one, two) < common:
                    continue
                if reach(one, set(two), common / 35):
                    want.add((int(doc[i]), int(doc[j])))
        assert 50 < len(want) < 2000, len(want)
        for at_once in (1, 1000, 1 << 20):
            monkeypatch.setattr(substrings, "AT_ONCE", at_once)
            got = substrings.alike(words, doc, late, np.zeros(len(doc), np.int64), least, common, 35)
            assert got == want
        # blocks of places, every two together
        block, met = np.arange(len(doc)) % 3, set()
        for a, b in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)):
            own = (block == a) | (block == b)
            met |= substrings.alike(words[own], doc[own], late[own], block[own], least, common, 35)
        assert met == want


def common_seeds(words):
    """Documents of pieces of a passage, two whole ones and an edited one that has no 50 words in a row of them."""
    rng = random.Random(6)
    passage = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(70)]
    new = [w if i % 33 != 16 else "other" for i, w in enumerate(passage)]

    def around(part, seed):
        return words(40, seed) + " " + " ".join(part) + " " + words(40, seed + 500)

    # pieces of both with the words of one side stand in many earlier and later documents, which are no passages
    cuts = [text[i : i + 33] for text in (passage, new) for i in range(0, 38)]
    rows = [(i, around(c, i)) for i, c in enumerate(cuts)]
    rows += [(100, around(passage, 100))]
    rows += [(200 + i, around(c, 200 + i)) for i, c in enumerate(cuts)]
    return [*rows, (300, around(new, 300))]


@pytest.mark.parametrize(("holders", "block"), [(64, 1 << 13), (3, 40)])
def test_edited_passages_of_common_seeds_are_found(docs, words, monkeypatch, holders, block):
    monkeypatch.setattr(substrings, "HOLDERS", holders)
    monkeypatch.setattr(substrings, "BLOCK", block)
    rows = common_seeds(words)
    text = dict(rows)
    found = [r for r in substrings.passages(docs(rows)).collect() if r["doc_id"] == 300]
    assert any(r["ref_id"] == 100 and text[300][r["start"] : r["end"]].split().count("other") == 2 for r in found)


def test_pipeline_takes_edited_passages_of_common_seeds_out(spark, docs, words, monkeypatch):
    monkeypatch.setattr(substrings, "HOLDERS", 3)
    rows = common_seeds(words)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, docs(rows), "").collect()}
    text = dict(rows)
    assert len(left[300].split()) <= 90 and {d for d in text if left[d] != text[d]} == {300}
