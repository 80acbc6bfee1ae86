"""Registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argusframe.llm import (
    bpe, centroids, langid, lm, neardup, packing, pages, quality, secret_scan, substrings, topk,
    toxicity, trie,
)

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Plan) -> Plan:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return tokens.select(
        "doc_id",
        (F.length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("_spans")

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    base = of("assign", "access", "hex")
    return secret_scan.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.digest(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.digest(spans).alias("spans"),
    )


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string").cast("binary")
    return langid.predict(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.crc32(key) % 5 == 0).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", topk.scaled(F.col("embedding")).alias("v")
    )
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


ORACLES["op1_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS query_id, b.vec_id,
        CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


@_query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(_table(spark, sf_dir, "documents"))


@_query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


@_query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", centroids.quantized(F.col("embedding")).alias("v")
    )
    return centroids.cluster(vectors)


@_query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = r"""
WITH RECURSIVE bits AS (
    SELECT b, 0 AS i, CAST(b AS BIGINT) AS v FROM range(256) AS t(b)
    UNION ALL SELECT b, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE i < 8
), crc_table AS (
    SELECT list(v ORDER BY b) AS crc FROM bits WHERE i = 8
), own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
    SELECT conv_id, turns, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, x: xor(a // 256, crc[xor(a % 256, x) + 1]))) % 4 AS h
    FROM own, crc_table
), rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
    FROM hashed AS o LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
    SELECT conv_id, d AS depth, len(turns) = d AS last, turns[1:d] AS p, turns[1:d - 1] AS up,
        CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
    FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT depth, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last), '') AS ends
    FROM prefixes GROUP BY depth, p
), children AS (
    SELECT depth - 1 AS depth, up AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), n AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, p)
), subtree AS (
    SELECT a.depth, a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
    FROM (SELECT depth, p, unnest(range(0, depth + 1)) AS d, n_children, n_convs, words FROM n) AS b
        JOIN n AS a ON a.depth = b.d AND a.p = b.p[1:b.d]
    GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN subtree USING (depth, p) LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.p = n.up
"""


def _clustering_sql(rounds: int) -> str:
    """Plain rounds of assignment and update."""

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
    SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min({{'d': d, 'c': c}}) AS best
    FROM (SELECT v.*, c, CAST(list_inner_product(q, q) + list_inner_product(cq, cq) - 2 * list_inner_product(q, cq) AS BIGINT) AS d
        FROM v, k{r}) GROUP BY rid
)"""

    def moved(r: int) -> str:
        return f"""k{r} AS MATERIALIZED (
    SELECT c, coalesce(n.cq, k{r - 1}.cq) AS cq FROM k{r - 1} LEFT JOIN (
        SELECT c, list(CAST(floor_sum AS DOUBLE) ORDER BY i) AS cq FROM (
            SELECT c, i, (s - (s % n + n) % n) / n AS floor_sum FROM (
                SELECT best.c AS c, i, sum(CAST(q[i] AS BIGINT)) AS s, count(*) AS n
                FROM a{r - 1}, range(1, 65) AS t(i) GROUP BY 1, 2))
        GROUP BY c) AS n USING (c)
)"""

    steps = [s for r in range(1, rounds + 1) for s in (moved(r), assigned(r))]
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id,
        list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), k0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS c, q AS cq
    FROM v QUALIFY c < 16
), {", ".join([assigned(0), *steps])}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
    CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(cq, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN k{rounds} ON best.c = c
"""


ORACLES["op13_centroid_clustering"] = _clustering_sql(centroids.ROUNDS)


ORACLES["op10_quality_rules"] = r"""
WITH w AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), win AS (
    SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS key
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, key) AS k FROM win) WHERE k > 1
), covered AS (
    SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 8) AS t(j) GROUP BY rid
), c AS (
    SELECT rid, doc_id, lang, source, len(ws) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM w LEFT JOIN covered USING (rid)
), d AS (
    SELECT * EXCLUDE (lines), len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        greatest(n_words, 1) AS per, len(lines) AS n_lines
    FROM c
), m AS (
    SELECT rid, lang, source, n_words, unnest([
        {'name': 'symbol_rate', 'x': n_symbols / per, 'slack': 0.3::DOUBLE},
        {'name': 'dup_line_rate', 'x': greatest(n_dup_lines - 1, 0) / greatest(n_lines, 1), 'slack': 0.3::DOUBLE},
        {'name': 'repeat_rate', 'x': n_repeat_words / per, 'slack': 0.15::DOUBLE},
        {'name': 'word_length', 'x': word_chars / per, 'slack': 3.0::DOUBLE}], recursive := true)
    FROM d
), sketch AS (
    SELECT lang, source, name, CASE WHEN x > 0 THEN CAST(ceil(round(ln(x) / ln(1.02::DOUBLE), 6)) AS INTEGER) END AS bucket,
        count(*) AS n
    FROM m WHERE n_words >= 20 GROUP BY ALL
), ranked AS (
    SELECT *, CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow(1.02::DOUBLE, bucket) / 2.02::DOUBLE END AS v,
        sum(n) OVER (PARTITION BY lang, source, name ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
        sum(n) OVER (PARTITION BY lang, source, name) AS total
    FROM sketch
), fences AS (
    SELECT lang, source, name, min(v) FILTER (100 * upto >= 25 * total) AS q25, min(v) FILTER (100 * upto >= 75 * total) AS q75
    FROM ranked GROUP BY ALL
), outliers AS (
    SELECT DISTINCT rid FROM m JOIN fences AS f
        ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source AND m.name = f.name
    WHERE x > q75 + 4 * (q75 - q25) + slack OR (m.name = 'word_length' AND x < q25 - 4 * (q75 - q25) - slack)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND rid NOT IN (SELECT rid FROM outliers) AS kept
FROM d
"""


ORACLES["op7_near_duplicates"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)
    UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1
), z AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), sn AS (
    SELECT doc_id, n, shingle FROM s JOIN z USING (doc_id)
), e AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM sn AS a JOIN sn AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
    SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
    SELECT doc_id, doc_id AS c FROM w
    UNION SELECT t.b, r.c FROM r JOIN both_ways AS t ON r.doc_id = t.a
), k AS (
    SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN k USING (doc_id) LEFT JOIN z USING (doc_id)
"""
