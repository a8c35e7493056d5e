"""Queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe_duckdb, common, html, iblt, minhash, mixing, nbsvm, pii, simple8b, tokencount, topk

BPE_JSON, BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON), public_tokenizers.PATTERN)


def op1_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(common.table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(common.table(spark, sf_dir, "documents")).drop("masked")


def op3_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON), public_tokenizers.PATTERN, end_id=0)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.table(spark, sf_dir, "pages"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_duckdb.encode_and_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).drop("positions")


def op10_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(common.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_groups, op2_pii, op3_simple8b_files, op4_exact_topk, op5_token_counts, op6_quality, op7_main_text, op8_bpe_round_trip, op9_mix, op10_iblt_fingerprints)}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_groups": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
            FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        pairs AS (
            SELECT a.doc_id AS u, b.doc_id AS v
            FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach(doc_id, node) AS (
            SELECT doc_id, doc_id FROM sets
            UNION
            SELECT r.doc_id, p.v FROM reach r JOIN pairs p ON p.u = r.node),
        least AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
        FROM sets s JOIN least USING (doc_id)""",
    "op4_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS mixed,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n, 3 * source_size AS filled FROM per_source),
        weighed AS (SELECT *, CAST(n % 3 + 1 AS BIGINT) AS weight FROM ranked),
        lines AS (
            SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(filled) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line
            FROM weighed WINDOW o AS (ORDER BY filled / weight, n)),
        water AS (SELECT line AS level FROM lines WHERE line * weight <= filled ORDER BY filled / weight, n LIMIT 1),
        targets AS (
            SELECT source, source_size, CASE WHEN n % 3 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt,
                   CASE WHEN level IS NULL OR level * weight > filled THEN CAST(filled AS DOUBLE) ELSE level * weight END AS target
            FROM lines LEFT JOIN water ON TRUE),
        placed AS (
            SELECT doc_id, size, source_size, target, tilt, CAST(round(target) AS BIGINT) AS words,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY mixed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        takes AS (
            SELECT doc_id, size, source_size, target, 1.0::DOUBLE - tilt AS b, tilt, CAST(before AS DOUBLE) / nullif(target, 0) AS share,
                   CAST(coalesce(words // nullif(source_size, 0), 0) * size
                        + least(size, greatest(0, words - coalesce(words // nullif(source_size, 0), 0) * source_size - before)) AS BIGINT) AS taken
            FROM placed)
        SELECT doc_id, size, source_size, target, taken,
               CASE WHEN taken > 0 THEN least(1.0::DOUBLE, 2.0::DOUBLE * share / (b + sqrt(greatest(b * b + 4.0::DOUBLE * tilt * share, 0.0::DOUBLE)))) END AS position
        FROM takes""",
}
