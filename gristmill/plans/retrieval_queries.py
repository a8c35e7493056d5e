"""Queries of chunking and retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import retrieval as R
from gristmill.operators import studies
from gristmill.plans.registry import query, table
from gristmill.plans.text_queries import _SENTENCES, STRIP, WORDS
from gristmill.sources.cluster import materialize
from gristmill.sources.configs import ChunkingConfig

K = 10


def fixed_sql(n: int) -> str:
    return f"""SELECT doc_id || '::' || i AS chunk_id, CAST(doc_id AS VARCHAR) AS parent_doc_id, array_to_string(w[i * {n} + 1:(i + 1) * {n}], ' ') AS text
        FROM (SELECT doc_id, w, unnest(range((len(w) + {n} - 1) // {n})) AS i FROM (SELECT doc_id, {WORDS.format(c='text')} AS w FROM documents))"""


def sentence_sql(n: int) -> str:
    return f"""SELECT doc_id || '::' || i AS chunk_id, CAST(doc_id AS VARCHAR) AS parent_doc_id, array_to_string(w[i * {n} + 1:(i + 1) * {n}], ' ') AS text
        FROM (SELECT doc_id, w, unnest(range((len(w) + {n} - 1) // {n})) AS i FROM (SELECT doc_id, {_SENTENCES} AS w FROM documents))"""


WHOLE = f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS parent_doc_id, {STRIP.format(c='text')} AS text FROM documents WHERE {STRIP.format(c='text')} <> ''"


@query(WHOLE)
def chunk_whole(s, d):
    return R.chunk_whole(table(s, d, "documents")).drop("chunk_index")


@query(fixed_sql(128))
def chunk_fixed(s, d):
    return R.chunk_fixed(table(s, d, "documents"), 128).drop("chunk_index")


@query(sentence_sql(3))
def chunk_sentence(s, d):
    return R.chunk_sentences(table(s, d, "documents"), 3).drop("chunk_index")


@query(f"SELECT parent_doc_id, count(*) AS n, max(CAST(string_split(chunk_id, '::')[2] AS INTEGER)) AS last_index FROM ({fixed_sql(256)}) GROUP BY parent_doc_id")
def chunk_index(s, d):
    return R.chunk_fixed(table(s, d, "documents"), 256).groupBy("parent_doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_index").alias("last_index"))


_SCHEMES = {"whole_review": WHOLE, "fixed_token": fixed_sql(256), "sentence_window": sentence_sql(3)}


@query(" UNION ALL ".join(f"SELECT '{name}' AS scheme, count(*) AS n_chunks FROM ({sql})" for name, sql in _SCHEMES.items()))
def chunk_dispatch(s, d):
    return _all_schemes(s, d).groupBy("scheme").agg(F.count(F.lit(1)).alias("n_chunks"))


def _all_schemes(s, d) -> DataFrame:
    docs = table(s, d, "documents")
    return reduce(DataFrame.unionByName, [R.chunk(docs, name).withColumn("scheme", F.lit(name)) for name in _SCHEMES])


@query(" UNION ALL ".join(f"SELECT '{name}' AS scheme, chunk_id, md5(text) AS digest FROM ({sql})" for name, sql in _SCHEMES.items()))
def union_all_schemes(s, d):
    return _all_schemes(s, d).select("scheme", "chunk_id", F.md5("text").alias("digest"))


@query(f"SELECT count(DISTINCT parent_doc_id) AS n FROM ({sentence_sql(3)})")
def count_distinct_parents(s, d):
    return R.chunk_sentences(table(s, d, "documents"), 3).agg(F.count_distinct("parent_doc_id").alias("n"))


_TF = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
    stats AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_tokens FROM tok),
    raw AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, stats GROUP BY term),
    idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""


@query(f"WITH {_TF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index(s, d):
    return R.BM25(table(s, d, "documents")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


_BM25 = f"""{_TF},
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / (n_tokens / n_docs)))) AS score
        FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN tok USING (doc_id), stats GROUP BY ALL),
    every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN s ON s.query_id = b.item_id AND s.doc_id = d.doc_id),
    bm25 AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM every) WHERE rank <= {K})"""


def bm25_hits(s, d, k: int = K) -> DataFrame:
    questions = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.BM25(table(s, d, "documents").select("doc_id", "text")).search_batch(questions, k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM bm25")
def bm25_search(s, d):
    return bm25_hits(s, d).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 5")
def topk_rank(s, d):
    return R.top_k(bm25_hits(s, d).drop("rank"), 5).select("query_id", "doc_id", "rank")


_DENSE = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    dense AS (SELECT query_id, doc_id, score, rank FROM (
        SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_inner_product(q.v, c.v) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, c.v), 9) DESC, c.vec_id) AS rank
        FROM v q JOIN v c ON q.vec_id % 50 = 0) WHERE rank <= {K})"""


def vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def dense_hits(s, d, k: int = K) -> DataFrame:
    """The queries are the rows whose id is divisible by 50."""
    rows = vectors(s, d)
    return R.dense_top_k(rows, rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector"), k)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM dense")
def dense_topk(s, d):
    return dense_hits(s, d).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_COMPONENTS = """(SELECT {id}, h % 64 AS i, sum(CASE WHEN h & 65536 <> 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS c
        FROM (SELECT {id}, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM (SELECT {id}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {table})) GROUP BY ALL)"""
_ENCODED = "SELECT t.{id}, list(coalesce(c, 0) ORDER BY r.i) AS v FROM {table} t CROSS JOIN range(64) r(i) LEFT JOIN " + _COMPONENTS + " c ON c.{id} = t.{id} AND c.i = r.i GROUP BY t.{id}"
# Two retrievers over the documents: BM25, and exact search of encoded texts.  Relevant are pooled
# documents that hold at least half of a question's terms.
HITS = f"""{_BM25}, dv AS ({_ENCODED.format(id='doc_id', table='documents')}), qv AS ({_ENCODED.format(id='item_id', table='benchmark')}),
    products AS (SELECT item_id AS query_id, doc_id, coalesce(list_inner_product(qv.v, dv.v) / nullif(sqrt(list_inner_product(qv.v, qv.v)) * sqrt(list_inner_product(dv.v, dv.v)), 0), 0) AS score FROM qv CROSS JOIN dv),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM products) WHERE rank <= {K}),
    hits AS (SELECT 'bm25' AS retriever, query_id, doc_id, score, rank FROM bm25 UNION ALL SELECT 'dense', query_id, doc_id, score, rank FROM dense),
    qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
    share AS (SELECT query_id, doc_id, count(*) AS n FROM (SELECT DISTINCT query_id, doc_id FROM hits) JOIN q USING (query_id) JOIN tf USING (doc_id, term) GROUP BY ALL),
    qrels AS (SELECT share.query_id, doc_id FROM share JOIN qn USING (query_id) WHERE 2 * share.n >= qn.n),
    asked AS (SELECT item_id AS query_id, 'type_' || item_id % 3 AS type, item_id % 3 = 0 AS is_negative FROM benchmark)"""

_studied: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def asked(s, d) -> DataFrame:
    """The questions: ``query_id, text, type, is_negative``."""
    kind = F.col("item_id") % 3
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("type_"), kind.cast("string")).alias("type"), (kind == 0).alias("is_negative"))


def forget() -> None:
    """Search anew from now on."""
    _studied.clear()


def studied(s, d) -> tuple[DataFrame, DataFrame]:
    """Hits of both retrievers and the relevant pairs; each corpus is indexed and searched once per application."""
    at = (s.sparkContext.applicationId, d)
    if at not in _studied:
        docs, questions = table(s, d, "documents").select("doc_id", "text"), asked(s, d)
        lexical = R.BM25(docs)
        found = [r.search_batch(questions, K).withColumn("retriever", F.lit(name)) for name, r in (("bm25", lexical), ("dense", R.Dense(docs, R.hashing_encoder)))]
        hits = materialize(found[0].unionByName(found[1]), "study-hits")
        # Hits are few and written: the postings of the documents found are picked out where they lie.
        terms = questions.select("query_id", F.array_distinct(X.search_tokens("text")).alias("asked"))
        pairs = lexical.postings.select("doc_id", "terms").join(hits.select("query_id", "doc_id").distinct(), "doc_id").join(terms, "query_id")
        shared = F.size(F.array_intersect("terms", "asked"))
        qrels = pairs.where((shared > 0) & (2 * shared >= F.size("asked"))).select("query_id", "doc_id")
        _studied[at] = hits, materialize(qrels, "study-qrels")
    return _studied[at]


def both_hits(s, d) -> DataFrame:
    return studied(s, d)[0]


def relevant(s, d) -> DataFrame:
    return studied(s, d)[1]


_POOL = f"""WITH {HITS}, p AS (SELECT query_id, doc_id, min(rank) AS best_rank, count(DISTINCT retriever) AS n_retrievers FROM hits GROUP BY ALL),
    pooled AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, CAST(doc_id AS VARCHAR)) AS place FROM p)"""


@query(f"{_POOL} SELECT query_id, doc_id, best_rank, place FROM pooled")
def best_rank_order(s, d):
    return R.pool(both_hits(s, d)).select("query_id", "doc_id", "best_rank", "place")


@query(f"{_POOL} SELECT query_id, doc_id FROM pooled")
def union_distinct_pool(s, d):
    return R.pool(both_hits(s, d)).select("query_id", "doc_id")


@query(f"{_POOL} SELECT query_id, doc_id FROM pooled WHERE n_retrievers > 1")
def intersect_overlap(s, d):
    return R.pool(both_hits(s, d)).where("n_retrievers > 1").select("query_id", "doc_id")


@query(f"{_POOL} SELECT query_id, CAST(count(*) AS INTEGER) AS pool_size, CAST(count(*) FILTER (WHERE n_retrievers > 1) AS INTEGER) AS overlap_count, array_to_string(list(doc_id ORDER BY place), ',') AS doc_ids, 2 AS n_retrievers_used FROM pooled GROUP BY query_id")
def pool_union(s, d):
    return R.pool_records(both_hits(s, d)).select("query_id", "pool_size", "overlap_count", F.array_join("doc_ids", ",").alias("doc_ids"), "n_retrievers_used")


@query(
    f"""{_POOL}, z AS (SELECT a.query_id, is_negative, count(doc_id) AS n FROM asked a LEFT JOIN (SELECT query_id, doc_id FROM dense WHERE score >= 0.6) USING (query_id) GROUP BY ALL)
    SELECT min(n) AS least, max(n) AS most, round_even(avg(n), 2) AS mean, coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY CAST(query_id AS VARCHAR)) FILTER (WHERE n = 0), '') AS zero_pool,
        coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY CAST(query_id AS VARCHAR)) FILTER (WHERE n BETWEEN 1 AND 6 AND NOT is_negative), '') AS low_diversity FROM z"""
)
def pool_stats(s, d):
    """Pools of close documents only, so that some are small or empty."""
    pooled = R.pool(both_hits(s, d).where("retriever = 'dense' AND score >= 0.6"))
    return R.pool_stats(pooled, asked(s, d), 6).withColumns({c: F.array_join(c, ",") for c in ("zero_pool", "low_diversity")})


_PARENTS = f"""WITH {_DENSE}, c AS (SELECT query_id, doc_id // 3 AS parent, rank, score FROM dense),
    f AS (SELECT query_id, parent, min(rank) AS best, arg_min(score, rank) AS score, arg_min(rank, rank) AS first_rank FROM c GROUP BY ALL)"""


def parents(s, d) -> DataFrame:
    """Chunks to parents: three neighbouring vectors belong together."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 3).alias("parent_doc_id"))


@query(f"{_PARENTS} SELECT query_id, parent AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM f")
def collapse_to_parent(s, d):
    return R.collapse_to_parents(dense_hits(s, d), parents(s, d)).select("query_id", "doc_id", "rank")


@query(f"{_PARENTS} SELECT query_id, parent AS doc_id, round(score, 6) AS score FROM f")
def first_chunk_per_parent(s, d):
    return R.collapse_to_parents(dense_hits(s, d), parents(s, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_BLOCK = f"'[' || doc_id || '] has_photo: ' || CASE WHEN n_chars > 2000 THEN 'yes' ELSE 'no' END || chr(10) || left({STRIP.format(c='text')}, 100)"
# The same search over chunks of 64 words, 25 deep, collapsed to the first five documents.
_CHUNKED = _BM25.replace("WITH ", "").replace("SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents", "SELECT chunk_id AS doc_id, parent_doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM chunks").replace("CROSS JOIN documents d", "CROSS JOIN tok d").replace(f"rank <= {K}", "rank <= 25")
_SHOWN = f"""chunks AS ({fixed_sql(64)}), {_CHUNKED},
    parents AS (SELECT query_id, parent_doc_id, min(rank) AS best FROM bm25 JOIN tok USING (doc_id) GROUP BY ALL),
    shown AS (SELECT query_id, CAST(parent_doc_id AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM parents)"""


@query(f"WITH {_SHOWN} SELECT query_id, array_to_string(list(doc_id ORDER BY rank), ',') AS ids, array_to_string(list({_BLOCK} ORDER BY rank), chr(10) || chr(10)) AS context_text, count(*) FILTER (WHERE n_chars > 2000) AS n_photos FROM shown JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id")
def context_block(s, d):
    docs = table(s, d, "documents").withColumn("has_image", F.col("n_chars") > 2000)
    chunks = R.chunk_fixed(docs, 64)
    rows = R.search_contexts(R.BM25(chunks.select(F.col("chunk_id").alias("doc_id"), "text")), chunks, docs, asked(s, d), 5, 100)
    photos = F.size(F.map_filter("context_photo_flags", lambda k, v: v)).alias("n_photos")
    return rows.select("query_id", F.array_join("context_doc_ids", ",").alias("ids"), "context_text", photos)


@query(f"WITH {HITS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 5")
def encoded_search(s, d):
    """Texts through the pluggable encoder (here a deterministic hash), then exact search."""
    retriever = R.Dense(table(s, d, "documents").select("doc_id", "text"), R.hashing_encoder)
    return retriever.search_batch(asked(s, d), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _scheme_hits(sql: str) -> str:
    """SQL: the first ten documents of every question by BM25 over chunks, 100 chunks deep."""
    deep = _CHUNKED.replace("rank <= 25", "rank <= 100")
    return f"""(WITH chunks AS ({sql}), {deep},
        parents AS (SELECT query_id, parent_doc_id, min(rank) AS best FROM bm25 JOIN tok USING (doc_id) GROUP BY ALL)
        SELECT query_id, CAST(parent_doc_id AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM parents)"""


_STUDY = " UNION ALL ".join(f"SELECT '{name}' AS scheme, * FROM {_scheme_hits(sql)}" for name, sql in {"fixed_token_64": fixed_sql(64), "whole_review": WHOLE}.items())


@query(
    f"""WITH {HITS}, shown AS ({_STUDY}), w AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
    f AS (SELECT scheme, s.query_id, s.rank FROM shown s SEMI JOIN qrels r ON r.query_id = s.query_id AND r.doc_id = s.doc_id),
    g AS (SELECT scheme, query_id, n_rel, k, (SELECT count(*) FROM f WHERE f.scheme = a.scheme AND f.query_id = w.query_id AND f.rank <= k) / n_rel AS recall
        FROM w CROSS JOIN (VALUES ('fixed_token_64'), ('whole_review')) a(scheme) CROSS JOIN (VALUES (1), (5), (10)) b(k))
    SELECT scheme, k, round(avg(recall), 6) AS recall_mean, count(*) AS n_questions FROM g GROUP BY ALL"""
)
def chunking_study(s, d):
    """Chunks of 64 words against whole documents, by recall; the intervals are checked elsewhere."""
    schemes = {"fixed_token_64": ChunkingConfig("fixed_token", 64), "whole_review": ChunkingConfig("whole_review")}
    table_, _ = studies.chunking_study(table(s, d, "documents"), schemes, asked(s, d), relevant(s, d), (1, 5, 10))
    return table_.select("scheme", "k", F.round("recall_mean", 6).alias("recall_mean"), "n_questions")


@query()
def retrieval_study(s, d):
    """The whole comparison of two retrievers: means, intervals of 10,000 resamples, p-values."""
    builders = {"bm25": R.BM25, "dense": lambda chunks: R.Dense(chunks, R.hashing_encoder)}
    found, _, _ = studies.retrieval_study(builders, R.chunk_whole(table(s, d, "documents")), asked(s, d), relevant(s, d), (1, 3, 5, 10), "the of and")
    return found


@query(
    f"""WITH {HITS}, recall AS (SELECT query_id, count(*) FILTER (WHERE retriever = 'bm25') AS a, count(*) FILTER (WHERE retriever = 'dense') AS b FROM hits SEMI JOIN qrels USING (query_id, doc_id) WHERE rank <= 5 GROUP BY query_id),
    chosen AS (SELECT query_id, CASE WHEN a > b THEN 'bm25' ELSE 'dense' END AS winner FROM recall WHERE a <> b)
    SELECT h.query_id, winner, retriever, rank, h.doc_id, round(score, 5) AS score, md5(left(text, 200)) AS snippet, q.doc_id IS NOT NULL AS is_relevant
    FROM hits h JOIN chosen USING (query_id) JOIN documents d ON d.doc_id = h.doc_id LEFT JOIN qrels q ON q.query_id = h.query_id AND q.doc_id = h.doc_id WHERE rank <= 5"""
)
def winloss_detail(s, d):
    hits, qrels = studied(s, d)
    good = hits.where("rank <= 5").join(qrels, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count_if(F.expr("retriever = 'bm25'")).alias("a"), F.count_if(F.expr("retriever = 'dense'")).alias("b"))
    chosen = good.where("a <> b").select("query_id", F.when(F.col("a") > F.col("b"), "bm25").otherwise("dense").alias("winner"))
    rows = studies.winloss_details(hits, chosen, table(s, d, "documents"), qrels)
    return rows.withColumns({"score": F.round("score", 5), "snippet": F.md5("snippet")})
