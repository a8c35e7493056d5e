"""Queries of metrics, statistics and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import answers as answer_ops
from gristmill.operators import benchmark
from gristmill.operators import evaluation as E
from gristmill.operators import retrieval as R
from gristmill.operators.corpus import with_place
from gristmill.plans.registry import query, table
from gristmill.plans.retrieval_queries import _POOL, HITS, asked, both_hits, relevant
from gristmill.plans.text_queries import REPLIES, SENTENCE, replies

KS = (1, 3, 5, 10)

SCORES = f"""WITH {HITS}, w AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
    f AS (SELECT h.retriever, h.query_id, h.rank FROM hits h SEMI JOIN qrels r ON r.query_id = h.query_id AND r.doc_id = h.doc_id),
    g AS (SELECT retriever, query_id, n_rel, k FROM w CROSS JOIN (VALUES ('bm25'), ('dense')) a(retriever) CROSS JOIN (VALUES (1), (3), (5), (10)) b(k)),
    scores AS (SELECT g.retriever, g.query_id, g.k, count(f.rank) / any_value(n_rel) AS recall, CASE WHEN count(f.rank) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit,
        coalesce(sum(1 / log2(f.rank + 1.0)), 0) / list_sum(list_transform(range(1, 1 + least(g.k, any_value(n_rel))), lambda r: 1 / log2(r + 1.0))) AS ndcg, coalesce(1 / min(f.rank), 0) AS mrr
        FROM g LEFT JOIN f ON f.retriever = g.retriever AND f.query_id = g.query_id AND f.rank <= g.k GROUP BY g.retriever, g.query_id, g.k)"""


def scores(s, d):
    """Long table of all metrics for two retrievers."""
    hits, pairs = both_hits(s, d), relevant(s, d)
    one = [E.score_all(hits.where(F.col("retriever") == name), pairs, KS).withColumn("retriever", F.lit(name)) for name in ("bm25", "dense")]
    return one[0].unionByName(one[1])


def _rounded(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def _metric(name):
    def run(s, d):
        return _rounded(scores(s, d).select("retriever", "query_id", "k", name), name)

    run.__name__ = {"recall": "recall_at_k", "hit": "hit_at_k", "ndcg": "ndcg_at_k", "mrr": "mrr"}[name]
    return query(f"{SCORES} SELECT retriever, query_id, k, round({name}, 6) AS {name} FROM scores")(run)


for _name in E.METRICS:
    _metric(_name)


@query(f"{SCORES} SELECT retriever, query_id, k, round(recall, 6) AS recall, hit, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM scores")
def score_all(s, d):
    return _rounded(scores(s, d), "recall", "ndcg", "mrr")


@query(f"{SCORES} SELECT retriever, query_id, k, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM scores WHERE retriever = 'dense'")
def score_long(s, d):
    return _rounded(E.score_all(both_hits(s, d).where("retriever = 'dense'"), relevant(s, d), KS), "recall", "ndcg").select(F.lit("dense").alias("retriever"), "query_id", "k", "recall", "ndcg")


_BOOT = """lists AS (SELECT retriever, k, list(recall ORDER BY query_id) AS v FROM scores GROUP BY ALL),
    m AS (SELECT retriever, k, b, avg(v[1 + CAST(('0x' || substr(md5('42:' || b || ':' || i), 1, 8))::BIGINT % len(v) AS INTEGER)]) AS m
        FROM (SELECT *, unnest(range(len(v))) AS i FROM lists CROSS JOIN range(10000) r(b)) GROUP BY ALL),
    ci AS (SELECT retriever, k, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY ALL)"""


def intervals(s, d):
    return _rounded(E.bootstrap_ci_md5(s, scores(s, d), ["retriever", "k"], "query_id", "recall", 10_000), "low", "high")


@query(f"{SCORES}, {_BOOT}, a AS (SELECT retriever, k, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, count(*) AS n FROM scores GROUP BY ALL) SELECT * FROM a JOIN ci USING (retriever, k)")
def metric_summary(s, d):
    means = _rounded(E.summarize(scores(s, d), "retriever", "k"), *E.METRICS)
    return means.join(intervals(s, d), ["retriever", "k"]).orderBy("k", "retriever")


@query(f"{SCORES}, {_BOOT}, a AS (SELECT retriever, k, round(avg(recall), 6) AS recall, count(*) AS n FROM scores GROUP BY ALL) SELECT retriever AS scheme, k, recall, n, low, high FROM a JOIN ci USING (retriever, k)")
def recall_summary(s, d):
    means = _rounded(E.summarize(scores(s, d).select("retriever", "k", "recall"), "retriever", "k"), "recall")
    return means.join(intervals(s, d), ["retriever", "k"]).withColumnRenamed("retriever", "scheme").orderBy("scheme", "k")


_TYPED = f"{SCORES}, typed AS (SELECT s.*, type FROM scores s JOIN asked USING (query_id))"


def typed(s, d):
    return scores(s, d).join(asked(s, d).select("query_id", "type"), "query_id")


@query(f"{_TYPED} SELECT retriever, type, round(avg(recall), 6) AS recall, count(*) AS n FROM typed WHERE k = 5 GROUP BY ALL")
def recall_by_type(s, d):
    return _rounded(E.summarize(typed(s, d).where("k = 5").select("retriever", "type", "recall"), "retriever", "type"), "recall")


@query(
    f"""{_TYPED}, p AS (SELECT type, round(avg(recall) FILTER (WHERE retriever = 'dense'), 6) AS dense, round(avg(recall) FILTER (WHERE retriever = 'bm25'), 6) AS bm25 FROM typed WHERE k = 10 GROUP BY type)
    SELECT *, CASE WHEN abs(dense - bm25) < 1e-9 THEN 'tie' WHEN dense > bm25 THEN 'dense' ELSE 'bm25' END AS leader FROM p"""
)
def pivot_retriever(s, d):
    wide = typed(s, d).where("k = 10").groupBy("type").pivot("retriever", ["dense", "bm25"]).agg(F.round(F.avg("recall"), 6))
    leader = F.when(F.abs(F.col("dense") - F.col("bm25")) < 1e-9, "tie").when(F.col("dense") > F.col("bm25"), "dense").otherwise("bm25")
    return wide.withColumn("leader", leader)


_DIFF = f"{SCORES}, dif AS (SELECT query_id, round(max(recall) FILTER (WHERE retriever = 'dense') - max(recall) FILTER (WHERE retriever = 'bm25'), 6) AS diff FROM scores WHERE k = 10 GROUP BY query_id)"


def diffs(s, d):
    wide = scores(s, d).where("k = 10").groupBy("query_id").pivot("retriever", ["dense", "bm25"]).agg(F.first("recall"))
    return wide.select("query_id", F.round(F.col("dense") - F.col("bm25"), 6).alias("diff"))


@query(f"{_DIFF} SELECT query_id, diff FROM dif WHERE diff <> 0")
def pivot_diff(s, d):
    return diffs(s, d).where("diff <> 0")


@query(f"{_DIFF} SELECT query_id, diff, winner, place FROM (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY abs(diff) DESC, query_id) AS place FROM (SELECT *, CASE WHEN diff > 0 THEN 'a' ELSE 'b' END AS winner FROM dif WHERE diff <> 0)) WHERE place <= 4")
def lopsided_topn(s, d):
    return E.lopsided(diffs(s, d), 4)


_PAIRS = f"{SCORES}, pairs AS (SELECT k, query_id, max(recall) FILTER (WHERE retriever = 'dense') AS a, max(recall) FILTER (WHERE retriever = 'bm25') AS b FROM scores GROUP BY ALL)"


def _pairs(s, d):
    rows = scores(s, d)
    return E.paired(rows.where("retriever = 'dense'"), rows.where("retriever = 'bm25'"), ["k", "query_id"], "recall")


@query(f"{_PAIRS} SELECT k, query_id, round(a, 6) AS a, round(b, 6) AS b FROM pairs")
def paired_join(s, d):
    return _rounded(_pairs(s, d), "a", "b")


# Orders stand in for questions: enough pairs for the normal approximation.
_RANKED = """WITH pairs AS (SELECT l_returnflag AS k, round(CAST(l_quantity AS DOUBLE) - floor(l_extendedprice / 4000), 6) AS dd FROM lineitem),
    nz AS (SELECT k, dd, abs(dd) AS size FROM pairs WHERE dd <> 0),
    r AS (SELECT k, dd, rank() OVER (PARTITION BY k ORDER BY size) + (count(*) OVER (PARTITION BY k, size) - 1) / 2 AS r FROM nz),
    sums AS (SELECT k, count(*) AS n, sum(CASE WHEN dd > 0 THEN r ELSE 0 END) AS plus, sum(r) AS everything FROM r GROUP BY k),
    ties AS (SELECT k, sum(c * c * c - c) AS ties FROM (SELECT k, size, CAST(count(*) AS HUGEINT) AS c FROM nz GROUP BY ALL) GROUP BY k),
    st AS (SELECT k, n, least(plus, everything - plus) AS t, CAST(n AS DOUBLE) AS m, CAST(ties AS DOUBLE) AS ties FROM sums JOIN ties USING (k))"""


@query(f"{_RANKED} SELECT k, n, round(t, 3) AS t, round(abs(t - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24), 6) AS z FROM st")
def wilcoxon(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("a"), F.floor(F.col("l_extendedprice") / 4000).cast("double").alias("b"))
    return E.signed_rank_parts(rows, ["k"]).select("k", "n", F.round("t", 3).alias("t"), F.round("z", 6).alias("z"))


@query()
def wilcoxon_p(s, d):
    rows = scores(s, d)
    return E.significance(s, rows.where("retriever = 'dense'"), rows.where("retriever = 'bm25'"), "recall")


_SIGNED = """nz AS (SELECT k, round(a - b, 12) AS dd, abs(round(a - b, 12)) AS size FROM pairs WHERE round(a - b, 12) <> 0),
    r AS (SELECT k, dd, rank() OVER (PARTITION BY k ORDER BY size) + (count(*) OVER (PARTITION BY k, size) - 1) / 2 AS r FROM nz),
    sums AS (SELECT k, count(*) AS n, sum(CASE WHEN dd > 0 THEN r ELSE 0 END) AS plus, sum(r) AS everything FROM r GROUP BY k),
    ties AS (SELECT k, sum(c * c * c - c) AS ties FROM (SELECT k, size, CAST(count(*) AS HUGEINT) AS c FROM nz GROUP BY ALL) GROUP BY k),
    st AS (SELECT k, n, least(plus, everything - plus) AS t, CAST(n AS DOUBLE) AS m, CAST(ties AS DOUBLE) AS ties FROM sums JOIN ties USING (k)),
    sig AS (SELECT k, n AS n_different, round(abs(t - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24), 6) AS z FROM st)"""


@query(f"{_PAIRS}, {_SIGNED}, a AS (SELECT retriever, k, round(avg(recall), 6) AS recall FROM scores GROUP BY ALL) SELECT retriever, k, recall, n_different, z FROM a LEFT JOIN sig USING (k)")
def significance_broadcast(s, d):
    """The test's statistic beside both retrievers' means; its p-value is in ``wilcoxon_p``."""
    sig = E.signed_rank_parts(_pairs(s, d), ["k"]).select("k", F.col("n").alias("n_different"), F.round("z", 6).alias("z"))
    summary = _rounded(E.summarize(scores(s, d).select("retriever", "k", "recall"), "retriever", "k"), "recall").drop("n")
    return summary.join(F.broadcast(sig), "k", "left").orderBy("k", "retriever")  # one row per k


@query()
def bootstrap_ci(s, d):
    return E.bootstrap_ci_frame(scores(s, d), ["retriever", "k"], "query_id", "recall")


@query(f"{SCORES}, {_BOOT} SELECT * FROM ci")
def bootstrap_ci_md5(s, d):
    return intervals(s, d)


@query("SELECT 'plain' AS arm, a.vec_id AS question_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_similarity(s, d):
    """Each vector against its successor's; the last one has none and isn't asked."""
    rows = table(s, d, "embeddings").select(F.lit("plain").alias("arm"), F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    references = rows.select((F.col("question_id") - 1).alias("question_id"), "vector")
    return _rounded(E.similarity(rows.join(references.select("question_id"), "question_id", "left_semi"), references), "similarity")


def transcripts(s, d):
    """Replies with the context [turn, 7] and the gold ids [turn, conv_id]."""
    text = lambda *c: F.array(*(F.col(x).cast("string") if isinstance(x, str) else x for x in c))
    rows = replies(s, d).withColumns({"context_doc_ids": text("turn", F.lit("7")), "gold": text("turn", "conv_id"), "expected": F.col("role") == "user"})
    parts = X.completion_parts("reply", SENTENCE)
    return rows.select("*", parts.alias("p")).select("*", "p.*").drop("p").withColumnRenamed("reply", "raw_completion")


_CITED = f"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id = turn THEN 1 ELSE 2 END AS n, (CASE WHEN conv_id = turn THEN 1 ELSE 2 END) - (CASE WHEN conv_id = turn THEN 1 ELSE 1 + CASE WHEN conv_id = 7 THEN 1 ELSE 0 END END) AS fabricated,
    contains(reply, '{SENTENCE}') AS abstained FROM {REPLIES} r)"""


@query(f"{_CITED} SELECT conv_id, turn, FALSE AS format_ok, n AS n_citations, fabricated AS n_fabricated, (n - fabricated) / n AS citation_validity_rate, n AS n_grounded_in_gold, abstained = (role = 'user') AS abstention_correct, abstained AS self_contradiction, FALSE AS ungrounded FROM t")
def citation_score(s, d):
    out = E.citation_scores(transcripts(s, d), "gold", "expected")
    return out.select("conv_id", "turn", "format_ok", "n_citations", "n_fabricated", "citation_validity_rate", "n_grounded_in_gold", "abstention_correct", "self_contradiction", "ungrounded")


@query(f"{_CITED} SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS n_citations, round((sum(n) - sum(fabricated)) / sum(n), 6) AS validity, 1.0::DOUBLE AS gold_grounding, 0.0::DOUBLE AS format_rate, round(avg(CASE WHEN abstained = (role = 'user') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS abstention_accuracy FROM t")
def citation_summary(s, d):
    return _rounded(E.citation_summary(E.citation_scores(transcripts(s, d), "gold", "expected")), "validity", "gold_grounding", "format_rate", "abstention_accuracy")


@query(f"SELECT conv_id, turn, CASE WHEN turn = conv_id OR conv_id = 7 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS outside FROM {REPLIES} r")
def except_cited(s, d):
    return transcripts(s, d).select("conv_id", "turn", F.array_join(F.array_except("cited_doc_ids", "context_doc_ids"), ",").alias("outside"))


@query(f"WITH {HITS} SELECT query_id, retriever, CAST(count(q.doc_id) AS INTEGER) AS n_common FROM hits h LEFT JOIN qrels q USING (query_id, doc_id) GROUP BY ALL")
def set_metrics(s, d):
    return E.n_relevant_shown(both_hits(s, d), relevant(s, d))


_LABELS = "lab AS (SELECT p.query_id AS question_id, p.doc_id, CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END AS relevant FROM pooled p LEFT JOIN qrels r USING (query_id, doc_id) WHERE best_rank < 10)"


def labels(s, d):
    """Labels of the pooled pairs but those that only a last place brought in."""
    pooled = R.pool(both_hits(s, d))
    gold = relevant(s, d).withColumn("relevant", F.lit(1))
    given = pooled.where("best_rank < 10").join(gold, ["query_id", "doc_id"], "left").select(F.col("query_id").alias("question_id"), "doc_id", F.coalesce("relevant", F.lit(0)).alias("relevant"))
    return pooled.select(F.col("query_id").alias("question_id"), "doc_id"), given


@query(
    f"""{_POOL}, {_LABELS}, n AS (SELECT query_id AS question_id, is_negative, coalesce(sum(relevant), 0) AS n FROM asked SEMI JOIN pooled USING (query_id) LEFT JOIN lab ON question_id = query_id GROUP BY ALL)
    SELECT DISTINCT query_id AS question_id, 'unlabeled_pair' AS problem FROM pooled p WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.question_id = p.query_id AND l.doc_id = p.doc_id)
    UNION ALL SELECT question_id, CASE WHEN is_negative THEN 'negative_with_positive' ELSE 'answerable_without_positive' END FROM n WHERE is_negative = (n > 0)"""
)
def validate_labels(s, d):
    pooled, given = labels(s, d)
    negatives = asked(s, d).where("is_negative").select(F.col("query_id").alias("question_id"))
    return benchmark.label_problems(pooled, given, negatives)


@query(
    f"""{_POOL}, {_LABELS}, n AS (SELECT query_id, is_negative, coalesce(sum(relevant), 0) AS n FROM asked SEMI JOIN pooled USING (query_id) LEFT JOIN lab ON question_id = query_id GROUP BY ALL)
    SELECT count(*) AS n_questions, CAST(sum(n) AS BIGINT) AS n_positive, round_even(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 2) AS pct_with_positive,
        coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY CAST(query_id AS VARCHAR)) FILTER (WHERE NOT is_negative AND n = 0), '') AS zero_positive,
        coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY CAST(query_id AS VARCHAR)) FILTER (WHERE is_negative AND n > 0), '') AS unexpected_positive FROM n"""
)
def label_stats(s, d):
    pooled, given = labels(s, d)
    rows = benchmark.label_stats(pooled, given, asked(s, d).select(F.col("query_id").alias("question_id"), "is_negative"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("zero_positive", "unexpected_positive")})


def answers(s, d):
    """One answer per document that has labels; every source of trouble occurs."""
    docs = table(s, d, "documents").select("doc_id", "n_chars", "lang")
    rows = docs.join(table(s, d, "labels"), "doc_id", "left")
    text = F.col("doc_id").cast("string")
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("doc_id").alias("question_id"),
        F.when(F.col("n_chars") > 500, F.array(text)).otherwise(none).alias("relevant_ids"),
        F.when(F.col("lang") == "fr", F.array(text)).otherwise(none).alias("cited_doc_ids"),
        F.when(F.col("quality").isNotNull(), F.col("toxic") == 1).alias("is_abstention"),
        (F.col("lang") == "de").alias("is_negative"),
        F.when(F.col("lang") == "es", text).alias("best_photo_id"),
    )


_ANSWERS = """(SELECT doc_id AS question_id, n_chars > 500 AS has_rel, lang = 'fr' AS cites, CASE WHEN quality IS NOT NULL THEN toxic = 1 END AS ab, lang FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    f"""SELECT question_id, unnest(list_filter([CASE WHEN ab IS NULL THEN 'missing' END, CASE WHEN ab IS NOT NULL AND cites AND NOT has_rel THEN 'cites_non_relevant' END,
    CASE WHEN ab IS NOT NULL AND NOT ab AND NOT cites THEN 'uncited' END, CASE WHEN ab IS NOT NULL AND NOT ab AND NOT has_rel THEN 'answers_without_evidence' END,
    CASE WHEN ab AND has_rel THEN 'abstains_despite_evidence' END], lambda x: x IS NOT NULL)) AS problem FROM {_ANSWERS}"""
)
def validate_answers(s, d):
    return benchmark.answer_problems(answers(s, d))


@query(
    f"""SELECT question_id, unnest(list_filter([CASE WHEN lang <> 'de' AND NOT has_rel THEN 'no_relevant' END, CASE WHEN cites AND NOT has_rel THEN 'citation_not_relevant' END,
    CASE WHEN lang = 'es' AND NOT has_rel THEN 'photo_not_relevant' END], lambda x: x IS NOT NULL)) AS problem FROM {_ANSWERS}"""
)
def validate_entries(s, d):
    return benchmark.entry_problems(answers(s, d))


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'de') AS n_negative, count(*) FILTER (WHERE ab) AS n_abstention, count(*) FILTER (WHERE lang IN ('es', 'fr')) AS n_image_target,
    count(*) FILTER (WHERE lang = 'es') AS n_with_photo, round_even(100.0 * count(*) FILTER (WHERE lang = 'es') / count(*) FILTER (WHERE lang IN ('es', 'fr')), 2) AS image_coverage_pct,
    min(CAST(has_rel AS INTEGER)) AS min_relevant, max(CAST(has_rel AS INTEGER)) AS max_relevant, round_even(avg(CAST(has_rel AS INTEGER)), 2) AS mean_relevant,
    round_even(avg(CAST(cites AS INTEGER)) FILTER (WHERE NOT ab), 2) AS mean_citations FROM {_ANSWERS}"""
)
def datasheet_stats(s, d):
    rows = answers(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").isin("es", "fr").alias("image_target")), "question_id")
    return benchmark.datasheet_stats(rows)


@query(
    """WITH t AS (SELECT doc_id AS question_id, n_chars FROM documents WHERE lang = 'en'), p AS (SELECT doc_id AS question_id, CASE WHEN quality = 1 THEN doc_id END AS doc_id FROM labels)
    SELECT question_id, problem FROM (SELECT question_id, CASE WHEN p.question_id IS NULL THEN 'undecided' WHEN p.doc_id IS NOT NULL AND n_chars <= 1000 THEN 'not_a_candidate' WHEN p.doc_id IS NULL AND n_chars > 1000 THEN 'none_though_candidates' END AS problem
    FROM t LEFT JOIN p USING (question_id)) WHERE problem IS NOT NULL"""
)
def validate_photos(s, d):
    docs = table(s, d, "documents")
    targets = docs.where("lang = 'en'").select(F.col("doc_id").alias("question_id"))
    picks = table(s, d, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("doc_id"))
    candidates = docs.where("n_chars > 1000").select(F.col("doc_id").alias("question_id"), "doc_id")
    return benchmark.photo_problems(targets, picks, candidates)


@query("SELECT doc_id AS question_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def run_completeness(s, d):
    expected = table(s, d, "documents").select(F.col("doc_id").alias("question_id"))
    given = table(s, d, "labels").select(F.col("doc_id").alias("question_id"), F.lit("text").alias("answer_text"))
    return benchmark.completeness_problems(expected, given)


@query(
    """WITH e AS (SELECT row_number() OVER (ORDER BY doc_id) AS place, doc_id FROM documents), g AS (SELECT row_number() OVER (ORDER BY doc_id) AS place, doc_id FROM labels)
    SELECT place, e.doc_id AS expected_id, g.doc_id AS given_id FROM e FULL JOIN g USING (place) WHERE e.doc_id IS DISTINCT FROM g.doc_id"""
)
def run_order(s, d):
    """The labels as a run over all documents: from its first gap on it is out of order."""
    expected, given = (with_place(table(s, d, name).select(F.col("doc_id").alias("question_id"), F.lit(0).alias("run")), ["run"], "question_id", "place") for name in ("documents", "labels"))
    return benchmark.order_problems(expected, given)


@query(f"SELECT conv_id, turn, CASE WHEN conv_id = turn THEN 1 ELSE 2 END AS n_cited FROM {REPLIES} r WHERE NOT contains(reply, '{SENTENCE}')")
def reference_answers(s, d):
    """Replies as reference answers; those that abstain and cite would fail, and are left to a test."""
    rows = replies(s, d).where(~X.abstained("reply", SENTENCE)).select(F.struct("conv_id", "turn").alias("question_id"), F.col("reply").alias("answer"))
    return answer_ops.reference_answers(rows, SENTENCE).select("question_id.*", F.size("cited_doc_ids").alias("n_cited"))


@query("SELECT item_id, place FROM (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id DESC) AS INTEGER) AS place FROM benchmark)")
def select_in_order(s, d):
    """All questions, asked for in descending order."""
    ids = [r["item_id"] for r in table(s, d, "benchmark").select("item_id").orderBy(F.desc("item_id")).collect()]  # a benchmark's questions
    rows = answer_ops.select_in_order(table(s, d, "benchmark"), "item_id", ids)
    return rows.select("item_id", (F.monotonically_increasing_id() + 1).cast("int").alias("place"))


@query("WITH g AS (SELECT CAST(quality AS DOUBLE) AS a, CAST(toxic AS DOUBLE) AS b FROM labels) SELECT round(1 - avg((a - b) * (a - b)) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) AS kappa FROM g")
def cohen_kappa(s, d):
    return _rounded(E.cohen_kappa(table(s, d, "labels"), "quality", "toxic"), "kappa")
