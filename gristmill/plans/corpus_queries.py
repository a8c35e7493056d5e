"""Queries of joins, aggregates, windows and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import benchmark, corpus
from gristmill.plans.registry import query, table
from gristmill.plans.text_queries import KEYWORDS

WEIGHTS = {"o_orderstatus": {"F": 0.5, "O": 0.3, "P": 0.2}, "size": {"big": 0.35, "small": 0.65}}
TARGET = 1000


def strata(s, d):
    return table(s, d, "orders").withColumn("size", F.when(F.col("o_totalprice") > 250000, "big").otherwise("small"))


STRATA = "(SELECT *, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size FROM orders)"
TARGETS = (
    "(SELECT * FROM (VALUES "
    + ", ".join(f"('{c[0]}', '{c[1]}', CAST({n} AS BIGINT))" for c, n in corpus.joint_targets(WEIGHTS, TARGET))
    + ") t(o_orderstatus, size, target))"
)
# The same targets from the weights alone.
JOINT = """WITH a(o_orderstatus, w, i) AS (VALUES ('F', 0.5::DOUBLE, 0), ('O', 0.3::DOUBLE, 1), ('P', 0.2::DOUBLE, 2)), b(size, v, j) AS (VALUES ('big', 0.35::DOUBLE, 0), ('small', 0.65::DOUBLE, 1)),
    c AS (SELECT o_orderstatus, size, i, j, w * v * 1000 AS x FROM a, b),
    f AS (SELECT *, CAST(floor(x) AS BIGINT) AS whole, row_number() OVER (ORDER BY x - floor(x) DESC, i, j) AS r FROM c)
    SELECT o_orderstatus, size, whole + CASE WHEN r <= 1000 - (SELECT sum(whole) FROM f) THEN 1 ELSE 0 END AS target FROM f"""


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment, c_custkey IS NOT NULL AS matched FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_m1_left(s, d):
    joined = corpus.join_m1(table(s, d, "orders"), table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return joined.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", F.col("_matched").alias("matched"))


@query("SELECT o_custkey, o_orderkey AS first_order, o_orderstatus AS product_status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def join_prepare_dedup(s, d):
    return corpus.prepare_right(table(s, d, "orders"), "o_custkey", {"o_orderkey": "first_order", "o_orderstatus": "product_status"}, "o_orderdate", "o_orderkey").select("o_custkey", "first_order", "product_status")


@query(
    """SELECT count(*) AS n_rows, count(o_custkey) AS n_matched, count(*) - count(o_custkey) AS n_unmatched, round(count(o_custkey) / count(*), 4) AS match_rate,
    (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS duplicate_keys FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey"""
)
def join_report(s, d):
    orders = table(s, d, "orders")
    side = corpus.keep_first(orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    joined = corpus.join_m1(table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), side, "o_custkey")
    doubles = orders.agg((F.count("o_custkey") - F.count_distinct("o_custkey")).alias("k"))
    return corpus.join_report(joined).drop("duplicate_keys").crossJoin(F.broadcast(doubles.withColumnRenamed("k", "duplicate_keys")))  # one row each


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_inner_required(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    return corpus.require_match(lines, orders, ["l_orderkey"])


@query(
    """WITH q AS (SELECT doc_id, quality = 0 AS is_negative, n_chars > 1000 AS image_target FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT conv_id AS doc_id, array_to_string(list_sort(list(turn)), ',') AS ids FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
    SELECT q.doc_id AS question_id, coalesce(ids, '') AS relevant_ids, CASE WHEN image_target THEN p END AS best_photo_id
    FROM q LEFT JOIN r USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, CAST(max(turn) AS VARCHAR) AS p FROM conversations GROUP BY conv_id) USING (doc_id)"""
)
def assemble_multiway(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    questions = docs.select(F.col("doc_id").alias("question_id"), (F.col("quality") == 0).alias("is_negative"), (F.col("n_chars") > 1000).alias("image_target"))
    turns = table(s, d, "conversations").withColumnRenamed("conv_id", "question_id")
    qrels = turns.where("role = 'assistant'").select("question_id", F.col("turn").cast("string").alias("doc_id"))
    photos = turns.groupBy("question_id").agg(F.max("turn").cast("string").alias("doc_id"))
    answers = turns.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    out = benchmark.assemble(questions, qrels, answers, photos)
    return out.select("question_id", F.array_join("relevant_ids", ",").alias("relevant_ids"), "best_photo_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing_labels(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    r"""WITH p AS (SELECT doc_id, sha256(lower(array_to_string(list_filter(string_split_regex(p, '\s+'), lambda w: w <> ''), ' '))) AS h
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents)),
    b AS (SELECT DISTINCT sha256(lower(array_to_string(list_filter(string_split_regex(p, '\s+'), lambda w: w <> ''), ' '))) AS h
        FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM benchmark))
    SELECT doc_id, h AS question_hash FROM p SEMI JOIN b USING (h)"""
)
def semi_leak_check(s, d):
    lines = [table(s, d, t).select(k, F.explode(F.split("text", "\n")).alias("text")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    return benchmark.leaks(lines[0], lines[1]).select("doc_id", "question_hash")


@query("SELECT a.event_id AS a, b.event_id AS b FROM (SELECT event_id, nullif(user_id, 5) AS u FROM events WHERE event_type = 'error') a JOIN (SELECT nullif(user_id, 5) AS u, min(event_id) AS event_id FROM events GROUP BY 1) b ON a.u IS NOT DISTINCT FROM b.u")
def join_null_safe(s, d):
    events = table(s, d, "events").withColumn("u", F.nullif("user_id", F.lit(5)))
    first = events.groupBy("u").agg(F.min("event_id").alias("b"))
    joined = corpus.join_m1(events.where("event_type = 'error'").select(F.col("event_id").alias("a"), "u"), first, "u", null_safe=True)
    return joined.where("_matched").select("a", "b")


_TERMS = [t for terms in KEYWORDS.values() for t in terms]
_COUNT = {t: rf"count(*) FILTER (WHERE regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{t})(?:$|[^\p{{L}}\p{{N}}_])'))" for t in _TERMS}


@query(
    " UNION ALL ".join(
        rf"""SELECT '{c}' AS category, count(*) FILTER (WHERE regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(terms)})(?:$|[^\p{{L}}\p{{N}}_])')) AS n_matching,
        count(*) FILTER (WHERE regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(terms)})(?:$|[^\p{{L}}\p{{N}}_])')) * 100.0::DOUBLE / count(*) AS pct, {' + '.join(_COUNT[t] for t in terms)} AS term_rows FROM documents"""
        for c, terms in KEYWORDS.items()
    )
)
def vocab_coverage(s, d):
    return corpus.vocab_coverage(table(s, d, "documents"), "text", KEYWORDS, 2).drop("top_terms")


@query(r"SELECT coalesce(100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 2000) / nullif(count(*), 0), 0) AS pct FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:the|und)(?:$|[^\p{L}\p{N}_])')")
def image_coverage(s, d):
    rows = table(s, d, "documents").where(X.matches_any("text", ["the", "und"]))
    return rows.agg(F.coalesce(F.try_divide(F.count_if(F.expr("n_chars > 2000")) * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("pct"))


_SPEC = [("de", 100, 5), ("en", 200, 20), ("es", 50, 5), ("fr", 10, 0), ("it", 10, 0)]
SPEC = "(VALUES " + ", ".join(f"('{c}', {n}, {m})" for c, n, m in _SPEC) + ") spec(category, target, negative)"


def spec(s):
    return s.createDataFrame(_SPEC, "category string, target long, negative long")


@query(f"SELECT category, count(doc_id) AS n, count(*) FILTER (WHERE quality = 0) AS n_negative, count(doc_id) = target AS ok FROM {SPEC} LEFT JOIN (SELECT * FROM documents JOIN labels USING (doc_id)) ON lang = category GROUP BY category, target")
def curation_counts(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("lang").alias("category"), (F.col("quality") == 0).alias("is_negative"))
    return benchmark.curation_counts(rows, spec(s)).select("category", "n", "n_negative", (F.col("n") == F.col("target")).alias("ok"))


@query(f"SELECT category, abs(coalesce(n, 0) - target) AS off FROM {SPEC} LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = category WHERE coalesce(n, 0) <> target")
def validate_curation(s, d):
    rows = table(s, d, "documents").select(F.col("lang").alias("category"), F.lit(False).alias("is_negative"))
    return benchmark.curation_counts(rows, spec(s)).select("category", F.abs(F.col("n") - F.col("target")).alias("off")).where("off <> 0")


@query(f"SELECT CAST(sum(target) AS BIGINT) AS total, CAST(sum(negative) AS BIGINT) AS negatives, round(100.0::DOUBLE * sum(negative) / sum(target), 6) AS negative_pct FROM {SPEC}")
def taxonomy_totals(s, d):
    return spec(s).agg(F.sum("target").alias("total"), F.sum("negative").alias("negatives"), F.round(F.sum("negative") * 100.0 / F.sum("target"), 6).alias("negative_pct"))


@query(
    f"""WITH cover AS (SELECT lang AS category, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents) AS pct FROM documents GROUP BY lang)
    SELECT category, problem FROM (SELECT category, unnest(list_filter([CASE WHEN negative = 0 THEN 'no_negatives' END, CASE WHEN coalesce(pct, 0) < 1 THEN 'below_floor' WHEN pct < 15 THEN 'low' END], lambda x: x IS NOT NULL)) AS problem
    FROM {SPEC} LEFT JOIN cover USING (category)) UNION ALL SELECT NULL, 'total' FROM {SPEC} HAVING abs(sum(target) - 400) > 5"""
)
def validate_taxonomy(s, d):
    docs = table(s, d, "documents")
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over one row per category
    cover = docs.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n")).select("category", (F.col("n") * 100.0 / total).alias("pct"))
    return benchmark.taxonomy_problems(spec(s), cover, 400, 5, 15.0, 1.0)


@query(
    r"""SELECT count(*) AS n_all, count(*) FILTER (WHERE length(text) >= 500) AS long_enough, count(*) FILTER (WHERE length(text) >= 500 AND lang = 'en') AS english,
    count(*) FILTER (WHERE length(text) >= 500 AND lang = 'en' AND source < 'src5') AS sourced FROM documents"""
)
def filter_step_counts(s, d):
    return corpus.filter_step_counts(table(s, d, "documents"), {"long_enough": F.length("text") >= 500, "english": F.col("lang") == "en", "sourced": F.col("source") < "src5"})


@query("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity ORDER BY l_quantity")
def value_counts(s, d):
    return table(s, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).orderBy("l_quantity")


@query("SELECT least(n, 16) AS group_size, count(*) AS n_groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1")
def group_size_capped(s, d):
    return corpus.group_sizes_capped(table(s, d, "orders"), "o_custkey", 16)


@query(
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), t AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 15)
    SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1"""
)
def topn_plus_other(s, d):
    return corpus.topn_plus_other(table(s, d, "part"), "p_brand", 15)


@query("SELECT round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.95) AS p95, max(n_chars) AS most, count(DISTINCT source) AS sources, round(avg(CASE WHEN lang = 'en' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pct_en FROM documents")
def summary_quantiles(s, d):
    return table(s, d, "documents").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.percentile("n_chars", 0.5).alias("median"), F.percentile("n_chars", 0.95).alias("p95"), F.max("n_chars").alias("most"), F.count_distinct("source").alias("sources"), F.round(F.avg(F.when(F.col("lang") == "en", 100.0).otherwise(0.0)), 6).alias("pct_en"))


@query("WITH j AS (SELECT quality, toxic, lang FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS null_rate FROM j" for c in ("quality", "toxic", "lang")))
def null_rate(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    parts = [F.struct(F.lit(c).alias("column"), F.round(F.avg(F.isnull(c).cast("int")), 6).alias("null_rate")) for c in ("quality", "toxic", "lang")]
    return rows.agg(F.array(*parts).alias("c")).select(F.inline("c"))


@query("SELECT CAST(least(floor(ln(greatest(CAST(n_chars AS DOUBLE), 1.0)) / (ln(100000.0::DOUBLE) / 60)), 59) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def log_histogram(s, d):
    return corpus.log_histogram(table(s, d, "documents"), "n_chars", 60, 100000.0)


@query("SELECT lang, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def normalized_value_counts(s, d):
    counts = table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@query("SELECT text, source, min(doc_id) AS doc_id FROM documents GROUP BY text, source")
def dedup_keep_first(s, d):
    return corpus.keep_first(table(s, d, "documents").select("doc_id", "text", "source"), ["text", "source"], "doc_id")


@query("SELECT item_id, doc_lang || '_neg_' || lpad(CAST(row_number() OVER (PARTITION BY doc_lang ORDER BY item_id) - 1 AS VARCHAR), 3, '0') AS id FROM (SELECT doc_id AS item_id, lang AS doc_lang FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def sequential_ids(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels").where("quality = 0"), "doc_id").select(F.col("doc_id").alias("item_id"), "lang")
    return benchmark.negative_ids(rows, "lang", "item_id").select("item_id", "id")


@query(JOINT)
def joint_targets(s, d):
    return corpus.targets_frame(s, WEIGHTS, TARGET)


@query(f"SELECT o_orderkey, o_orderstatus, size FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, size ORDER BY md5('42:' || o_orderkey)) AS r FROM {STRATA}) JOIN {TARGETS} USING (o_orderstatus, size) WHERE r <= target")
def stratified_sample(s, d):
    rows = strata(s, d).select("o_orderkey", "o_orderstatus", "size")
    return corpus.stratified_sample(rows, corpus.targets_frame(s, WEIGHTS, TARGET), list(WEIGHTS), "o_orderkey", 42).select("o_orderkey", "o_orderstatus", "size")


@query(f"SELECT o_orderstatus, size, target, coalesce(n, 0) AS available, least(coalesce(n, 0), target) AS sampled, target - least(coalesce(n, 0), target) AS shortfall FROM {TARGETS} LEFT JOIN (SELECT o_orderstatus, size, count(*) AS n FROM {STRATA} GROUP BY ALL) USING (o_orderstatus, size)")
def sampling_report(s, d):
    return corpus.sampling_report(strata(s, d), corpus.targets_frame(s, WEIGHTS, TARGET), list(WEIGHTS))


@query(f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, size ORDER BY o_orderkey) AS r FROM {STRATA}) JOIN {TARGETS} USING (o_orderstatus, size) WHERE r <= ceil(target * 1.5::DOUBLE)")
def capped_pool(s, d):
    rows = strata(s, d).select("o_orderkey", "o_orderstatus", "size")
    return corpus.capped_pool(rows, corpus.targets_frame(s, WEIGHTS, TARGET), list(WEIGHTS), "o_orderkey", 1.5).select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_key(s, d):
    return corpus.duplicate_keys(table(s, d, "orders"), "o_custkey")


@query(
    """WITH p AS (SELECT doc_id AS id FROM documents), a AS (SELECT doc_id AS id FROM labels WHERE quality = 1), r AS (SELECT doc_id AS id FROM labels WHERE quality = 0 OR toxic = 1)
    SELECT id, 'both' AS problem FROM a SEMI JOIN r USING (id) UNION ALL SELECT id, 'missing' FROM p ANTI JOIN (FROM a UNION FROM r) x USING (id)"""
)
def intersect_decisions(s, d):
    labels = table(s, d, "labels").withColumnRenamed("doc_id", "id")
    passed = table(s, d, "documents").select(F.col("doc_id").alias("id"))
    return benchmark.decision_problems(passed, labels.where("quality = 1").select("id"), labels.where("quality = 0 OR toxic = 1").select("id"))


@query(
    r"""SELECT doc_id, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 400) AS snippet FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:the|und)(?:$|[^\p{L}\p{N}_])')
    ORDER BY md5('42:' || doc_id) LIMIT 8"""
)
def context_sample(s, d):
    return benchmark.context_sample(table(s, d, "documents"), "text", ["the", "und"], 8, 42, 400, "doc_id")


@query()
def fuzzy_dedup(s, d):
    # The table has no categories, so all its questions are of one.
    return benchmark.fuzzy_dedup(table(s, d, "benchmark").withColumn("category", F.lit("all")), "category", "item_id", "text").select("item_id")


@query("""SELECT DISTINCT sha256('{"model":"echo","prompt":"' || md5(text) || '"}') AS key, upper(md5(text)) AS response FROM benchmark""")
def response_cache(s, d):
    """Every question's digest as a prompt, half of them answered before; the model says it in capitals."""
    prompts = table(s, d, "benchmark").select("item_id", F.md5("text").alias("prompt"))
    middle = prompts.agg(F.percentile_approx("item_id", 0.5)).first()[0]
    call, settings = lambda p: p.upper(), {"model": "echo"}
    earlier = benchmark.complete(prompts.where(F.col("item_id") <= middle), None, call, settings)
    return benchmark.complete(prompts, earlier, call, settings).select("key", "response")
