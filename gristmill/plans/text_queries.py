"""Queries of scans, filters and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import benchmark, corpus
from gristmill.plans.registry import query, table
from gristmill.sources import readers, sinks

SENTENCE = "I cannot answer this from the reviews."
KEYWORDS = {"connectives": ("and", "und", "the"), "places": ("dans", "in", "auf"), "verbs": ("is", "est", "es", "was")}

WORDS = r"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json_props(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT count(*) AS n FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def count_records(s, d):
    return table(s, d, "documents").where(X.strip("text") != "").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, props FROM events ORDER BY event_id LIMIT 100")
def sample_head(s, d):
    return readers.sample_head(table(s, d, "events").select("event_id", "user_id", "props"), 100, "event_id")


_KINDS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) - count({c}) AS null_count, round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct, first(left(CAST({c} AS VARCHAR), 120) ORDER BY doc_id) FILTER (WHERE {c} IS NOT NULL) AS example FROM documents"
        for c, kind in _KINDS.items()
    )
)
def schema_summary(s, d):
    return readers.schema_summary(table(s, d, "documents"), "doc_id")


@query("SELECT doc_id, lang FROM documents")
def parquet_projection(s, d):
    return table(s, d, "documents").select("doc_id", "lang")


@query(
    """WITH h AS (SELECT md5(doc_id || ':' || text) AS h FROM documents),
    w AS (SELECT count(*) AS n, """
    + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS w{i}" for i in range(4))
    + " FROM h) SELECT n, md5(w0 || ':' || w1 || ':' || w2 || ':' || w3) AS fingerprint FROM w"
)
def content_fingerprint(s, d):
    return sinks.content_fingerprint(table(s, d, "documents").select(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text"))).alias("h")))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_whitespace(s, d):
    return corpus.normalize_columns(table(s, d, "documents"), ["text"]).select("doc_id", "text")


@query(f"SELECT doc_id, text FROM documents WHERE length({STRIP.format(c='text')}) >= 200")
def drop_empty_text(s, d):
    return corpus.drop_empty_text(table(s, d, "documents"), "text", 200).select("doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de')")
def filter_language(s, d):
    return corpus.filter_language(table(s, d, "documents"), ["en", "de"]).select("doc_id", "source")


_LANGUAGE = ", ".join(
    f"{corpus.WORD_WEIGHT} * len(list_filter(w, lambda x: list_contains([{', '.join(repr(w) for w in words)}], x)))" + (f" + len(regexp_extract_all(t, '[{corpus.LETTERS[code]}]'))" if corpus.LETTERS[code] else "") + f" AS {code}"
    for code, words in corpus.STOP_WORDS.items()
)


@query(
    rf"""WITH l AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS t, string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+') AS w FROM documents),
    n AS (SELECT doc_id, lang, {_LANGUAGE} FROM l)
    SELECT doc_id, lang, CASE greatest(de, en, es, fr) WHEN 0 THEN NULL WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END AS detected FROM n"""
)
def detect_language(s, d):
    return table(s, d, "documents").select("doc_id", "lang", corpus.detect_language("text").alias("detected"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity IN (1, 2) THEN '1-2' WHEN l_quantity = 3 THEN '3' WHEN l_quantity IN (4, 5) THEN '4-5' END AS rating_bucket,
    CAST(NULL AS VARCHAR) AS flag_bucket FROM lineitem"""
)
def rating_bucket(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", X.rating_bucket("l_quantity").alias("rating_bucket"), X.rating_bucket("l_returnflag").alias("flag_bucket"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)(?:^|[^\p{L}\p{N}_])(?:und|the|is)(?:$|[^\p{L}\p{N}_])')")
def keyword_filter(s, d):
    return table(s, d, "documents").where(X.matches_any("text", ["the", "und", "is"])).select("doc_id")


_REASON = f"""CASE WHEN len({WORDS.format(c='text')}) < 20 THEN 'too_short' WHEN len({WORDS.format(c='text')}) > 40 THEN 'too_long'
    WHEN NOT ends_with({STRIP.format(c='text')}, '?') THEN 'no_question_mark' END"""
_LIMITS = {"min_words": 20, "max_words": 40, "need_mark": True}


@query(f"SELECT item_id, {_REASON} AS reason FROM benchmark")
def question_quality(s, d):
    return table(s, d, "benchmark").select("item_id", benchmark.quality_reason("text", **_LIMITS).alias("reason"))


@query(
    f"""WITH q AS (SELECT conv_id, turn, {_REASON} AS reason FROM conversations)
    SELECT CASE WHEN reason IS NULL THEN 'passed' ELSE 'rejected' END AS side, reason, count(*) AS n FROM q GROUP BY ALL"""
)
def quality_split(s, d):
    passed, rejected = benchmark.quality_split(table(s, d, "conversations").withColumnRenamed("text", "question"), **_LIMITS)
    both = passed.withColumns({"side": F.lit("passed"), "reason": F.lit(None).cast("string")}).unionByName(rejected.withColumn("side", F.lit("rejected")))
    return both.groupBy("side", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def filter_scorable(s, d):
    relevant = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").join(relevant, "o_orderkey", "left_semi").select("o_orderkey")


@query(
    """WITH cover AS (SELECT lang, 100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 2000) / count(*) AS pct FROM documents GROUP BY lang)
    SELECT doc_id, coalesce(quality, 0) = 1 AND pct >= 40.0 AS image_target FROM documents JOIN cover USING (lang) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)"""
)
def image_target_flag(s, d):
    docs = table(s, d, "documents")
    cover = docs.groupBy(F.col("lang").alias("category")).agg((F.count_if(F.expr("n_chars > 2000")) * 100.0 / F.count(F.lit(1))).alias("pct"))
    good = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    questions = docs.join(good, "doc_id", "left").select("doc_id", F.col("lang").alias("category"), (F.coalesce("quality", F.lit(0)) != 1).alias("is_negative"))
    return benchmark.image_targets(questions, cover, 40.0).select("doc_id", "image_target")


_IMAGES_SQL = """CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority LIKE '1%' THEN [] ELSE [
    {'small_image_url': 's' || o_orderkey, 'medium_image_url': '', 'large_image_url': CASE WHEN o_orderstatus = 'F' THEN 'l' || o_orderkey END},
    {'small_image_url': '', 'medium_image_url': CASE WHEN o_orderpriority LIKE '2%' THEN 'm' || o_orderkey END, 'large_image_url': ''}] END"""
_URLS_SQL = f"""list_filter(list_transform(coalesce({_IMAGES_SQL}, []), lambda i: coalesce(nullif(i.large_image_url, ''), nullif(i.medium_image_url, ''), nullif(i.small_image_url, ''))), lambda u: u IS NOT NULL)"""


def images():
    key = F.col("o_orderkey").cast("string")
    first = F.struct(F.concat(F.lit("s"), key).alias("small_image_url"), F.lit("").alias("medium_image_url"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("l"), key)).alias("large_image_url"))
    second = F.struct(F.lit("").alias("small_image_url"), F.when(F.col("o_orderpriority").like("2%"), F.concat(F.lit("m"), key)).alias("medium_image_url"), F.lit("").alias("large_image_url"))
    return F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderpriority").like("1%"), F.filter(F.array(first, second), lambda i: F.lit(False))).otherwise(F.array(first, second))


@query(f"SELECT o_orderkey, array_to_string({_URLS_SQL}, ',') AS urls FROM orders")
def parse_image_urls(s, d):
    return table(s, d, "orders").select("o_orderkey", F.array_join(X.image_urls(images()), ",").alias("urls"))


@query(f"SELECT o_orderkey, len({_URLS_SQL}) > 0 AS has_image FROM orders")
def has_image(s, d):
    return table(s, d, "orders").select("o_orderkey", (F.size(X.image_urls(images())) > 0).alias("has_image"))


@query(
    rf"""SELECT o_orderkey, CAST(len(regexp_extract_all(o_orderpriority, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS BIGINT) AS token_len,
    len({_URLS_SQL}) AS n_images, len({_URLS_SQL}) > 0 AS has_image FROM orders"""
)
def review_features(s, d):
    rows = corpus.review_features(table(s, d, "orders").withColumn("images", images()), "o_orderpriority", "images")
    return rows.select("o_orderkey", "token_len", "n_images", "has_image")


@query(
    """SELECT toxic AS question_id, array_to_string(list(DISTINCT doc_id ORDER BY doc_id), ',') AS doc_ids FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars > 1000 GROUP BY toxic"""
)
def image_bearing_candidates(s, d):
    relevant = table(s, d, "labels").where("quality = 1").select(F.col("toxic").alias("question_id"), "doc_id")
    corpus_ = table(s, d, "documents").withColumn("has_image", F.col("n_chars") > 1000)
    return benchmark.image_candidates(relevant, corpus_).select("question_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(
    """SELECT doc_id, left(text, 600) AS text, CAST(n_chars % 5 + 1 AS DOUBLE) AS rating, n_chars > 2000 AS has_image, CASE WHEN n_chars > 2000 THEN 'photo-' || doc_id END AS image_url
    FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def snippet_lookup(s, d):
    photo = F.concat(F.lit("photo-"), F.col("doc_id").cast("string"))
    docs = table(s, d, "documents").withColumns(
        {"rating": (F.col("n_chars") % 5 + 1).cast("double"), "has_image": F.col("n_chars") > 2000, "image_urls": F.when(F.col("n_chars") > 2000, F.array(photo)).otherwise(F.array().cast("array<string>"))}
    )
    return benchmark.snippets(table(s, d, "labels").where("toxic = 1"), docs, 600)


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INTEGER) AS token_len FROM documents")
def token_len(s, d):
    return table(s, d, "documents").select("doc_id", X.token_len("text").alias("token_len"))


@query(f"SELECT doc_id, {STRIP.format(c='text')} AS text FROM documents")
def strip(s, d):
    return table(s, d, "documents").select("doc_id", X.strip("text").alias("text"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM documents")
def bm25_tokenize(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(X.search_tokens("text"), " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({WORDS.format(c='text')}) AS INTEGER) AS n_words FROM documents")
def split_words(s, d):
    return table(s, d, "documents").select("doc_id", F.size(X.split_words("text")).alias("n_words"))


_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '')"""


@query(f"SELECT doc_id, unnest({_SENTENCES}) AS sentence FROM documents")
def split_sentences(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(X.split_sentences("text")).alias("sentence"))


@query(f"SELECT item_id, lower(array_to_string({WORDS.format(c='text')}, ' ')) AS question FROM benchmark")
def normalize_question(s, d):
    return table(s, d, "benchmark").select("item_id", X.normalize_question("text").alias("question"))


@query(f"SELECT doc_id, sha256(lower(array_to_string({WORDS.format(c='text')}, ' '))) AS question_hash FROM documents")
def sha256_hash(s, d):
    return table(s, d, "documents").select("doc_id", X.question_hash("text").alias("question_hash"))


@query(f"SELECT item_id, sha256(lower(array_to_string({WORDS.format(c='text')}, ' '))) AS question_hash FROM benchmark")
def leakage_manifest(s, d):
    return table(s, d, "benchmark").select("item_id", X.question_hash("text").alias("question_hash"))


_REPLY = "text || ' [' || conv_id || '] and [photo of ' || (turn + 1) || '], [see review 7] [' || conv_id || '] [' || turn || '] []' || CASE WHEN role = 'user' THEN ' " + SENTENCE + "' ELSE '' END"


def replies(s, d):
    """Conversation turns as model replies with citations of every kind."""
    text = F.expr(_REPLY.replace("(turn + 1)", "cast(turn + 1 as string)").replace("|| conv_id ||", "|| cast(conv_id as string) ||").replace("|| turn ||", "|| cast(turn as string) ||"))
    return table(s, d, "conversations").select("conv_id", "turn", "role", text.alias("reply"))


REPLIES = f"(SELECT conv_id, turn, role, {_REPLY} AS reply FROM conversations)"


@query(f"SELECT conv_id, turn, CASE WHEN conv_id = turn THEN CAST(conv_id AS VARCHAR) ELSE conv_id || ',' || turn END AS cited FROM {REPLIES} r")
def extract_citations(s, d):
    return replies(s, d).select("conv_id", "turn", F.array_join(X.citations("reply"), ",").alias("cited"))


@query(rf"SELECT conv_id, turn, array_to_string(regexp_extract_all(reply, '\[photo of (\w+)\]', 1), ',') AS photos FROM {REPLIES} r")
def extract_photo_citations(s, d):
    return replies(s, d).select("conv_id", "turn", F.array_join(X.photo_citations("reply"), ",").alias("photos"))


@query(rf"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(reply, '\[[^\]]*\]'), lambda b: NOT regexp_matches(b, '^(\[(\w+)\]|\[photo of (\w+)\])$')), ',') AS malformed FROM {REPLIES} r")
def malformed_citations(s, d):
    return replies(s, d).select("conv_id", "turn", F.array_join(X.malformed_citations("reply"), ",").alias("malformed"))


@query(f"SELECT conv_id, turn, contains(reply, '{SENTENCE}') AS abstained FROM {REPLIES} r")
def abstained(s, d):
    return replies(s, d).select("conv_id", "turn", X.abstained("reply", SENTENCE).alias("abstained"))


@query(f"SELECT doc_id, left({STRIP.format(c='text')}, 80) AS text FROM documents")
def truncate_text(s, d):
    return table(s, d, "documents").select("doc_id", X.truncated("text", 80).alias("text"))


@query("SELECT p_partkey, string_split(p_name, ' ')[2] AS department, string_split(p_name, ' ')[7] AS none FROM part")
def department(s, d):
    parts = F.split("p_name", " ")
    return table(s, d, "part").select("p_partkey", X.department(parts).alias("department"), F.try_element_at(parts, F.lit(7)).alias("none"))


@query(rf"SELECT doc_id, '[' || doc_id || '] has_photo: ' || CASE WHEN n_chars > 2000 THEN 'yes' ELSE 'no' END || chr(10) || left({STRIP.format(c='text')}, 120) AS excerpt FROM documents")
def render_excerpt(s, d):
    return table(s, d, "documents").select("doc_id", X.excerpt("doc_id", "text", F.col("n_chars") > 2000, 120).alias("excerpt"))


_VERDICT = """CASE event_type WHEN 'error' THEN '{"correctness": "5", "faithfulness": 3, "completeness": 2, "conciseness": 1, "rationale": "r"}'
    WHEN 'click' THEN 'Here: ```json {"correctness": ' || CAST(user_id % 8 AS STRING) || ', "faithfulness": 3, "completeness": 2, "conciseness": 1, "rationale": "' || event_type || '"}```'
    WHEN 'view' THEN 'no json' ELSE '{"correctness": 4, "faithfulness": 5, "completeness": 4.5, "conciseness": 1, "rationale": " "}' END"""


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'bad correctness' WHEN 'view' THEN 'no JSON object'
        WHEN 'click' THEN CASE WHEN user_id % 8 NOT BETWEEN 1 AND 5 THEN 'bad correctness' END ELSE 'bad completeness' END AS error,
        CASE WHEN event_type = 'error' OR event_type = 'view' THEN NULL WHEN event_type = 'click' THEN user_id % 8 ELSE 4 END AS correctness FROM events"""
)
def parse_judge_json(s, d):
    parsed = X.judge_scores(F.expr(_VERDICT))
    return table(s, d, "events").select("event_id", parsed.alias("p")).select("event_id", "p.error", "p.correctness")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN abs(x - floor(x) - 0.5) < 1e-9 THEN 2 * round(x / 2) ELSE round(x) END AS rounded
    FROM (SELECT l_orderkey, l_linenumber, l_quantity / 2 AS x FROM lineitem)"""
)
def round_half_even(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2).alias("rounded"))


@query(
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
    SELECT term, round(ln(n - count(*) + 0.5) - ln(count(*) + 0.5), 6) AS idf FROM w, n GROUP BY term, n"""
)
def log_idf(s, d):
    docs = table(s, d, "documents")
    df = docs.select(F.explode(F.array_distinct(X.search_tokens("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))  # one row
    return df.crossJoin(n).select("term", F.round(F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5), 6).alias("idf"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS n_photos, min(doc_id) FILTER (WHERE n_chars > 2000) AS first_photo FROM documents GROUP BY source")
def map_photo_flags(s, d):
    flags = F.map_from_entries(F.collect_list(F.struct("doc_id", (F.col("n_chars") > 2000).alias("flag")))).alias("m")
    found = F.map_keys(F.map_filter("m", lambda k, v: v))
    # Flags stand in maps per source and length bucket, so that no map holds a whole source.
    parts = table(s, d, "documents").groupBy("source", F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("part")).agg(flags)
    sizes = parts.select("source", F.size("m").alias("n"), F.size(found).alias("n_photos"), F.array_min(found).alias("first_photo"))
    return sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum("n_photos").alias("n_photos"), F.min("first_photo").alias("first_photo"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY event_type")
def json_props(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT source, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source")
def numeric_id_sort(s, d):
    toxic = table(s, d, "labels").where("toxic = 1").select("doc_id")
    ids = F.array_sort(F.transform(F.collect_list(F.col("doc_id").cast("string")), lambda x: x.cast("long")))
    return table(s, d, "documents").join(toxic, "doc_id").groupBy("source").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, md5('42:' || doc_id) AS key FROM documents ORDER BY key")
def seeded_shuffle(s, d):
    return table(s, d, "documents").select("doc_id", corpus.seeded_order("doc_id", 42).alias("key")).orderBy("key")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS least, round(quantile_cont({c}, 0.25), 6) AS q25,
        round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS most FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
)
def describe(s, d):
    rows = corpus.describe(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})
