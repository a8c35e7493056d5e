import difflib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import benchmark as B
from gristmill.operators import corpus as C
from gristmill.operators import evaluation as E
from gristmill.operators import retrieval as R
from gristmill.plans import registry
from gristmill.sources import readers, sinks
from gristmill.streaming import ingest


def test_joint_targets_add_up():
    weights = {"rating": {"1-2": 0.2, "3": 0.15, "4-5": 0.65}, "has_image": {"true": 0.15, "false": 0.85}}
    for n in (1000, 137):
        assert sum(t for _, t in C.joint_targets(weights, n)) == n
    with pytest.raises(ValueError):
        C.joint_targets({"a": {"x": 0.5}}, 10)


def test_stratified_sample_is_exact_and_repeatable(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(400)], "id long, s string")
    targets = spark.createDataFrame([("a", 30), ("b", 500)], "s string, target long")
    got = C.stratified_sample(rows, targets, ["s"], "id", 42).collect()
    assert sum(r.s == "a" for r in got) == 30 and sum(r.s == "b" for r in got) == 200
    assert {r.id for r in got} == {r.id for r in C.stratified_sample(rows.repartition(7), targets, ["s"], "id", 42).collect()}
    report = {r.s: r.shortfall for r in C.sampling_report(rows, targets, ["s"]).collect()}
    assert report == {"a": 0, "b": 300}


def test_keep_first_and_joins(spark):
    meta = spark.createDataFrame([("P1", "first", 0), ("P1", "second", 1), (None, "none", 2)], "k string, title string, pos int")
    side = C.keep_first(meta, ["k"], "pos").drop("pos")
    assert {(r.k, r.title) for r in side.collect()} == {("P1", "first"), (None, "none")}
    left = spark.createDataFrame([("P1", 1), ("P2", 2), (None, 3)], "k string, n int")
    plain, safe = C.join_m1(left, side, "k"), C.join_m1(left, side, "k", null_safe=True)
    assert [C.join_report(x).first().n_matched for x in (plain, safe)] == [1, 2]
    with pytest.raises(Exception, match="no match"):
        C.require_match(left, side, ["k"]).collect()


def test_language_and_build(spark):
    reviews = spark.createDataFrame(
        [(float(1 + i % 5), f"t{i}", f"this is the review number {i} of it", None, "a", f"p{i % 3}", f"u{i}", i, 0, True) for i in range(60)] + [(5.0, "t", "le chat est dans la maison", None, "a", "p0", "u", 1, 0, True), (5.0, "t", "x", None, "a", "p0", "u", 1, 0, True)], readers.REVIEW
    )
    reviews = reviews.withColumn("pos", F.monotonically_increasing_id()).withColumn("doc_id", F.concat("user_id", F.lit(":"), "text"))
    meta = spark.createDataFrame([("p0", "zero"), ("p0", "later"), ("p1", "one")], "parent_asin string, title string")
    weights = {"rating_bucket": {"1-2": 0.4, "3": 0.2, "4-5": 0.4}, "has_image": {"true": 0.0, "false": 1.0}}
    built = C.build_corpus(reviews, meta, weights, 20, 42, "pos", "doc_id").collect()
    assert len(built) == 20 and {r.product_title for r in built} <= {"later", "one", None}
    assert not any("chat" in r.text for r in built)


def test_chunks_and_collapse(spark):
    docs = spark.createDataFrame([(1, "One two three. Four! Five? Six seven."), (2, "  "), (3, None)], "doc_id long, text string")
    assert [r.text for r in R.chunk(docs, "fixed_token", fixed_size=3).orderBy("chunk_index").collect()] == ["One two three.", "Four! Five? Six", "seven."]
    assert [r.text for r in R.chunk(docs, "sentence_window", window_size=3).orderBy("chunk_index").collect()] == ["One two three. Four! Five?", "Six seven."]
    assert R.chunk(docs, "whole_review").count() == 1
    with pytest.raises(ValueError):
        R.chunk(docs, "other")
    hits = spark.createDataFrame([(1, c, 1.0, i + 1) for i, c in enumerate(["c1", "c3", "c2", "c4"])], "query_id int, doc_id string, score double, rank int")
    chunks = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2"), ("c4", "p3")], "chunk_id string, parent_doc_id string")
    assert [r.doc_id for r in R.collapse_to_parents(hits, chunks).orderBy("rank").collect()] == ["p1", "p2", "p3"]
    with pytest.raises(Exception, match="unknown chunk"):
        R.collapse_to_parents(hits, chunks.where("chunk_id <> 'c4'")).collect()


def test_bm25_against_a_plain_loop(spark):
    texts = {0: "the shirt runs small, size up", 1: "shirt size is true", 2: "blender is loud", 3: "great blender for smoothies", 4: ""}
    queries = {1: "shirt size size", 2: "blender", 3: ""}
    tokens = {i: re.findall("[a-z0-9]+", t) for i, t in texts.items()}
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(5 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    avg = sum(map(len, tokens.values())) / 5
    want = {}
    for q, text in queries.items():
        score = {i: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split()) for i, t in tokens.items()}
        want[q] = sorted(score, key=lambda i: (-round(score[i], 9), i))[:3]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = R.BM25(docs).search_batch(spark.createDataFrame(list(queries.items()), "query_id long, text string"), 3).orderBy("query_id", "rank").collect()
    assert {q: [r.doc_id for r in got if r.query_id == q] for q in queries} == want


def test_dense_search_in_blocks(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=4).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    asked = df.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    a = sorted(map(tuple, R.dense_top_k(df, asked, 3).select("query_id", "doc_id", "rank").collect()))
    b = sorted(map(tuple, R.dense_top_k(df, asked, 3, block_bytes=200).select("query_id", "doc_id", "rank").collect()))
    assert a == b and len(a) == 27


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("axb")] + [(2, "y", 1)], "query_id int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "q")], "query_id int, doc_id string")
    got = {(r.query_id, r.k): r for r in E.score_all(hits, qrels, (1, 3, 10)).collect()}
    assert got[1, 3].recall == 1.0 and got[1, 1].recall == 0.5
    assert got[1, 3].ndcg == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert got[2, 10].hit == 0.0 and got[2, 10].mrr == 0.0 and got[1, 10].mrr == 1.0
    with pytest.raises(ValueError):
        E.score_all(hits, qrels, (0,))


def test_bootstrap_and_signed_ranks(spark):
    assert E.bootstrap_ci([0.5] * 10)[1:] == (0.5, 0.5)
    assert E.bootstrap_ci([0, 1, 1], 500, rng=np.random.default_rng(1)) == E.bootstrap_ci([0, 1, 1], 500, rng=np.random.default_rng(1))
    assert E.wilcoxon([1, 2], [1, 2]) == 1.0
    assert E.wilcoxon([1, 2, 3, 4, 5], [0, 0, 0, 0, 0]) == pytest.approx(2 / 32)
    with pytest.raises(ValueError):
        E.wilcoxon([1], [])
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 9, 80) / 4, rnd.integers(0, 9, 80) / 4
    rows = spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(a, b, strict=True)], "k string, a double, b double")
    z = E.signed_rank_parts(rows, ["k"]).first().z
    assert math.erfc(z / math.sqrt(2)) == pytest.approx(E.wilcoxon(a, b), rel=1e-9)


def test_lopsided_takes_each_side_alone(spark):
    diffs = spark.createDataFrame([("q1", 1.0), ("q2", 0.2), ("q3", -1.0), ("q4", -0.2), ("q5", 0.0)], "query_id string, diff double")
    got = [(r.winner, r.query_id) for r in E.lopsided(diffs, 4).orderBy("winner", "place").collect()]
    assert got == [("a", "q1"), ("a", "q2"), ("b", "q3"), ("b", "q4")]


def test_questions_decisions_and_cache(spark):
    drafts = spark.createDataFrame([("a", "Too short?"), ("b", "Does it run small on most of the buyers"), ("c", "Does it run small on most buyers?"), ("d", "Does it run small for most buyers?")], "id string, question string")
    passed, rejected = B.quality_split(drafts, min_words=3, max_words=30, need_mark=True)
    assert {r.id: r.reason for r in rejected.collect()} == {"a": "too_short", "b": "no_question_mark"}
    kept = B.fuzzy_dedup(passed.withColumn("category", F.lit("fit")), "category", "id", "question").collect()
    assert [r.id for r in kept] == ["c"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    problems = {(r.id, r.problem) for r in B.decision_problems(ids("1", "2", "3"), ids("1", "2"), ids("2", "9")).collect()}
    assert problems == {("2", "both"), ("3", "missing"), ("9", "unknown")}
    prompts = spark.createDataFrame([("p",), ("q",), ("p",)], "prompt string")
    known = B.complete(prompts, None, lambda p: p + "!", {"m": 1}).where("prompt = 'p'").localCheckpoint()
    again = {r.prompt: r.response for r in B.complete(prompts, known, lambda p: "new", {"m": 1}).collect()}
    assert again == {"p": "p!", "q": "new"}


def test_fuzzy_dedup_query_compares_all_questions(spark, tmp_path):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60)))) for i in range(60)]
    for i in range(60, 120):  # copies with other words, order of letters or cases; some too far off
        text = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, len(text) // 8)):
            text[rnd.randrange(len(text))] = rnd.choice("ABxyz ")
        items.append((i, "".join(text)))
    items += [(120, None), (121, " "), (122, "")]
    kept = []
    for i, text in items:
        clean = " ".join((text or "").lower().split())
        if all(difflib.SequenceMatcher(None, clean, c).ratio() < 0.9 for _, c in kept):
            kept.append((i, clean))
    assert 70 < len(kept) < 110
    rnd.shuffle(items)
    spark.createDataFrame(items, "item_id long, text string").repartition(3).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.item_id for r in registry.QUERIES["fuzzy_dedup"](spark, str(tmp_path)).collect()) == [i for i, _ in kept]


def test_grounded_answers(spark):
    questions = spark.createDataFrame([("q1", "Fit?")], "question_id string, question string")
    contexts = spark.createDataFrame([("q1", "[5] has_photo: no\nruns small")], "query_id string, context_text string")
    got = B.grounded_answers(questions, contexts, "Q: $question\n$context", lambda p: " Small [5]. " if "runs small" in p else "?", "NO", {"m": 1}).first()
    assert (got.answer_text, got.cited_doc_ids, got.abstained) == ("Small [5].", ["5"], False)


def test_leakage(spark):
    texts = spark.createDataFrame([(1, "Does  it FIT?"), (2, "does it really fit?")], "id int, text string")
    assert [r.id for r in B.leaks(texts, spark.createDataFrame([("does it fit?",)], "text string")).collect()] == [1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "question": "x"}\n\n{"id": "2", "question": null}\n')
    rows = readers.read_records(spark, str(tmp_path / "a.jsonl"), "drafts")
    assert rows.count() == 2 and readers.count_records(spark, str(tmp_path / "a.jsonl")) == 2
    with pytest.raises(Exception, match="missing question"):
        readers.read_records(spark, str(tmp_path / "a.jsonl"), "drafts", ("question",)).collect()
    summary = {r["column"]: r for r in readers.schema_summary(rows).collect()}
    assert summary["question"].null_count == 1 and summary["question"].null_pct == 50.0
    manifest = sinks.write_corpus(rows, str(tmp_path / "out"), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == manifest == sinks.write_corpus(rows.repartition(3), str(tmp_path / "out2"))
    sinks.write_jsonl(rows, str(tmp_path / "j"), "id")
    sinks.write_csv(rows.withColumn("a", F.array("id")), str(tmp_path / "c"), "id")
    assert readers.read_csv(spark, str(tmp_path / "c"), "id string, category string, question string, rationale string, a string").count() == 2
    assert "| 1 |" in sinks.markdown_table(rows.select("id"), "id")
    with pytest.raises(ValueError):
        readers.parse_decisions('{"accepted": [{"id": "a"}], "rejected": [{"id": "a"}]}')


def test_bm25_moves_the_best_of_each_task_only(spark):
    def written():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    docs = spark.range(0, 2000, 1, 4).selectExpr("id AS doc_id", "concat('the ', id % 7, ' and ', id % 3) AS text").where("doc_id >= 0")
    queries = spark.range(20).selectExpr("id AS query_id", "concat('the and ', id % 7) AS text")
    index = R.BM25(docs)
    before = written()
    hits = index.search_batch(queries, 3).collect()
    # 40,000 pairs share a word.
    assert len(hits) == 60 and written() - before < 2000
    assert [h.doc_id for h in sorted(hits, key=lambda h: h["rank"]) if h.query_id == 5] == [5, 12, 19]


def test_bm25_shows_what_scores_zero_before_what_scores_less(spark):
    # A word in most documents weighs less than nothing here: the second has none of it.
    docs = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "x"), ("dd", "x")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "x"), (2, "zzz"), (3, None)], "query_id long, text string")
    hits = sorted(R.BM25(docs).search_batch(queries, 2).collect(), key=lambda h: (h.query_id, h["rank"]))
    assert [h.doc_id for h in hits] == ["b", "a", "a", "b", "a", "b"] and hits[0].score == 0.0 > hits[1].score


def test_schema_summary_in_order(spark, tmp_path):
    # The larger file is read first and holds the later ids; 23 nulls of 4000 are 0.575 %, a bit less as a double.
    spark.range(100, 4000).selectExpr("id AS doc_id", "CASE WHEN id >= 123 THEN concat('late ', id) END AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.range(1, 100).selectExpr("id AS doc_id", "concat('early ', id) AS text").union(spark.sql("SELECT CAST(NULL AS LONG), 'no id'")).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    found = {r["column"]: r for r in readers.schema_summary(rows, "doc_id").collect()}
    assert (found["doc_id"].example, found["text"].example) == ("1", "early 1")
    assert (found["text"].null_count, found["text"].null_pct) == (23, 0.57)
    assert readers.schema_summary(rows.where("doc_id IS NULL"), "doc_id").where("column = 'text'").first().example == "no id"


def test_stream_drops_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"ts": f"2024-01-01T00:0{i % 5}:00Z", "text": f"some   text {i % 3}"}) + "\n" for i in range(9)) + '{"ts": "2024-01-01T00:00:00Z", "text": "x"}\n')
    stream = ingest.clean_stream(ingest.read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string"), "ts", ["text"])
    ingest.append_corpus(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"some text {i}" for i in range(3)]
