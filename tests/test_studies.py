import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import benchmark, corpus, studies
from gristmill.operators import evaluation as E
from gristmill.operators import retrieval as R
from gristmill.sources import configs, readers, renderers

DOCS = [(1, "red shoes run small"), (2, "the blue coat is warm. It is wide."), (3, "small small dog"), (4, ""), (5, "warm warm warm red")]
QUESTIONS = [(1, "small shoes", "fit", False), (2, "warm coat", "fit", False), (3, "zzz", "odd", True)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, text string, type string, is_negative boolean")


@pytest.fixture
def qrels(spark):
    return spark.createDataFrame([(1, "1"), (2, "2"), (2, "5")], "query_id long, doc_id string")


def test_index_refuses_no_or_equal_ids(spark, docs):
    for build in (R.BM25, lambda d: R.Dense(d, R.hashing_encoder)):
        with pytest.raises(ValueError, match="no documents"):
            build(docs.limit(0))
        for bad in ((1, "other words"), (1, "red shoes run small"), (None, "x")):
            with pytest.raises(ValueError, match="unique"):
                build(docs.unionByName(spark.createDataFrame([bad], docs.schema)))
        with pytest.raises(ValueError, match="positive"):
            build(docs).search_batch(spark.createDataFrame([(1, "a")], "query_id long, text string"), 0)
    with pytest.raises(ValueError, match="unique"):
        R.check_chunks(spark.createDataFrame([("a", "1"), ("a", "2")], "chunk_id string, parent_doc_id string"))


def test_dense_search_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = [(f"d{i:02d}", rnd.integers(-3, 4, 3 if i % 5 else 2).astype(float).tolist()) for i in range(60)]
    rows += [("null", None), ("hole", [1.0, None, 2.0]), ("nan", [float("nan")] * 3), (None, [1.0, 1.0, 1.0])]
    asked = [(i, rnd.integers(-3, 4, 3 if i % 3 else 2).astype(float).tolist()) for i in range(9)] + [(20, None)]
    vectors, queries = spark.createDataFrame(rows, "doc_id string, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>")

    def brute(unit):
        for q, a in asked:
            hits = []
            for d, v in rows:
                if a is None or d is None or v is None or len(v) != len(a) or None in v or not np.isfinite(v).all():
                    continue
                x, y = np.array(a), np.array(v)
                if unit:
                    x, y = (z / (np.linalg.norm(z) or 1.0) for z in (x, y))
                hits.append((-round(float(x @ y), 9), d))
            yield from ((q, n, d, -s) for n, (s, d) in enumerate(sorted(hits)[:4], 1))

    for unit in (False, True):
        for size in (32 << 20, 200):
            got = R.dense_top_k(vectors, queries, 4, unit, size).collect()
            assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9) + 0.0) for r in got) == sorted((q, n, d, s + 0.0) for q, n, d, s in brute(unit))
    assert R.dense_top_k(vectors.limit(0), queries, 4).count() == 0 and R.dense_top_k(vectors, queries.limit(0), 4).count() == 0


def test_parent_ids_and_curation_counts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "review long, text string")
    assert R.with_parent_ids(rows, "review").dtypes == [("text", "string"), ("doc_id", "string")]
    with pytest.raises(ValueError, match="unique"):
        R.with_parent_ids(rows.unionByName(rows), "review")
    spec = spark.createDataFrame([("fit", 2, 1), ("dye", 1, 0)], "category string, target long, negative long")
    asked = spark.createDataFrame([("fit", True), ("fit", False)], "category string, is_negative boolean")
    assert sorted(tuple(r) for r in benchmark.curation_counts(asked, spec).collect()) == [("dye", 1, 0, 0, 0), ("fit", 2, 1, 2, 1)]
    with pytest.raises(Exception, match="unknown category odd"):
        benchmark.curation_counts(asked.unionByName(spark.createDataFrame([("odd", True)], asked.schema)), spec).collect()
    coverage = spark.createDataFrame([("fit", 9.0)], "category string, pct double")
    assert sorted(map(str, (tuple(r) for r in benchmark.taxonomy_problems(spec, coverage, 9, 1, 10.0, 1.0).collect()))) == sorted(map(str, [("fit", "low"), ("dye", "no_negatives"), ("dye", "below_floor"), (None, "total")]))


def test_contexts_search_deep_and_collapse(spark, docs, questions):
    known = docs.withColumn("has_image", F.col("doc_id") == 2)
    chunks = R.chunk_fixed(known, 2)
    found = {r.query_id: r for r in R.search_contexts(R.BM25(chunks.select(F.col("chunk_id").alias("doc_id"), "text")), chunks, known, questions, 2, 9).collect()}
    assert found[1].context_doc_ids[0] == "1" and len(found[1].context_doc_ids) == 2
    assert found[2].context_text.startswith("[5] has_photo: no\nwarm warm\n\n[2] has_photo: yes\nthe blue") or found[2].context_text.startswith("[2]")
    assert found[2].context_photo_flags["2"] is True


def test_retrieval_study_equals_scores_by_hand(spark, docs, questions, qrels):
    chunks = R.chunk_whole(docs)
    builders = {"bm25": R.BM25, "dense": lambda d: R.Dense(d, R.hashing_encoder)}
    table, scores, reports = studies.retrieval_study(builders, chunks, questions, qrels, (1, 2), "red shoes", n_boot=200)
    rows = table.collect()
    assert [(r.k, r.retriever) for r in rows] == [(1, "bm25"), (1, "dense"), (2, "bm25"), (2, "dense")]
    by = {(r.retriever, r.query_id, r.k): r for r in scores.collect()}
    assert len(by) == 8 and by["bm25", 1, 1].recall == 1.0 and by["bm25", 2, 1].recall == 0.5
    for r in rows:
        own = [by[r.retriever, q, r.k].recall for q in (1, 2)]
        assert r.recall_mean == pytest.approx(np.mean(own)) and r.recall_ci_lo <= r.recall_mean <= r.recall_ci_hi and r.n_questions == 2
        want = E.bootstrap_ci(own, 200, rng=np.random.default_rng(42))
        assert (r.recall_ci_lo, r.recall_ci_hi) == pytest.approx(want[1:])
        assert r.recall_p == pytest.approx(E.wilcoxon([by["bm25", q, r.k].recall for q in (1, 2)], [by["dense", q, r.k].recall for q in (1, 2)]))
    assert reports["bm25"]["n_chunks"] == 4 and reports["bm25"]["smoke_hits"][0]["doc_id"] == "1" and reports["dense"]["n_parent_docs"] == 4
    with pytest.raises(ValueError, match="k=7"):
        studies.recall_by_type(scores, 7)
    typed = studies.recall_by_type(scores, 2, n_boot=50).collect()
    assert [(r.type, r.retriever, r.n_questions) for r in typed] == [("fit", "bm25", 2), ("fit", "dense", 2)]


def test_chunking_study(spark, docs, questions, qrels):
    schemes = {"two": configs.ChunkingConfig("fixed_token", 2), "whole": configs.ChunkingConfig("whole_review"), "one": configs.ChunkingConfig("sentence_window", sentence_window_size=1)}
    summary, scores = studies.chunking_study(docs, schemes, questions, qrels, (1, 3), n_boot=50)
    assert [(r.scheme, r.k) for r in summary.collect()] == [(s, k) for s in ("one", "two", "whole") for k in (1, 3)]
    assert {r.query_id for r in scores.collect()} == {1, 2} and all(r.recall == 1.0 for r in scores.where("k = 3 AND query_id = 1").collect())


def test_chunking_study_moves_no_pairs(spark):
    def written():
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    many = spark.range(0, 3000, 1, 4).selectExpr("id AS doc_id", "concat('the fit of ', id % 7) AS text")
    asked = spark.range(20).selectExpr("id AS query_id", "concat('the fit ', id % 7) AS text", "'fit' AS type")
    gold = spark.range(20).selectExpr("id AS query_id", "id % 7 AS doc_id")
    before = written()
    summary, _ = studies.chunking_study(many, {"whole": configs.ChunkingConfig("whole_review")}, asked, gold, (1, 3), n_boot=20)
    assert [(r.k, r.n_questions) for r in summary.collect()] == [(1, 20), (3, 20)]
    assert written() - before < 30_000  # 60,000 pairs share a word


def test_winloss_document(spark, docs, questions, qrels):
    hits = spark.createDataFrame([(1, "bm25", 1, 1, 2.5), (1, "dense", 3, 1, 0.5)], "query_id long, retriever string, doc_id long, rank int, score double")
    chosen = spark.createDataFrame([(1, "bm25")], "query_id long, winner string")
    details = studies.winloss_details(hits, chosen, docs, qrels.withColumn("doc_id", F.col("doc_id").cast("long")))
    text = renderers.winloss_document(details, questions, {"1": "shares a word"})
    assert "- ✅ `1` (score 2.500): red shoes run small" in text and "- ❌ `3`" in text and "**Why:** shares a word" in text


def test_pool_and_label_stats(spark, questions):
    pooled = spark.createDataFrame([(1, 7), (1, 8), (3, 9)], "query_id long, doc_id long")
    row = R.pool_stats(pooled, questions, 2).first()
    assert (row.least, row.most, row.mean, row.zero_pool, row.low_diversity) == (0, 2, 1.0, ["2"], ["1"])
    assert tuple(R.pool_stats(pooled, questions.limit(0), 2).first()) == (0, 0, 0.0, [], [])
    pool = pooled.withColumnRenamed("query_id", "question_id")
    given = spark.createDataFrame([(3, 99, 1)], "question_id long, doc_id long, relevant int")
    row = benchmark.label_stats(pool, given, questions.withColumnRenamed("query_id", "question_id")).first()
    assert tuple(row) == (2, 1, 50.0, ["1"], ["3"])


def test_worksheets_and_datasheet(spark, tmp_path):
    pools = spark.createDataFrame([("q1", "fit", "Small?", False, ["7", "8"]), ("q2", "fit", "Edible?", True, [])], "question_id string, category string, question string, is_negative boolean, doc_ids array<string>")
    snippets = spark.createDataFrame([(7, "runs small", 4.0, True)], "doc_id long, text string, rating double, has_image boolean")
    text = renderers.relevance_worksheet(pools, snippets)
    assert "- `7` (4★ [has image]): runs small\n- `8`: (text not found)" in text and "## q2 [fit] (negative" in text
    asked = spark.createDataFrame([("q1", "fit", "Small?", True), ("q2", "fit", "Wide?", True), ("q3", "fit", "Old?", False)], "id string, category string, question string, image_target boolean")
    candidates = spark.createDataFrame([("q1", "10", 4.5, "ten", "u10"), ("q1", "9", 5.0, "nine", None)], "question_id string, doc_id string, rating double, text string, image_url string")
    text = renderers.photo_worksheet(asked, candidates)
    assert text.index("- `9` (5★): nine") < text.index("- `10` (4.5★): ten\n  photo: u10") and "(no candidate with a photo)" in text and "q3" not in text
    entries = spark.createDataFrame([("a", False, False, ["1", "2"], ["1"], True, "1"), ("b", True, True, [], [], True, None)], "id string, is_negative boolean, is_abstention boolean, relevant_ids array<string>, cited_doc_ids array<string>, image_target boolean, best_photo_id string")
    stats = benchmark.datasheet_stats(entries).first().asDict()
    assert stats == {"total": 2, "n_negative": 1, "n_abstention": 1, "n_image_target": 2, "n_with_photo": 1, "image_coverage_pct": 50.0, "min_relevant": 0, "max_relevant": 2, "mean_relevant": 1.0, "mean_citations": 1.0}
    by_type = spark.createDataFrame([("fit", 2, 1)], "type string, total int, negative int")
    text = renderers.datasheet_document(stats, by_type, {"n_rows": 5, "fingerprint": "abc"}, "- One annotator.")
    assert "| fit | 2 | 1 |" in text and "1 of 2 image questions (50.0 %)" in text and "`abc`" in text
    assert renderers.write_markdown(text, f"{tmp_path}/deep/er/sheet.md").read_text() == text
    empty = benchmark.datasheet_stats(entries.limit(0)).first().asDict()
    assert set(empty.values()) == {0, 0.0}


def test_configs_are_checked(spark, tmp_path):
    def file(value):
        path = tmp_path / "c.json"
        path.write_text(json.dumps(value))
        return str(path)

    assert configs.load_chunking_config(file({"chunking": {"scheme": "fixed_token", "other": 1}})) == configs.ChunkingConfig("fixed_token", 256, 3)
    for bad in ({"scheme": "none"}, {"scheme": "fixed_token", "fixed_token_size": 0}, {"scheme": "fixed_token", "sentence_window_size": -1}):
        with pytest.raises(ValueError):
            configs.load_chunking_config(file({"chunking": bad}))
    with pytest.raises(KeyError):
        configs.load_chunking_config(file({}))
    with pytest.raises(KeyError):
        configs.load_chunking_config(file({"chunking": {}}))
    with pytest.raises(ValueError, match="not a mapping"):
        configs.load_config(file([1]))
    with pytest.raises(FileNotFoundError):
        configs.load_config(f"{tmp_path}/none.json")
    full = {"seed": 1, "paths": {"corpus_in": "a", "questions_in": "b", "build_report_out": "c"}, "chunking_config": "d", "k_values": [1, 5], "retrievers": {"dense": {"model_name": "m", "batch_size": 8}}}
    assert configs.load_retrieval_eval_config(file(full)).k_values == (1, 5)
    for change in ({"k_values": []}, {"k_values": [0]}, {"retrievers": {"dense": {"model_name": "m", "batch_size": 0}}}):
        with pytest.raises(ValueError):
            configs.load_retrieval_eval_config(file(full | change))
    taxonomy = {"categories": [{"name": "fit", "description": " It fits ", "target_count": 3, "negative_count": 0, "keywords": ["fit"]}, {"name": "dye", "description": "d", "target_count": 2, "negative_count": 1}], "validation": {"expected_total": 9, "total_tolerance": 1, "min_coverage_pct": 5.0, "min_coverage_pct_hard_floor": 1.0}}
    spec = configs.load_taxonomy(file(taxonomy))
    assert (spec.total_target, spec.total_negative, spec.total_fits, spec.categories[0].description) == (5, 1, False, "It fits")
    coverage = spark.createDataFrame([("fit", 0.5, "fit"), ("dye", 2.0, "")], "category string, pct double, top_terms string")
    problems = renderers.taxonomy_problems(spec, coverage)
    assert len(problems) == 4
    assert "| `fit` | It fits | 3 | 0 | 0.50 % | fit |" in renderers.taxonomy_document(spec, coverage, problems)
    with pytest.raises(ValueError, match="twice"):
        configs.load_taxonomy(file(taxonomy | {"categories": taxonomy["categories"][:1] * 2}))


def test_download_goes_on_where_it_stopped(tmp_path):
    body, seen = bytes(range(256)) * 40, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            seen.append(at)
            self.send_response(206 if at else 200)
            self.end_headers()
            self.wfile.write(body[at:])

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    (tmp_path / "x.part").write_bytes(body[:1000])
    assert readers.download(url, f"{tmp_path}/x").read_bytes() == body and seen == [1000]
    assert readers.download(url, f"{tmp_path}/x").read_bytes() == body and seen == [1000]
    with pytest.raises(ValueError, match="isn't the one"):
        readers.download(url, f"{tmp_path}/y", sha256="00")
    server.shutdown()


def test_language_detector_is_right(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text <> ''")
    right = rows.agg(F.avg((F.coalesce(corpus.detect_language("text"), F.lit("")) == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_places_equal_a_sort(spark):
    rows = [(k, (i * 7919) % 500 if i % 50 else None, i) for k in ("a", "b", None) for i in range(500 if k else 3)]
    df = spark.createDataFrame(rows, "key string, n long, i int")
    got = corpus.with_place(df, ["key"], "n", "place", 8).collect()
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        own = sorted((r for r in got if r.key == key), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        assert [r.n for r in own] == sorted((n for k, n, _ in rows if k == key), key=lambda n: (n is not None, n))


def test_projection_names_missing_columns(docs):
    assert corpus.project(docs, ["text"]).columns == ["text"]
    with pytest.raises(KeyError, match="nothing"):
        corpus.project(docs, ["text", "nothing"])
