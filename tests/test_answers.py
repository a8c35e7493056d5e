import json

import pytest
from pyspark.errors import PySparkException

from gristmill.operators import answers, benchmark
from gristmill.sources import renderers
from gristmill.sources.configs import Category, Taxonomy

NOTHING = "Not enough information."


def model(folder, reply):
    """A model that replies by a function and writes down what it is asked."""

    def call(prompt):
        import json

        with open(f"{folder}/asked", "a") as out:
            out.write(json.dumps(prompt) + "\n")
        return reply(prompt)

    return call


def asked(folder):
    with open(f"{folder}/asked") as lines:
        return [json.loads(x) for x in lines]


def test_client_tries_again_and_reads_its_key_late(monkeypatch):
    sent = []

    def send(url, body, headers, timeout):
        sent.append((url, json.loads(body), headers["Authorization"]))
        return (429, b"slow down") if len(sent) < 3 else (200, json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode())

    client = answers.ChatClient("m", "http://host/v1/", "OWN_KEY", reasoning_effort="low", wait_s=0, send=send)
    with pytest.raises(RuntimeError, match="OWN_KEY"):
        client("hello")
    monkeypatch.setenv("OWN_KEY", "secret")
    assert client("hello") == "yes" and len(sent) == 3
    assert sent[0][0] == "http://host/v1/chat/completions" and sent[0][2] == "Bearer secret"
    assert sent[0][1]["messages"] == [{"role": "user", "content": "hello"}] and sent[0][1]["reasoning_effort"] == "low"
    with pytest.raises(RuntimeError, match="status 400"):
        answers.ChatClient("m", "http://host", "OWN_KEY", send=lambda *a: (400, b"bad"))("x")
    with pytest.raises(RuntimeError, match="status 503"):
        answers.ChatClient("m", "http://host", "OWN_KEY", wait_s=0, max_retries=2, send=lambda *a: (503, b""))("x")


def test_cache_asks_once_and_keeps_replies(spark, tmp_path):
    call = model(str(tmp_path), lambda p: p.upper())
    cache = answers.ResponseCache(spark, f"{tmp_path}/replies")
    prompts = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    assert {(r.prompt, r.response) for r in cache.complete(prompts, call, {"model": "x"}).collect()} == {("a", "A"), ("b", "B")}
    more = spark.createDataFrame([("b",), ("c",)], "prompt string")
    assert {(r.prompt, r.response) for r in cache.complete(more, call, {"model": "x"}).collect()} == {("b", "B"), ("c", "C")}
    assert sorted(asked(tmp_path)) == ["a", "b", "c"]
    cache.complete(prompts, call, {"model": "y"}).collect()  # other settings, other requests
    assert sorted(asked(tmp_path)) == ["a", "a", "b", "b", "c"]


def test_drafting_numbers_and_checks_questions(spark, tmp_path):
    taxonomy = Taxonomy((Category("fit", "How it fits", 2, 1), Category("colour", "Its colour", 1, 1)), 3, 0, 1.0, 0.1)
    reply = json.dumps([{"question": " Does it run small? ", "rationale": "r"}, {"question": "Does it run  small?"}, {"question": "Is it wide?"}])
    call = model(str(tmp_path), lambda p: f"```json\n{reply}\n```" if "fit" in p else '[{"question": "Which red?"}]')
    samples = spark.createDataFrame([("fit", "too tight"), ("fit", "just right"), ("colour", "red")], "category string, snippet string")
    found = answers.draft_questions(samples, taxonomy, "$n_questions of $category ($description):\n$reviews", call, {}, answers.ResponseCache(spark, f"{tmp_path}/r"))
    assert sorted((r.id, r.question) for r in found.collect()) == [("colour_000", "Which red?"), ("fit_000", "Does it run small?"), ("fit_002", "Is it wide?")]
    assert sorted(asked(tmp_path)) == ["2 of colour (Its colour):\n- red", "3 of fit (How it fits):\n- just right\n- too tight"]
    for bad in ("no array", '[{"rationale": "x"}]', '[1, 2', '{"question": "x"}'):
        with pytest.raises(PySparkException, match="no array of questions"):
            answers.draft_questions(samples, taxonomy, "$category", lambda p, bad=bad: bad, {}, answers.ResponseCache(spark, f"{tmp_path}/bad{abs(hash(bad))}")).collect()


def test_arms_and_judge(spark, tmp_path):
    questions = spark.createDataFrame([("q1", "Small?"), ("q2", "Red?")], "question_id string, question string")
    contexts = spark.createDataFrame([("q1", ["7"], "[7] small", {"7": True}), ("q2", [], "(none)", {})], "query_id string, context_doc_ids array<string>, context_text string, context_photo_flags map<string, boolean>")
    templates = {"closed_book": "Q: $question", "rag_small": "$context\nQ: $question"}
    calls = {"closed_book": lambda p: "Maybe.", "rag_small": lambda p: "Yes [7], [photo of 7]." if "small" in p else NOTHING}
    cache = answers.ResponseCache(spark, f"{tmp_path}/r")
    done = answers.run_arms(questions, contexts, templates, calls, {"closed_book": {"a": 1}, "rag_small": {"a": 2}}, NOTHING, cache)
    rows = {(r.arm, r.question_id): r for r in done.collect()}
    assert len(rows) == 4 and rows["rag_small", "q1"].cited_doc_ids == ["7"] and rows["rag_small", "q1"].cited_photo_ids == ["7"]
    assert rows["rag_small", "q2"].abstained and rows["closed_book", "q1"].context_text is None
    with pytest.raises(ValueError, match="blank"):
        answers.run_arms(questions, contexts, {"rag_large": "$question"}, {"rag_large": lambda p: " "}, {"rag_large": {"a": 3}}, NOTHING, cache)
    with pytest.raises(ValueError, match="arms are"):
        answers.run_arms(questions, contexts, {"other": ""}, {}, {}, NOTHING, cache)

    grade = {"correctness": 5, "faithfulness": 4, "completeness": 3, "conciseness": 2, "rationale": "fine"}
    grade = json.dumps(grade)
    (tmp_path / "judge").mkdir()
    judge = model(f"{tmp_path}/judge", lambda p: grade if "Yes" in p else "no grade")
    references = spark.createDataFrame([("q1", "Yes."), ("q2", "No.")], "question_id string, answer string")
    found = answers.judge(done, references, "$question|$context|$candidate_answer|$reference_answer", judge, {}, answers.ResponseCache(spark, f"{tmp_path}/j"))
    by = {(r.arm, r.question_id): r for r in found.collect()}
    assert by["rag_small", "q1"].correctness == 5 and by["rag_small", "q1"].raw_response is None
    assert by["closed_book", "q2"].error == "no JSON object" and by["closed_book", "q2"].raw_response == "no grade"
    assert not any("rag_small" in p or "closed_book" in p for p in asked(tmp_path / "judge"))

    scored = spark.createDataFrame([("q1", 1, 0, True, True), ("q2", 0, 0, True, True)], "question_id string, n_citations int, n_fabricated int, format_ok boolean, abstention_correct boolean")
    rows = answers.appendix_rows([("q2", "Abstains", "nothing there"), ("q1", "Grounded", "one photo")], done.where("arm = 'rag_small'"), scored)
    text = renderers.appendix_document(rows)
    assert text.index("Abstains: `q2`") < text.index("Grounded: `q1`") and "- `7` (has_photo: yes)" in text and "1 citation(s), none fabricated" in text
    with pytest.raises(PySparkException, match="no transcript or score of q9"):
        answers.appendix_rows([("q9", "", "")], done.where("arm = 'rag_small'"), scored).collect()


def test_reference_answers_and_selection(spark):
    rows = spark.createDataFrame([("q1", " It is [7] and [8], [7]. "), ("q2", NOTHING)], "question_id string, answer string")
    got = {r.question_id: r for r in answers.reference_answers(rows, NOTHING).collect()}
    assert got["q1"].cited_doc_ids == ["7", "8"] and got["q1"].answer.startswith("It") and not got["q1"].is_abstention and got["q2"].is_abstention
    with pytest.raises(PySparkException, match="q3: an abstention must not cite"):
        answers.reference_answers(spark.createDataFrame([("q3", f"{NOTHING} [7]")], "question_id string, answer string"), NOTHING).collect()
    assert [r.question_id for r in answers.select_in_order(rows, "question_id", ["q2", "q1"]).collect()] == ["q2", "q1"]
    with pytest.raises(PySparkException, match="unknown id q5"):
        answers.select_in_order(rows, "question_id", ["q1", "q5"]).collect()


def test_curation(spark):
    drafts = spark.createDataFrame([("fit_000", "fit", "Does it run small at all?"), ("fit_001", "fit", "Short?"), ("colour_000", "colour", "Which red is it really then?")], "id string, category string, question string")
    coverage = spark.createDataFrame([("fit", 10.0), ("colour", 60.0)], "category string, pct double")
    decisions = {"accepted": [{"id": "fit_000", "edited_question": " Does it run small? "}, {"id": "colour_000"}], "rejected": [], "negative_questions": [{"category": "fit", "question": "Is it edible?"}, {"category": "fit", "question": "Who made it?"}]}
    limits = {"min_words": 3, "max_words": 20, "need_mark": True}
    questions, rejected = answers.curate(drafts, decisions, coverage, 40.0, **limits)
    got = {r.id: (r.question, r.is_negative, r.image_target) for r in questions.collect()}
    assert got == {"fit_000": ("Does it run small?", False, False), "colour_000": ("Which red is it really then?", False, True), "fit_neg_000": ("Is it edible?", True, False), "fit_neg_001": ("Who made it?", True, False)}
    assert [(r.id, r.reason) for r in rejected.collect()] == [("fit_001", "too_short")]
    with pytest.raises(ValueError, match="missing"):
        answers.curate(drafts, decisions | {"accepted": decisions["accepted"][:1]}, coverage, 40.0, **limits)
    with pytest.raises(ValueError, match="unknown"):
        answers.curate(drafts, decisions | {"rejected": [{"id": "fit_001"}]}, coverage, 40.0, **limits)


def test_run_order(spark):
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "place int, question_id string")
    assert benchmark.order_problems(expected, expected).count() == 0
    given = spark.createDataFrame([(1, "a"), (2, "c"), (3, "b"), (4, "d")], "place int, question_id string")
    assert sorted((r.place, r.expected_id, r.given_id) for r in benchmark.order_problems(expected, given).collect()) == [(2, "b", "c"), (3, "c", "b"), (4, None, "d")]
