"""Questions, answers and grades by language models: clients, caches, drafting, arms, judging."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import benchmark
from gristmill.sources.cluster import materialize
from gristmill.sources.configs import Taxonomy

#: Replies that are worth another try, and the arms of a full run.
RETRIED = frozenset({429, 500, 502, 503, 504})
ARMS = ("closed_book", "rag_small", "rag_large")


def post(url: str, body: bytes, headers: Mapping[str, str], timeout: float) -> tuple[int, bytes]:
    """Status and body of a request."""
    request = urllib.request.Request(url, body, dict(headers))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


@dataclass
class ChatClient:
    """A chat-completions endpoint as a function from a prompt to a reply.

    The key is read from the environment when the first request goes out, on the machine that
    sends it.  Replies in ``RETRIED`` are tried again after a wait that doubles; others fail.
    """

    model: str
    api_base: str
    api_key_env: str
    temperature: float = 0.0
    max_tokens: int = 1024
    timeout_s: float = 60.0
    max_retries: int = 4
    reasoning_effort: str | None = None
    wait_s: float = 1.0
    send: Callable[[str, bytes, Mapping[str, str], float], tuple[int, bytes]] = field(default=post, repr=False)

    def settings(self) -> dict:
        """What besides the prompt decides the reply; part of the key of a cached one."""
        fixed = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens}
        return fixed if self.reasoning_effort is None else fixed | {"reasoning_effort": self.reasoning_effort}

    def __call__(self, prompt: str) -> str:
        key = os.environ.get(self.api_key_env)
        if not key:
            raise RuntimeError(f"no API key in {self.api_key_env}")
        body = json.dumps(self.settings() | {"messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        for attempt in range(self.max_retries + 1):
            status, reply = self.send(f"{self.api_base.rstrip('/')}/chat/completions", body, headers, self.timeout_s)
            if status == 200:
                return json.loads(reply)["choices"][0]["message"]["content"]
            if status not in RETRIED or attempt == self.max_retries:
                raise RuntimeError(f"status {status}: {reply[:500].decode(errors='replace')}")
            time.sleep(self.wait_s * 2**attempt)
        raise AssertionError


@dataclass
class ResponseCache:
    """Replies in a Parquet folder, by the hash of the request; new ones are appended."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame | None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return None
        return self.spark.read.schema("key string, prompt string, response string").parquet(self.path)

    def complete(self, prompts: DataFrame, call: Callable[[str], str], settings: dict) -> DataFrame:
        """``key, prompt, response`` of all prompts.  ``call`` is asked once for each distinct prompt
        that has no reply yet; its replies are stored before anything is returned."""
        known = self.read()
        missing = benchmark.keyed_prompts(prompts, settings)
        if known is not None:
            missing = missing.join(known.select("key"), "key", "left_anti")
        benchmark.answered(missing, call).write.mode("append").parquet(self.path)
        # Two runs at a time can store one reply twice.
        stored = self.read().groupBy("key").agg(F.min("response").alias("response"))
        # Written apart: two scans of a folder that grew meanwhile are one to the planner.
        return materialize(benchmark.keyed_prompts(prompts, settings).join(stored, "key").select("key", "prompt", "response"), "replies")


def draft_questions(samples: DataFrame, taxonomy: Taxonomy, template: str, call: Callable[[str], str], settings: dict, cache: ResponseCache, factor: float = 1.5, threshold: float = 0.9) -> DataFrame:
    """Drafted questions of every category: ``id, category, question, rationale``.

    ``samples`` has ``category, snippet``: reviews shown to the model.  Each category is asked for
    ``factor`` times its target.  Ids number the questions of a reply; a reply that isn't a JSON
    array of objects with a question fails.  Near-equal questions of a category fall away.
    """
    rows = [(c.name, c.description, max(1, round(c.target_count * factor))) for c in taxonomy.categories]
    asked = samples.sparkSession.createDataFrame(rows, "category string, description string, n int")
    shown = samples.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("snippet")), lambda s: F.concat(F.lit("- "), s)), "\n").alias("reviews"))
    prompts = asked.join(shown, "category", "left").withColumn("prompt", X.render(template, category="category", description="description", reviews="reviews", n_questions=F.col("n").cast("string")))
    replies = prompts.join(cache.complete(prompts, call, settings), "prompt").select("category", "response")
    drafts = replies.select("category", F.posexplode(X.required_questions("response", "category")).alias("place", "q"))
    drafts = drafts.select(F.concat("category", F.lit("_"), F.lpad(F.col("place").cast("string"), 3, "0")).alias("id"), "category", F.col("q.question").alias("question"), F.coalesce("q.rationale", F.lit("")).alias("rationale"))
    return benchmark.fuzzy_dedup(drafts, "category", "id", "question", threshold)


def run_arms(questions: DataFrame, contexts: DataFrame, templates: Mapping[str, str], calls: Mapping[str, Callable[[str], str]], settings: Mapping[str, dict], sentence: str, cache: ResponseCache) -> DataFrame:
    """Transcripts of all arms: ``arm`` and what ``benchmark.grounded_answers`` gives.

    The arm without a book sees no context; the others share one search.  An arm that misses a
    question or answers one with nothing fails.
    """
    unknown = sorted(set(templates) - set(ARMS))
    if unknown or not templates:
        raise ValueError(f"arms are {ARMS}, not {unknown}")
    parts = []
    for arm, template in templates.items():
        given = None if arm == "closed_book" else contexts
        done = benchmark.grounded_answers(questions, given, template, calls[arm], sentence, settings[arm], cache=cache)
        problems = benchmark.completeness_problems(questions.select("question_id"), done).limit(20).collect()
        if problems:
            raise ValueError(f"{arm}: {[tuple(p) for p in problems]}")
        parts.append(done.withColumn("arm", F.lit(arm)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def judge(transcripts: DataFrame, references: DataFrame, template: str, call: Callable[[str], str], settings: dict, cache: ResponseCache, no_context: str = "(no context)") -> DataFrame:
    """Rubric grades of answers: ``arm, question_id``, the grades, the rationale, and the error and raw reply of a bad one.

    The prompt holds the question, the context, the answer and the reference answer, and never the
    arm, so equal answers of two arms are one request.
    """
    rows = transcripts.join(references.select("question_id", F.col("answer").alias("reference_answer")), "question_id")
    context = F.coalesce(F.col("context_text"), F.lit(no_context)) if "context_text" in rows.columns else F.lit(no_context)
    rows = rows.withColumn("prompt", X.render(template, question="question", context=context, candidate_answer="answer_text", reference_answer="reference_answer"))
    graded = rows.join(cache.complete(rows, call, settings), "prompt").withColumn("g", X.judge_scores("response"))
    return graded.select("arm", "question_id", "g.*", F.when(F.col("g.error").isNotNull(), F.col("response")).alias("raw_response"))


def reference_answers(rows: DataFrame, sentence: str) -> DataFrame:
    """``question_id, answer, cited_doc_ids, is_abstention`` from ``question_id, answer``.

    Citations and abstention are read from the text; an abstention that cites fails.
    """
    text = X.strip(X.text_of("answer"))
    out = rows.select("question_id", text.alias("answer"), X.citations(text).alias("cited_doc_ids"), X.abstained(text, sentence).alias("is_abstention"))
    wrong = F.raise_error(F.concat(F.col("question_id").cast("string"), F.lit(": an abstention must not cite")))
    return out.where(F.when(F.col("is_abstention") & (F.size("cited_doc_ids") > 0), wrong).otherwise(F.lit(True)))


def curate(drafts: DataFrame, decisions: Mapping, image_coverage: DataFrame, least_coverage: float, **limits) -> tuple[DataFrame, DataFrame]:
    """Curated questions and the rejected drafts: quality filters, decisions, negatives, image targets.

    ``decisions`` is what ``sources.readers.parse_decisions`` gives: accepted drafts (``id``, perhaps
    ``edited_question``), rejected ids, and negative questions (``category, question``).
    ``image_coverage`` has ``category, pct``.  A draft that passes without a decision, or a
    decision on another id, fails.
    """
    spark = drafts.sparkSession
    passed, rejected = benchmark.quality_split(drafts, **limits)
    accepted = spark.createDataFrame([(a["id"], (a.get("edited_question") or a.get("question") or "").strip() or None) for a in decisions["accepted"]], "id string, edited string")
    refused = spark.createDataFrame([(r["id"],) for r in decisions["rejected"]], "id string")
    problems = benchmark.decision_problems(passed.select("id"), accepted.select("id"), refused).limit(20).collect()
    if problems:
        raise ValueError(f"decisions: {[tuple(p) for p in problems]}")
    kept = passed.join(accepted, "id").select("id", "category", F.coalesce("edited", "question").alias("question"), F.lit(False).alias("is_negative"))
    probes = spark.createDataFrame([(i, n["category"], n["question"]) for i, n in enumerate(decisions["negative_questions"])], "place int, category string, question string")
    negative = benchmark.negative_ids(probes, "category", "place").select("id", "category", "question", F.lit(True).alias("is_negative"))
    return benchmark.image_targets(kept.unionByName(negative), image_coverage, least_coverage), rejected


def select_in_order(rows: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """The rows of the given ids, in the order given; an id that no row has fails."""
    asked = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"_place int, _id {rows.schema[key].dataType.simpleString()}")
    found = F.broadcast(asked).join(rows.withColumn("_hit", F.lit(True)), F.col("_id") == F.col(key), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown id "), F.col("_id").cast("string")))
    return found.where(F.when(F.col("_hit").isNull(), unknown).otherwise(F.lit(True))).orderBy("_place").select(*rows.columns)


def appendix_rows(entries: Sequence[tuple[str, str, str]], transcripts: DataFrame, scores: DataFrame) -> DataFrame:
    """Chosen transcripts with their scores, in the order of ``entries`` (question, label, note); one that is missing fails."""
    asked = transcripts.sparkSession.createDataFrame([(i, *e) for i, e in enumerate(entries)], "place int, question_id string, label string, note string")
    one = transcripts.join(scores.drop(*[c for c in scores.columns if c in transcripts.columns and c != "question_id"]), "question_id", "left")
    found = asked.join(one.withColumn("_hit", F.lit(True)), "question_id", "left")
    missing = F.raise_error(F.concat(F.lit("no transcript or score of "), F.col("question_id")))
    return found.where(F.when(F.col("_hit").isNull() | F.col("n_citations").isNull(), missing).otherwise(F.lit(True))).orderBy("place").drop("_hit", "place")
