"""Benchmark construction: question curation, labels, answers, photos, assembly, leakage, replies."""

from __future__ import annotations

import difflib
import hashlib
import json
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators.corpus import map_batches, seeded_order, with_place


def quality_reason(question: Column | str, min_words: int, max_words: int, need_mark: bool) -> Column:
    """Why a drafted question fails, the first reason only; null if it passes."""
    n = F.size(X.split_words(X.text_of(question)))
    reason = F.when(n < min_words, "too_short").when(n > max_words, "too_long")
    return reason.when(~X.strip(X.text_of(question)).endswith("?"), "no_question_mark") if need_mark else reason


def quality_split(drafts: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    marked = drafts.withColumn("reason", quality_reason("question", **limits))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def negative_ids(negatives: DataFrame, category: str, order: str, slices: int = 64) -> DataFrame:
    """``<category>_neg_<000>`` in the order of each category.

    Places are counted in slices of a category, between quantiles of ``order``, so no task sorts a
    whole one.
    """
    placed = with_place(negatives, [category], order, "_place", slices)
    return placed.withColumn("id", F.concat(F.col(category).cast("string"), F.lit("_neg_"), F.lpad((F.col("_place") - 1).cast("string"), 3, "0"))).drop("_place")


def decision_problems(passed: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """``id, problem`` for ids decided twice, not at all, or unknown."""
    decided = accepted.union(rejected).distinct()
    both = accepted.intersect(rejected).withColumn("problem", F.lit("both"))
    return both.unionByName(passed.subtract(decided).withColumn("problem", F.lit("missing"))).unionByName(decided.subtract(passed).withColumn("problem", F.lit("unknown")))


def fuzzy_dedup(questions: DataFrame, category: str, order: str, text: str, threshold: float = 0.9) -> DataFrame:
    """Per category, in order, questions unlike every one kept so far (sequence-matcher ratio).

    Order-dependent by definition; a category holds drafted questions, hundreds at most.  A ratio
    can't exceed what the lengths, then the counts of characters allow, so most pairs need no
    matching.
    """

    def ratio(matches: int, length: int) -> float:
        return 2.0 * matches / length if length else 1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        pdf = pdf.sort_values(order).reset_index(drop=True)
        clean = [" ".join((t or "").lower().split()) for t in pdf[text]]
        counts = [Counter(t) for t in clean]

        def alike(i: int, j: int) -> bool:
            length = len(clean[i]) + len(clean[j])
            if ratio(min(len(clean[i]), len(clean[j])), length) < threshold or ratio((counts[i] & counts[j]).total(), length) < threshold:
                return False
            return difflib.SequenceMatcher(None, clean[i], clean[j]).ratio() >= threshold

        for i in range(len(clean)):
            if not any(alike(i, j) for j in kept):
                kept.append(i)
        return pdf.iloc[kept]

    return questions.groupBy(category).applyInPandas(run, questions.schema)


def assemble(questions: DataFrame, qrels: DataFrame, answers: DataFrame, photos: DataFrame) -> DataFrame:
    """Benchmark entries: relevant ids in numeric order, answer, photo only for image targets."""
    ids = F.transform(F.array_sort(F.transform(F.collect_list("doc_id"), lambda d: d.cast("long"))), lambda d: d.cast("string"))
    relevant = qrels.groupBy("question_id").agg(ids.alias("relevant_ids"))
    joined = questions.join(relevant, "question_id", "left").join(answers, "question_id", "left").join(photos.withColumnRenamed("doc_id", "photo"), "question_id", "left")
    return joined.withColumn("relevant_ids", F.coalesce("relevant_ids", F.array().cast("array<string>"))).withColumn("best_photo_id", F.when(F.col("image_target"), F.col("photo"))).drop("photo")


def entry_problems(entries: DataFrame) -> DataFrame:
    """``question_id, problem``: answerable without evidence, citing or showing what isn't."""
    checks = {
        "no_relevant": ~F.col("is_negative") & (F.size("relevant_ids") == 0),
        "citation_not_relevant": F.size(F.array_except("cited_doc_ids", "relevant_ids")) > 0,
        "photo_not_relevant": F.col("best_photo_id").isNotNull() & ~F.array_contains("relevant_ids", F.col("best_photo_id")),
    }
    return _problems(entries, checks)


def answer_problems(answers: DataFrame) -> DataFrame:
    """Over ``question_id, relevant_ids, cited_doc_ids, is_abstention`` (null: no answer)."""
    some, cites = F.size("relevant_ids") > 0, F.size(F.coalesce("cited_doc_ids", F.array().cast("array<string>"))) > 0
    there = F.col("is_abstention").isNotNull()
    checks = {
        "missing": ~there,
        "cites_non_relevant": there & (F.size(F.array_except("cited_doc_ids", "relevant_ids")) > 0),
        "uncited": there & ~F.col("is_abstention") & ~cites,
        "answers_without_evidence": there & ~F.col("is_abstention") & ~some,
        "abstains_despite_evidence": there & F.col("is_abstention") & some,
    }
    return _problems(answers, checks)


def _problems(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())
    return rows.select("question_id", F.explode(found).alias("problem"))


def photo_problems(targets: DataFrame, picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Image targets without a decision, with a pick that is no candidate, or with none though
    candidates exist."""
    have = candidates.groupBy("question_id").agg(F.collect_set("doc_id").alias("candidates"))
    joined = targets.join(picks.withColumn("decided", F.lit(True)), "question_id", "left").join(have, "question_id", "left")
    none = F.coalesce(F.size("candidates"), F.lit(0)) <= 0
    checks = {
        "undecided": F.col("decided").isNull(),
        "not_a_candidate": F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("candidates", F.col("doc_id")), F.lit(False)),
        "none_though_candidates": F.col("decided").isNotNull() & F.col("doc_id").isNull() & ~none,
    }
    return _problems(joined, checks)


def label_problems(pool: DataFrame, labels: DataFrame, negatives: DataFrame) -> DataFrame:
    """``question_id, problem`` over pooled pairs, labels and negative questions."""
    unlabeled = pool.join(labels, ["question_id", "doc_id"], "left_anti").groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).select("question_id", F.lit("unlabeled_pair").alias("problem"))
    positives = labels.groupBy("question_id").agg(F.sum("relevant").alias("n"))
    asked = pool.select("question_id").distinct().join(positives, "question_id", "left").join(negatives.withColumn("negative", F.lit(True)), "question_id", "left")
    n, negative = F.coalesce("n", F.lit(0)), F.coalesce("negative", F.lit(False))
    soft = _problems(asked, {"answerable_without_positive": ~negative & (n == 0), "negative_with_positive": negative & (n > 0)})
    return unlabeled.unionByName(soft)


def label_stats(pool: DataFrame, labels: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: labels and positives per question, the share of questions with any, and those that
    should have some and don't or shouldn't and do.

    Every label of a pooled question counts, even if its document isn't pooled.  ``questions`` has
    ``question_id, is_negative``.  Listed ids are those of a benchmark's questions.
    """
    asked = pool.select("question_id").distinct().join(questions, "question_id")
    rows = asked.join(labels.groupBy("question_id").agg(F.sum("relevant").alias("n")), "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ids = lambda wanted: F.array_sort(F.collect_list(F.when(wanted, F.col("question_id").cast("string"))))
    return rows.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.bround(F.try_divide(F.count_if(F.col("n") > 0) * 100.0, F.count(F.lit(1))), 2), F.lit(0.0)).alias("pct_with_positive"),
        ids(~F.col("is_negative") & (F.col("n") == 0)).alias("zero_positive"),
        ids(F.col("is_negative") & (F.col("n") > 0)).alias("unexpected_positive"),
    )


def datasheet_stats(entries: DataFrame) -> DataFrame:
    """One row of what a datasheet reports about ``sources.readers.RECORDS["entries"]``; zeros over nothing."""
    relevant, cited = F.size("relevant_ids"), F.when(~F.col("is_abstention"), F.size("cited_doc_ids"))
    shown, wanted = F.count("best_photo_id"), F.count_if("image_target")
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 2), F.lit(0.0))
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_negative").alias("n_negative"),
        F.count_if("is_abstention").alias("n_abstention"),
        wanted.alias("n_image_target"),
        shown.alias("n_with_photo"),
        F.coalesce(F.bround(F.try_divide(shown * 100.0, wanted), 2), F.lit(0.0)).alias("image_coverage_pct"),
        F.coalesce(F.min(relevant), F.lit(0)).alias("min_relevant"),
        F.coalesce(F.max(relevant), F.lit(0)).alias("max_relevant"),
        mean(relevant).alias("mean_relevant"),
        mean(cited).alias("mean_citations"),
    )


def curation_counts(questions: DataFrame, spec: DataFrame) -> DataFrame:
    """``spec`` (``category, target, negative``) with ``n`` and ``n_negative`` questions of each category.

    ``questions`` has ``category, is_negative``; one of a category that isn't in ``spec`` fails.
    """
    counts = questions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_negative").alias("n_negative"))
    both = spec.withColumn("_known", F.lit(True)).join(counts, "category", "full")
    unknown = F.raise_error(F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("null"))))
    known = both.where(F.when(F.col("_known").isNull(), unknown).otherwise(F.lit(True))).drop("_known")
    return known.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_negative")})


def taxonomy_problems(spec: DataFrame, coverage: DataFrame, expected: int, tolerance: int, low: float, floor: float) -> DataFrame:
    """``category, problem``: no negative questions, hardly mentioned (below ``floor``) or little mentioned
    by the corpus (``category, pct``); and, without a category, a total off by more than ``tolerance``."""
    pct = F.coalesce("pct", F.lit(0.0))
    problems = F.filter(F.array(F.when(F.col("negative") == 0, "no_negatives"), F.when(pct < floor, "below_floor").when(pct < low, "low")), lambda x: x.isNotNull())
    each = spec.join(coverage, "category", "left").select("category", F.explode(problems).alias("problem"))
    total = spec.agg(F.coalesce(F.sum("target"), F.lit(0)).alias("n")).where(F.abs(F.col("n") - expected) > tolerance)
    return each.unionByName(total.select(F.lit(None).cast("string").alias("category"), F.lit("total").alias("problem")))


def image_targets(questions: DataFrame, coverage: DataFrame, least: float) -> DataFrame:
    """``image_target`` of each question: not negative, and of a category (``category, pct``) with enough photos."""
    joined = questions.join(coverage.select("category", F.col("pct").alias("_pct")), "category", "left")
    return joined.withColumn("image_target", ~F.col("is_negative") & (F.coalesce("_pct", F.lit(0.0)) >= least)).drop("_pct")


def image_candidates(relevant: DataFrame, corpus: DataFrame) -> DataFrame:
    """``question_id, doc_ids``: a question's relevant documents with photos, in numeric order of their ids."""
    rows = relevant.join(corpus.where("has_image").select("doc_id"), "doc_id")
    order = F.struct(F.col("doc_id").cast("string").try_cast("long").alias("n"), F.col("doc_id").cast("string").alias("d"))
    return rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["d"]).alias("doc_ids"))


def snippets(ids: DataFrame, corpus: DataFrame, max_chars: int) -> DataFrame:
    """``doc_id, text, rating, has_image, image_url`` of the documents in ``ids``; the first photo, or null."""
    found = corpus.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.select("doc_id", F.substring(X.text_of("text"), 1, max_chars).alias("text"), "rating", F.coalesce("has_image", F.lit(False)).alias("has_image"), F.try_element_at("image_urls", F.lit(1)).alias("image_url"))


def order_problems(expected: DataFrame, given: DataFrame) -> DataFrame:
    """``place, expected_id, given_id`` where a run's questions (``place, question_id``) aren't those asked, in their order."""
    both = expected.select("place", F.col("question_id").alias("expected_id")).join(given.select("place", F.col("question_id").alias("given_id")), "place", "full")
    return both.where(~F.col("expected_id").eqNullSafe(F.col("given_id")))


def completeness_problems(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """``question_id, problem`` of a run: missing, unexpected or blank answers."""
    joined = expected.withColumn("e", F.lit(True)).join(answers, "question_id", "full")
    blank = F.col("answer_text").isNotNull() & (X.strip(X.text_of("answer_text")) == "")
    return _problems(joined, {"missing": F.col("e").isNotNull() & F.col("answer_text").isNull(), "unexpected": F.col("e").isNull(), "blank": blank})


def leaks(texts: DataFrame, protected: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``texts`` whose normal form has the hash of a protected question."""
    hashes = protected.select(X.question_hash(text).alias("question_hash")).distinct()
    return texts.withColumn("question_hash", X.question_hash(text)).join(hashes, "question_hash", "left_semi")


def context_sample(rows: DataFrame, text: str, terms: Sequence[str], n: int, seed: int, max_chars: int, id_col: str) -> DataFrame:
    """Snippets of ``n`` rows that mention any of the terms, in a seeded order; none at all is an error."""
    if not rows.where(X.matches_any(text, terms)).limit(1).count():
        raise ValueError(f"no row mentions any of {list(terms)}")
    return rows.where(X.matches_any(text, terms)).orderBy(seeded_order(id_col, seed)).limit(n).select(id_col, X.truncated(X.text_of(text), max_chars).alias("snippet"))


def cache_key(payload: dict) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def keyed_prompts(prompts: DataFrame, settings: dict) -> DataFrame:
    """``key, prompt``: the distinct prompts and the hashes of their requests."""
    return map_batches(prompts.select("prompt").distinct(), "prompt", "key", lambda ps: [cache_key(settings | {"prompt": p}) for p in ps]).select("key", "prompt")


def answered(keyed: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """``key, prompt, response``, each prompt asked once."""
    return map_batches(keyed.select("key", "prompt"), "prompt", "response", lambda ps: [call(p) for p in ps])


def complete(prompts: DataFrame, responses: DataFrame | None, call: Callable[[str], str], settings: dict) -> DataFrame:
    """``key, prompt, response``: answers from earlier responses, calls for the misses alone.

    Nothing is stored; ``answers.ResponseCache`` does that.
    """
    keyed = keyed_prompts(prompts, settings)
    if responses is None:
        return answered(keyed, call)
    known = keyed.join(responses.select("key", "response"), "key").select("key", "prompt", "response")
    return known.unionByName(answered(keyed.join(responses.select("key"), "key", "left_anti"), call))


def grounded_answers(questions: DataFrame, contexts: DataFrame | None, template: str, call: Callable[[str], str], sentence: str, settings: dict, responses: DataFrame | None = None, cache=None) -> DataFrame:
    """Questions (with contexts, or closed-book) to transcripts: render, complete, parse.

    Replies come from ``cache`` (``answers.ResponseCache``, which keeps new ones) or ``responses``.
    """
    rows = questions if contexts is None else questions.join(contexts.withColumnRenamed("query_id", "question_id"), "question_id", "left")
    values = {"question": "question"} | ({} if contexts is None else {"context": "context_text"})
    rows = rows.withColumn("prompt", X.render(template, **values))
    answered = rows.join(cache.complete(rows, call, settings) if cache else complete(rows, responses, call, settings), "prompt").withColumnRenamed("response", "raw_completion")
    return answered.select("*", X.completion_parts("raw_completion", sentence).alias("_p")).select("*", "_p.*").drop("_p", "prompt", "key")
