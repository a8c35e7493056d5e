"""Studies: retrievers and chunking schemes scored over a benchmark, with intervals and tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import evaluation as E
from gristmill.operators import retrieval as R
from gristmill.sources.configs import ChunkingConfig
from gristmill.sources.cluster import materialize


def parent_hits(retriever: R.Retriever, chunks: DataFrame, questions: DataFrame, depth: int) -> DataFrame:
    """``query_id, doc_id, score, rank`` of parents, from the best ``depth`` chunks of each question."""
    hits = R.collapse_to_parents(retriever.search_batch(questions.select("query_id", "text"), depth), chunks)
    return hits.withColumn("doc_id", F.col("doc_id").cast("string"))


def score_retriever(retriever: R.Retriever, chunks: DataFrame, questions: DataFrame, qrels: DataFrame, ks: Sequence[int], multiplier: int = 1) -> DataFrame:
    """``query_id, type, k, recall, hit, ndcg, mrr``: ``max(ks) * multiplier`` chunks of each question,
    collapsed to parents.

    ``questions`` has ``query_id, text, type``; those without relevant documents are left out.
    """
    hits = parent_hits(retriever, chunks, questions, max(ks) * multiplier)
    gold = qrels.select("query_id", F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return E.score_all(hits, gold, ks).join(questions.select("query_id", "type"), "query_id").select("query_id", "type", "k", *E.METRICS)


def summarize_with_intervals(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str] = E.METRICS, order: str = "query_id", n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Per group: ``n_questions`` and of each metric ``_mean, _ci_lo, _ci_hi``; ordered by ``keys``."""
    out = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_questions"))
    for metric in metrics:
        found = E.bootstrap_ci_frame(scores, keys, order, metric, n_boot, alpha, seed)
        out = out.join(found.withColumnsRenamed({"mean": f"{metric}_mean", "low": f"{metric}_ci_lo", "high": f"{metric}_ci_hi"}), list(keys))
    return out.orderBy(*keys)


def recall_by_type(scores: DataFrame, k: int, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Recall at ``k`` per type and retriever with intervals; a retriever without scores at ``k`` fails."""
    have = {r["retriever"]: set(r["ks"]) for r in scores.groupBy("retriever").agg(F.collect_set("k").alias("ks")).collect()}
    without = sorted(name for name, ks in have.items() if k not in ks)
    if without or not have:
        raise ValueError(f"no scores at k={k} for {without or 'any retriever'}")
    return summarize_with_intervals(scores.where(F.col("k") == k), ["type", "retriever", "k"], ["recall"], n_boot=n_boot, alpha=alpha, seed=seed)


def retrieval_study(builders: Mapping[str, Callable[[DataFrame], R.Retriever]], chunks: DataFrame, questions: DataFrame, qrels: DataFrame, ks: Sequence[int], smoke: str, multiplier: int = 1, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame, dict[str, dict]]:
    """Retrievers compared: (table, question scores, build reports).

    The table has a row per ``k`` and retriever, in that order, with means, intervals and, where
    there are two retrievers, the p-value of each metric, which belongs to the pair.
    """
    chunks = R.check_chunks(chunks)
    reports, parts = {}, []
    for name, build in builders.items():
        retriever, reports[name] = R.build_report(name, build, chunks, smoke)
        parts.append(score_retriever(retriever, chunks, questions, qrels, ks, multiplier).withColumn("retriever", F.lit(name)))
    scores = materialize(reduce(DataFrame.unionByName, parts), "study-scores")
    table = summarize_with_intervals(scores, ["k", "retriever"], n_boot=n_boot, alpha=alpha, seed=seed)
    if len(builders) == 2:
        a, b = (scores.where(F.col("retriever") == name) for name in builders)
        for metric in E.METRICS:
            p = E.significance(scores.sparkSession, a, b, metric).withColumnRenamed("p", f"{metric}_p")
            table = table.join(F.broadcast(p), "k", "left")  # one row per k
    return table.orderBy("k", "retriever"), scores, reports


def chunking_study(docs: DataFrame, schemes: Mapping[str, ChunkingConfig], questions: DataFrame, qrels: DataFrame, ks: Sequence[int], multiplier: int = 10, build: Callable[[DataFrame], R.Retriever] = R.BM25, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Chunking schemes compared by recall: (summary in order of scheme and ``k``, question scores)."""
    parts = []
    for label, config in schemes.items():
        chunks = R.chunk(docs, config.scheme, config.fixed_token_size, config.sentence_window_size)
        # Ids alone are written; texts are made once more for the index.
        parents = R.check_chunks(materialize(chunks.select("chunk_id", "parent_doc_id"), "study-parents"))
        retriever = build(chunks.select(F.col("chunk_id").alias("doc_id"), "text"))
        parts.append(score_retriever(retriever, parents, questions, qrels, ks, multiplier).select(F.lit(label).alias("scheme"), "query_id", "type", "k", "recall"))
    scores = materialize(reduce(DataFrame.unionByName, parts), "study-scores")
    return summarize_with_intervals(scores, ["scheme", "k"], ["recall"], n_boot=n_boot, alpha=alpha, seed=seed), scores


def winloss_details(hits: DataFrame, selected: DataFrame, texts: DataFrame, qrels: DataFrame, k: int = 5, snippet: int = 200) -> DataFrame:
    """What the retrievers showed for selected questions.

    ``hits`` (``query_id, retriever, doc_id, rank, score``) are those of the study; nothing is
    searched again.  ``selected`` has ``query_id, winner``.  One row per question, retriever and
    rank up to ``k``: the snippet, and whether the document is relevant.
    """
    shown = hits.where(F.col("rank") <= k).join(selected, "query_id").join(texts.select("doc_id", "text"), "doc_id")
    gold = qrels.select("query_id", "doc_id").distinct().withColumn("gold", F.lit(True))
    return shown.join(gold, ["query_id", "doc_id"], "left").select(
        "query_id", "winner", "retriever", "rank", "doc_id", "score", F.substring("text", 1, snippet).alias("snippet"), F.coalesce("gold", F.lit(False)).alias("is_relevant")
    )
