"""Evaluation: ranking metrics, bootstrap intervals, signed-rank tests, citation scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as X


def score_all(hits: DataFrame, qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``query_id, k, recall, hit, ndcg, mrr`` from ranked hits and distinct relevant pairs.

    Questions without relevant documents are left out; questions without hits score 0.
    """
    if not ks or min(ks) <= 0:
        raise ValueError("every k must be positive")
    wanted = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    found = hits.where(F.col("rank") <= max(ks)).join(qrels, ["query_id", "doc_id"], "left_semi")
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.count_if(inside).alias(f"n{k}"), F.min(F.when(inside, F.col("rank"))).alias(f"first{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0))).alias(f"gain{k}")]
    joined = wanted.join(found.groupBy("query_id").agg(*aggs), "query_id", "left")
    rows = []
    for k in ks:
        n = F.coalesce(F.col(f"n{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
        rows.append(F.struct(F.lit(k).alias("k"), (n / F.col("n_relevant")).alias("recall"), F.when(n > 0, 1.0).otherwise(0.0).alias("hit"), (F.coalesce(F.col(f"gain{k}"), F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1 / F.col(f"first{k}"), F.lit(0.0)).alias("mrr")))
    return joined.select("query_id", F.inline(F.array(*rows)))


METRICS = ("recall", "hit", "ndcg", "mrr")
#: Scores that may be broadcast.
SMALL = 100_000


def summarize(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in METRICS if m in scores.columns), F.count(F.lit(1)).alias("n"))


def bootstrap_ci(scores: Sequence[float], n_boot: int = 10_000, alpha: float = 0.05, rng: np.random.Generator | None = None) -> tuple[float, float, float]:
    """Mean and percentile interval; one generator may serve several calls in turn."""
    values = np.asarray(scores, float)
    if not len(values) or n_boot < 1 or not 0 < alpha < 1:
        raise ValueError("scores, n_boot and alpha must be usable")
    rng = rng or np.random.default_rng(42)
    means = values[rng.integers(0, len(values), (n_boot, len(values)))].mean(1)
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(values.mean()), float(low), float(high)


def bootstrap_ci_frame(scores: DataFrame, keys: Sequence[str], order: str, value: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Interval of each group, each with its own generator.  Groups are question sets, which are
    small by nature; one task holds one group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, low, high = bootstrap_ci(pdf.sort_values(order)[value].to_numpy(), n_boot, alpha, np.random.default_rng(seed))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "mean": mean, "low": low, "high": high}])

    kinds = ", ".join(f"{k} {scores.schema[k].dataType.simpleString()}" for k in keys)
    return scores.groupBy(*keys).applyInPandas(run, f"{kinds}, mean double, low double, high double")


def bootstrap_ci_md5(spark: SparkSession, scores: DataFrame, keys: Sequence[str], order: str, value: str, n_boot: int, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The same interval with draws that any engine can repeat: draw i of resample b is element
    ``md5(seed:b:i) mod n`` of the group in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1  # a group is a question set, small by nature
    values = scores.select(*keys, place.cast("long").alias("at"), F.col(value).alias("x"))
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # Resamples of each group, dealt out, and so many draws of each: the result's own size, not a join.
    resamples = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b")
    draws = resamples.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("b").cast("string"), F.lit(":"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    values = F.broadcast(values) if values.count() <= SMALL else values
    means = draws.select(*keys, "b", (drawn % F.col("n")).alias("at")).join(values, [*keys, "at"]).groupBy(*keys, "b").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))


def wilcoxon(a: Sequence[float], b: Sequence[float]) -> float:
    """Two-sided signed-rank p-value: exact for up to 50 pairs without zeros and ties, otherwise
    the normal approximation with tie correction; 1.0 where all pairs are equal."""
    if len(a) != len(b) or not len(a):
        raise ValueError("need pairs")
    d = np.asarray(a, float) - np.asarray(b, float)
    zeros, d = bool((d == 0).any()), d[d != 0]
    n = len(d)
    if n == 0:
        return 1.0
    size = np.abs(d)
    _, inverse, counts = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    plus = float(ranks[d > 0].sum())
    t = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not zeros and (counts == 1).all():
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(t) + 1]) / 2**n)
    variance = (n * (n + 1) * (2 * n + 1) - float((counts.astype(float) ** 3 - counts).sum()) / 2) / 24
    return math.erfc(abs(t - n * (n + 1) / 4) / math.sqrt(variance) / math.sqrt(2))


def signed_rank_parts(pairs: DataFrame, keys: Sequence[str], slices: int = 64) -> DataFrame:
    """``n, t, z`` of the signed-rank test of ``a`` against ``b``: all but the normal tail.

    Equal differences meet first; their ranks come from running counts over slices of a key, laid
    between quantiles, and then inside a slice, so no task sorts a whole key.
    """
    d = pairs.withColumn("d", F.round(F.col("a") - F.col("b"), 12)).where("d <> 0")
    sizes = d.groupBy(*keys, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("c_plus"))
    cuts = sizes.groupBy(*keys).agg(F.percentile_approx("size", [i / slices for i in range(1, slices)], 1_000).alias("cuts"))
    sliced = sizes.join(cuts, list(keys)).withColumn("slice", F.size(F.filter("cuts", lambda c: c <= F.col("size")))).drop("cuts")
    per = sliced.groupBy(*keys, "slice").agg(F.sum("c").alias("held"))
    starts = per.withColumn("start", F.coalesce(F.sum("held").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    inside = Window.partitionBy(*keys, "slice").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(starts, [*keys, "slice"])
    r = F.col("start") + F.col("before") + (F.col("c") + 1) / 2.0
    sums = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(r * F.col("c_plus")).alias("plus"), F.sum(r * F.col("c")).alias("all"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    t = F.least("plus", F.col("all") - F.col("plus"))
    z = F.abs(t - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2.0) / 24)
    return sums.select(*keys, "n", t.alias("t"), z.alias("z"))


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``a`` and ``b`` side by side; a key that only one side has fails."""
    left, right = a.select(*keys, F.col(value).alias("a"), F.lit(True).alias("_l")), b.select(*keys, F.col(value).alias("b"), F.lit(True).alias("_r"))
    joined = left.join(right, list(keys), "full")
    whole = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("question sets differ"))).otherwise(F.lit(True))
    return joined.where(whole).drop("_l", "_r")


def significance(spark: SparkSession, a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """p-value per ``k`` of two retrievers' question scores, aligned by question."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "p": [wilcoxon(pdf["a"].to_numpy(), pdf["b"].to_numpy())]})

    return paired(a, b, ["k", "query_id"], metric).groupBy("k").applyInPandas(run, f"k {a.schema['k'].dataType.simpleString()}, p double")


def n_relevant_shown(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id, retriever, n_common``: how many of each list's documents are relevant, by partial counts."""
    gold = qrels.select("query_id", "doc_id").distinct().withColumn("_gold", F.lit(1))
    return hits.join(gold, ["query_id", "doc_id"], "left").groupBy("query_id", "retriever").agg(F.count("_gold").cast("int").alias("n_common"))


def similarity(answers: DataFrame, references: DataFrame) -> DataFrame:
    """``arm, question_id, similarity``: the cosine of an answer's vector and its reference's.

    An answer without a reference fails; a vector without length has similarity null.
    """
    joined = answers.join(references.select("question_id", F.col("vector").alias("_reference")), "question_id", "left")
    missing = F.raise_error(F.concat(F.lit("no reference for "), F.col("question_id").cast("string")))
    whole = joined.where(F.when(F.col("_reference").isNull(), missing).otherwise(F.lit(True)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot("vector", "_reference"), F.sqrt(dot("vector", "vector")) * F.sqrt(dot("_reference", "_reference")))
    return whole.select("arm", "question_id", cosine.alias("similarity"))


def lopsided(diffs: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest differences of each sign, ties by question; zeros belong to neither."""
    side = F.when(F.col("diff") > 0, "a").otherwise("b")
    order = Window.partitionBy("winner").orderBy(F.desc(F.abs("diff")), "query_id")
    return diffs.where("diff <> 0").withColumn("winner", side).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def citation_scores(transcripts: DataFrame, relevant: Column | str, expected: Column | str, cited: str = "cited_doc_ids", context: str = "context_doc_ids", answer: str = "answer_text", raw: str = "raw_completion") -> DataFrame:
    """Per transcript: form, fabricated citations, validity, grounding, abstention."""
    n = F.size(cited)
    fabricated = F.filter(cited, lambda d: ~F.array_contains(context, d))
    grounded = F.size(F.filter(cited, lambda d: F.array_contains(relevant, d)))
    return transcripts.withColumns(
        {
            "format_ok": F.size(X.malformed_citations(raw)) == 0,
            "n_citations": n,
            "n_fabricated": F.size(fabricated),
            "citation_validity_rate": F.when(n > 0, (n - F.size(fabricated)) / n),
            "n_grounded_in_gold": F.when(n > 0, grounded),
            "abstention_correct": F.col("abstained") == (F.col(expected) if isinstance(expected, str) else expected),
            "self_contradiction": F.col("abstained") & (n > 0),
            "ungrounded": ~F.col("abstained") & (n == 0),
        }
    )


def citation_summary(scores: DataFrame) -> DataFrame:
    """Micro-averaged validity and grounding, plain shares of the rest; no scores at all are an error."""
    if scores.isEmpty():
        raise ValueError("no scores to sum up")
    cited = F.sum("n_citations")
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        cited.alias("n_citations"),
        F.try_divide(cited - F.sum("n_fabricated"), cited).alias("validity"),
        F.try_divide(F.sum("n_grounded_in_gold"), cited).alias("gold_grounding"),
        F.avg(F.col("format_ok").cast("int")).alias("format_rate"),
        F.avg(F.col("abstention_correct").cast("int")).alias("abstention_accuracy"),
    )


def cohen_kappa(pairs: DataFrame, a: str, b: str, highest: int = 5) -> DataFrame:
    """Quadratic-weighted agreement of two raters with grades 1 to ``highest`` (an extension)."""
    w = F.pow(F.col("a_") - F.col("b_"), 2) / F.lit(float((highest - 1) ** 2))
    cells = pairs.select(F.col(a).cast("double").alias("a_"), F.col(b).cast("double").alias("b_"))
    observed = cells.agg(F.avg(w).alias("o"), F.avg("a_").alias("ma"), F.avg("b_").alias("mb"), F.avg(F.col("a_") * F.col("a_")).alias("qa"), F.avg(F.col("b_") * F.col("b_")).alias("qb"))
    chance = (F.col("qa") + F.col("qb") - 2 * F.col("ma") * F.col("mb")) / F.lit(float((highest - 1) ** 2))
    return observed.select((1 - F.try_divide(F.col("o"), chance)).alias("kappa"))
