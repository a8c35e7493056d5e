"""Corpus building: filters, keep-first de-duplication, joins, stratified sampling, profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.sources.cluster import ship


def normalize_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Collapse white space in string columns; others stay as they are."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: X.normalize_whitespace(c) for c in columns if kinds[c] == "string"})


def drop_empty_text(rows: DataFrame, column: str, min_chars: int) -> DataFrame:
    return rows.where(F.length(X.strip(X.text_of(column))) >= min_chars)


def keep_first(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key by ``order``; null keys are equal to each other.

    The rest of a row travels as one struct through a partial aggregation, so copies of a hot key
    fall away before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*(c if c in keys else F.col(f"_first.{c}") for c in rows.columns))


def filter_language(rows: DataFrame, keep: Sequence[str], column: str = "lang") -> DataFrame:
    return rows.where(F.col(column).isin(*keep))


#: Frequent words by language, and letters that hardly another of these has, for ``detect_language``.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": tuple("the and of to in is that it for with was on this are as be by not at or from have an they you which but his her had were been their has would there what will if can all we she he its".split()),
    "fr": tuple("le la les de des et un une est que qui dans du pour en au aux pas sur plus par ne ce se il elle sont avec son sa ses mais nous vous cette ou où je tout comme être fait été leur".split()),
    "de": tuple("der die das und ist ein eine nicht mit den von zu dem sich auf für im in es auch als an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war".split()),
    "es": tuple("el los de que y en un una es se del las por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde".split()),
}
LETTERS = {"en": "", "fr": "àâçèêëîïôœùûÿ", "de": "äöüß", "es": "ñáíóú¿¡"}
#: What a frequent word counts against one such letter.
WORD_WEIGHT = 2


def detect_language(c: Column | str) -> Column:
    """The language whose frequent words and own letters a text has most of, ties by code; null where none occurs."""
    lower = F.lower(X.text_of(c))
    words = X.split_words(F.regexp_replace(lower, r"(?U)[^\w\s]", " "))

    def weight(code: str) -> Column:
        n = F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS[code]))) * WORD_WEIGHT
        return n + F.regexp_count(lower, F.lit(f"[{LETTERS[code]}]")) if LETTERS[code] else n

    # The greatest struct has the first code among ties.
    scores = [F.struct(weight(code).alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, code in enumerate(sorted(STOP_WORDS))]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["code"])


def filter_detected(rows: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    return rows.where(detect_language(column).isin(*keep))


def review_features(rows: DataFrame, text: str = "text", images: str = "images") -> DataFrame:
    """``token_len, image_urls, n_images, has_image`` beside the given columns."""
    rows = rows.withColumns({"token_len": X.token_len(text), "image_urls": X.image_urls(images)})
    return rows.withColumns({"n_images": F.size("image_urls"), "has_image": F.size("image_urls") > 0})


def filter_step_counts(rows: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows pass the first, the first two ... of some conditions, in one pass."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n_all")]
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    return rows.agg(*counts)


def prepare_right(rows: DataFrame, key: str, rename: Mapping[str, str], *order: str) -> DataFrame:
    """The right side of an m:1 join: renamed columns, first row of each key."""
    return keep_first(rows, [key], *order).withColumnsRenamed(dict(rename))


def join_m1(left: DataFrame, right: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """m:1 left join with ``_matched``.  Which side is broadcast is the optimizer's choice, by
    size.  Null keys match each other only if ``null_safe``."""
    side = right.withColumnRenamed(key, "_key").withColumn("_hit", F.lit(True))
    condition = F.col(key).eqNullSafe(F.col("_key")) if null_safe else F.col(key) == F.col("_key")
    return left.join(side, condition, "left").withColumn("_matched", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def join_report(joined: DataFrame, duplicate_keys: int | Column = 0) -> DataFrame:
    n, hit = F.count(F.lit(1)), F.count_if("_matched")
    return joined.agg(n.alias("n_rows"), hit.alias("n_matched"), (n - hit).alias("n_unmatched"), F.round(F.try_divide(hit, n), 4).alias("match_rate"), F.lit(duplicate_keys).cast("long").alias("duplicate_keys"))


def require_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails on a left row without match."""
    joined = left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left")
    label = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    return joined.where(F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no match for "), label))).otherwise(F.lit(True))).drop("_hit")


def joint_targets(weights: Mapping[str, Mapping[str, float]], target: int) -> list[tuple[tuple[str, ...], int]]:
    """Rows to take from each cell of the product of strata, by largest remainder.

    The weights of a dimension must add up to about 1; the targets add up to ``target``.
    """
    for name, shares in weights.items():
        if not 0.99 <= sum(shares.values()) <= 1.01:
            raise ValueError(f"weights of {name} add up to {sum(shares.values())}")
    cells = []
    for combo in product(*(w.items() for w in weights.values())):
        share = 1.0
        for _, part in combo:
            share *= part
        cells.append((tuple(label for label, _ in combo), share * target))
    whole = [int(x) for _, x in cells]
    spare = target - sum(whole)
    by_rest = sorted(range(len(cells)), key=lambda i: -(cells[i][1] - whole[i]))
    for i in by_rest[: max(0, spare)]:
        whole[i] += 1
    if sum(whole) != target:
        raise ValueError("targets do not add up; check the weights")
    return [(cell, n) for (cell, _), n in zip(cells, whole, strict=True)]


def targets_frame(spark: SparkSession, weights: Mapping[str, Mapping[str, float]], target: int) -> DataFrame:
    rows = [(*cell, n) for cell, n in joint_targets(weights, target)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in weights) + ", target long")


def seeded_order(key: Column | str, seed: int) -> Column:
    """A random-looking order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def _ranked(rows: DataFrame, strata: Sequence[str], order: Column, most: int, slices: int = 64) -> DataFrame:
    """``_rank`` by ``order`` in each stratum for the first ``most`` rows.

    First ranks inside slices of each stratum, which leave ``most`` rows each, then over those:
    no task gathers a whole stratum.
    """
    slim = rows.withColumn("_order", order).withColumn("_slice", F.pmod(F.xxhash64("_order"), F.lit(slices)))
    inner = Window.partitionBy(*strata, "_slice").orderBy("_order")
    slim = slim.withColumn("_place", F.row_number().over(inner)).where(F.col("_place") <= most).drop("_place", "_slice")
    return slim.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_order")))


def with_place(rows: DataFrame, keys: Sequence[str], order: str, name: str, slices: int = 64) -> DataFrame:
    """``rows`` with their place, from 1, by ``order`` in each key; equal ones in any order.

    Places are counted inside slices of a key, between quantiles of ``order``, so no task sorts a whole
    key; an ``order`` that is no number is one slice.
    """
    at = F.col(order).cast("string").try_cast("double")
    cuts = rows.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 1_000).alias("_cuts"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    sliced = rows.join(cuts, condition).select(*rows.columns, F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= at)).alias("_slice"))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sliced.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order)))
    starts = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_slice").alias("_own"), before.alias("_before"))
    condition = F.col("_slice") == F.col("_own")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(starts, condition).select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))


def stratified_sample(rows: DataFrame, targets: DataFrame, strata: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """``min(target, available)`` rows of each stratum without replacement, in a seeded order."""
    most = targets.agg(F.coalesce(F.max("target"), F.lit(0))).first()[0]
    ranked = _ranked(rows, strata, seeded_order(id_col, seed), most)
    return ranked.join(targets, list(strata)).where(F.col("_rank") <= F.col("target")).drop("target", "_rank", "_order")


def sampling_report(rows: DataFrame, targets: DataFrame, strata: Sequence[str]) -> DataFrame:
    have = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
    out = targets.join(have, list(strata), "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return out.withColumn("sampled", F.least("available", "target")).withColumn("shortfall", F.col("target") - F.col("sampled"))


def capped_pool(rows: DataFrame, targets: DataFrame, strata: Sequence[str], position: str, factor: float) -> DataFrame:
    """The first ``ceil(target * factor)`` rows of each stratum by ``position``."""
    caps = targets.withColumn("target", F.ceil(F.col("target") * factor).cast("long"))
    most = caps.agg(F.coalesce(F.max("target"), F.lit(0))).first()[0]
    return _ranked(rows, strata, F.col(position), most).join(caps, list(strata)).where(F.col("_rank") <= F.col("target")).drop("target", "_rank", "_order")


def vocab_coverage(rows: DataFrame, text: str, keywords: Mapping[str, Sequence[str]], top_n: int) -> DataFrame:
    """Per category: rows with any of its terms, their percentage, rows summed over terms, and the
    most frequent terms (ties in list order); one scan for all."""
    flags, aggs = {}, [F.count(F.lit(1)).alias("n")]
    for i, (_, terms) in enumerate(keywords.items()):
        for j, term in enumerate(terms):
            flags[f"t{i}_{j}"] = X.matches_any(text, [term]).cast("long")
            aggs.append(F.coalesce(F.sum(f"t{i}_{j}"), F.lit(0)).alias(f"t{i}_{j}"))
        aggs.append(F.coalesce(F.sum(F.greatest(F.lit(0).cast("long"), *(F.col(f"t{i}_{j}") for j in range(len(terms))))), F.lit(0)).alias(f"c{i}"))
    counted = rows.select(F.col(text)).withColumns(flags).agg(*aggs)
    out = []
    for i, (category, terms) in enumerate(keywords.items()):
        ranked = F.array_sort(F.array(*(F.struct((-F.col(f"t{i}_{j}")).alias("k"), F.lit(j).alias("j"), F.lit(term).alias("term")) for j, term in enumerate(terms))))
        total = sum((F.col(f"t{i}_{j}") for j in range(len(terms))), F.lit(0).cast("long"))
        out.append(F.struct(F.lit(category).alias("category"), F.col(f"c{i}").alias("n_matching"), F.coalesce(F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")), F.lit(0.0)).alias("pct"), total.alias("term_rows"), F.array_join(F.transform(F.slice(ranked, 1, top_n), lambda s: s["term"]), ",").alias("top_terms")))
    return counted.select(F.inline(F.array(*out)))


def topn_plus_other(rows: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """Counts of the ``n`` most frequent values, the rest (nulls too) as ``other``."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col(column).isNotNull()).orderBy(F.desc("n"), column).limit(n).select(F.col(column).alias("_top"))
    named = counts.join(top, F.col(column) == F.col("_top"), "left").withColumn(column, F.coalesce("_top", F.lit(other)))
    return named.groupBy(column).agg(F.sum("n").alias("n"))


def group_sizes_capped(rows: DataFrame, key: str, cap: int) -> DataFrame:
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.least("n", F.lit(cap)).alias("group_size")).agg(F.count(F.lit(1)).alias("n_groups"))


def log_histogram(values: DataFrame, column: str, bins: int, highest: float) -> DataFrame:
    """Counts in log-spaced bins from 1 to ``highest``; smaller values count as 1."""
    step = F.ln(F.lit(highest)) / bins
    at = F.least(F.floor(F.ln(F.greatest(F.col(column).cast("double"), F.lit(1.0))) / step), F.lit(bins - 1))
    return values.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: ``n, mean, std, least, q25, q50, q75, most`` of the values there are, in one pass.

    Quantiles are exact and interpolated: partial aggregates hold a count for each distinct value.
    """
    parts = []
    for c in columns:
        value = F.col(c).cast("double")
        cuts = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts.append(F.struct(F.lit(c).alias("column"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), *(F.get(cuts, F.lit(i)).alias(q) for i, q in enumerate(("q25", "q50", "q75"))), F.max(value).alias("most")))
    return rows.agg(F.array(*parts).alias("c")).select(F.inline("c"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def map_batches(rows: DataFrame, column: str, out: str, call: Callable[[list], list], kind: str = "string") -> DataFrame:
    """A column worked out by a function over batches: encoders, model clients."""
    ship(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: call(batch[column].tolist())})[[*names, out]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` {kind}"
    return rows.mapInPandas(run, schema)


def project(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns in order; one that is missing is an error that names it."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise KeyError(f"no columns {missing}; there are {rows.columns}")
    return rows.select(*columns)


def build_corpus(reviews: DataFrame, metadata: DataFrame, weights: Mapping[str, Mapping[str, float]], target: int, seed: int, position: str, id_col: str, languages: Sequence[str] = ("en",), min_chars: int = 5, dedup_on: Sequence[str] = ("user_id", "parent_asin", "text"), factor: float = 1.5, columns: Sequence[str] | None = None) -> DataFrame:
    """The corpus from reviews and metadata: cap each stratum in file order, clean, drop copies,
    keep languages, add features, join metadata, sample, and project to ``columns`` if given."""
    targets = targets_frame(reviews.sparkSession, weights, target)
    pool = reviews.withColumn("rating_bucket", X.rating_bucket("rating"))
    pool = review_features(pool).withColumn("has_image", F.col("has_image").cast("string"))
    pool = capped_pool(pool, targets, list(weights), position, factor)
    pool = drop_empty_text(normalize_columns(pool, ["title", "text"]), "text", min_chars)
    pool = filter_detected(keep_first(pool, list(dedup_on), position), "text", languages)
    side = prepare_right(metadata.withColumnRenamed("title", "product_title"), "parent_asin", {}, "product_title")
    joined = join_m1(pool, side, "parent_asin", null_safe=True).drop("_matched")
    sampled = stratified_sample(joined, targets, list(weights), id_col, seed)
    return sampled if columns is None else project(sampled, columns)
