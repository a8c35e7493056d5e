"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time 0 to 1: a line from one weight to another.
Its integral is the source's share of all words; inverting the cumulative demand assigns to every
document the times at which the mix reaches it, and a range sort by time is the training order.

Only DataFrame functions: sums over many documents are aggregated per slice of a source before
any window sees them, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, materialize, unused

#: Hexadecimal digits of the order's hash that name a slice of a source; running sums are taken
#: over the 4,096 slices first, then inside each.
SLICE_DIGITS = 3
#: Weights at the start and the end of training, repeating over the sources; the integrals are 1, 2 and 3.
SCHEDULES = ((1.5, 0.5), (1.0, 3.0), (4.5, 1.5))


def source_targets(sizes: DataFrame, schedules: tuple[tuple[float, float], ...], cap: int) -> DataFrame:
    """``source, source_size, target, tilt`` from one row per source: ``source, source_size``.

    Schedules repeat in code-point order, null last; a source's weight is the integral of its
    schedule, its tilt how far the schedule rises (or falls) from the middle, by its weight.
    Targets share the sum of all sizes by weight; none exceeds ``cap`` times its source, the excess
    going to the others by weight: with sources in the order in which a rising water line reaches
    their caps, the line stands where the first source is not yet full.  One row per source is all
    that meets in one task.
    """
    if any(min(s) < 0 or sum(s) <= 0 for s in schedules):
        raise ValueError("weights can't be negative, nor a schedule's integral zero")
    everyone = Window.partitionBy(F.lit(1))
    by_name = everyone.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("n", F.row_number().over(by_name) - 1)
    own = (F.col("n") % len(schedules) + 1).cast("int")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit((a + b) / 2) for a, b in schedules)), own))
    ranked = ranked.withColumn("tilt", F.element_at(F.array(*(F.lit((b - a) / (a + b)) for a, b in schedules)), own))
    full = F.col("source_size") * cap
    order = everyone.orderBy(full / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone)
    line = (total - F.coalesce(F.sum(full).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    ranked = ranked.withColumn("line", line).withColumn("fits", F.col("line") * F.col("weight") <= full)
    ranked = ranked.withColumn("water", F.min(F.when(F.col("fits"), F.struct(full / F.col("weight"), "n", "line"))).over(everyone))
    target = F.when(F.col("water").isNull() | (F.col("water.line") * F.col("weight") > full), full.cast("double")).otherwise(F.col("water.line") * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"), "tilt")


def inverse_demand(amount: Column, target: Column, tilt: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``amount``.

    The rate at time t is ``target * (1 + tilt * (2 t - 1))``, so the demand until t is
    ``target * (t + tilt * (t * t - t))``, a quadratic with one root in 0 to 1 for |tilt| <= 1.
    """
    share = F.try_divide(amount, target)
    b = F.lit(1.0) - tilt
    # The stable form of the root, also right for a tilt of 0.
    return F.coalesce(F.try_divide(F.lit(2.0) * share, b + F.sqrt(F.greatest(b * b + F.lit(4.0) * tilt * share, F.lit(0.0)))), F.lit(0.0))


def mix(docs: DataFrame, schedules: tuple[tuple[float, float], ...] = SCHEDULES, cap: int = 3) -> DataFrame:
    """The mix's plan, one row per document in training order.

    Columns: ``doc_id, size`` (words), ``source_size, target, taken`` (words that the mix takes,
    repeats counted), ``position``, the training time of the first take, null if none, and
    ``positions``, those of all takes.

    Within a source, documents stand in an order by hash; the mix passes through it until the
    target is met, so each document is taken as often as whole passes go and the last pass ends
    inside one document.  A schedule's integral decides how many words a source gives, its course
    when they come.  Null texts have size 0; null sources are a source of their own; a source
    without words has target 0; repeated rows are documents of their own.  Other columns are not
    read.
    """
    return _planned(docs, schedules, cap).orderBy(F.asc_nulls_last("position"), "doc_id")


def _planned(docs: DataFrame, schedules: tuple[tuple[float, float], ...] = SCHEDULES, cap: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """The plan without its order; ``keys`` are columns that come along and settle ties."""
    sized = docs.select(*keys, "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("mixed"))
    # From here on only ids, sources and sizes travel.
    sized = materialize(sized.withColumn("slice", F.substring("mixed", 1, SLICE_DIGITS)), "mix-sizes")
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    sources = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, cap)
    by_slice = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("offset", F.coalesce(F.sum("words").over(by_slice), F.lit(0)))
    # At most 4,096 rows for each source: small beside the documents, whichever join is chosen.
    starts = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(starts["source"], "slice", "offset", "source_size", "target", "tilt")
    within = Window.partitionBy("source", "slice").orderBy("mixed", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["source"]) & (placed["slice"] == starts["slice"])).select(*(placed[k] for k in keys), placed["doc_id"], "size", "source_size", "target", "tilt", (F.col("inside") + F.col("offset")).alias("before"))
    words = F.round("target").cast("long")
    passes = F.coalesce(F.floor(F.try_divide(words, F.col("source_size"))), F.lit(0)).cast("long")
    rest = words - passes * F.col("source_size")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    takes = F.filter(F.sequence(F.lit(0), F.lit(cap)), lambda p: p * F.col("size") < F.col("taken"))
    times = F.transform(takes, lambda p: F.least(F.lit(1.0), inverse_demand((F.col("before") + p * F.col("source_size")).cast("double"), F.col("target"), F.col("tilt"))))
    placed = placed.withColumn("taken", taken).withColumn("positions", times).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return placed.select(*keys, "doc_id", "size", "source_size", "target", "taken", "position", "positions")


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them: whole documents, repeated as planned, in training order.

    A last take of under half a document is left out, one of at least half becomes whole.  Each row
    has its own plan, whatever its ``doc_id``.
    """
    keys = unused(docs, "mix_content", "mix_row", "mix_position")
    rows = materialize(docs.withColumn(keys[0], F.xxhash64(*docs.columns)).withColumn(keys[1], F.monotonically_increasing_id()), "mix-rows")
    plan = _planned(rows, **settings, keys=tuple(keys[:2]))
    copies = F.coalesce(F.round(F.try_divide("taken", "size")), F.lit(0)).cast("int")
    plan = plan.select(keys[1], F.explode(F.slice("positions", F.lit(1), copies)).alias(keys[2]))
    return rows.join(plan, keys[1]).orderBy(keys[2], "doc_id", keys[0]).select(*docs.columns)
