"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of paragraphs (lines, cut further at sentence ends).  Each paragraph's digest goes
into one cell of each of three parts of a sketch; a cell holds a count and the xor of its digests.
Sketches of equal size subtract cell by cell, which cancels what two texts share, and peeling
recovers the rest: a cell of count 1 or -1 whose xor passes its checksum is a digest, which is
then taken out of its other cells.  When peeling stops short, larger sketches are tried: digests
split by hash into groups of few, each with its own sketch, which together have three cells or more
for each digest, and larger ones for groups that fail again.

Only DataFrame functions; every row is worked on alone, so memory is bounded by one text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize

#: Cells in each of the three parts: of the fingerprint, then of a group's sketches.
WIDTH, RETRIES = 16, (8, 32)
#: Digests of both texts in a group, at most on average; rounds of peeling.
GROUP, ROUNDS = 8, 12
#: Where paragraphs end.
ENDS = r"\n+|(?<=[.!?])\s+"
#: Rows in one range of ids, and the quantiles, of all ids and of those between two, that ranges are laid between.
RANGE_ROWS, CUTS = 4_000, 64
#: First rows of ranges (about 100 bytes each) that may be broadcast.
RING = 1_000_000

_LOW = (1 << 48) - 1


def _check(low: Column) -> Column:
    """A 16-bit checksum of a 48-bit digest, in the upper bits."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(low), 48), 48)


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text: 48 bits of hash under their checksum."""
    parts = F.filter(F.split(text, ENDS), lambda p: F.trim(p) != "")
    low = F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.trim(p)).bitwiseAND(F.lit(_LOW))))
    return F.transform(low, lambda d: d.bitwiseOR(_check(d)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, as the variable of a one-element array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _place(digest: Column, part: Column, width: int) -> Column:
    """The cell of a digest in one part: its own 16 bits of the digest by the width."""
    return F.call_function("shiftright", digest, part * 16).bitwiseAND(F.lit(width - 1))


def _at(i: Column, width: int) -> tuple[Column, Column]:
    """Part and cell of a position in a sketch; widths are powers of two."""
    return F.shiftright(i, width.bit_length() - 1), i.bitwiseAND(F.lit(width - 1)).cast("long")


def _cells(width: int, cell: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """``cell(at, place)`` for every cell, part after part; ``place`` gives a digest's cell in the part."""

    def part(n: int) -> Column:
        place = lambda d: F.shiftright(d, 16 * n).bitwiseAND(F.lit(width - 1))
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda at: cell(at, place))

    return F.concat(*map(part, range(3)))


def sketch(items: Column, width: int) -> Column:
    """Cells of a set of digests: an array of (count, xor), part after part."""

    def cell(at: Column, place: Callable[[Column], Column]) -> Column:
        return let(
            F.filter(items, lambda d: place(d) == at),
            lambda own: F.struct(F.size(own).alias("n"), F.aggregate(own, F.lit(0).cast("long"), lambda x, d: x.bitwiseXOR(d)).alias("x")),
        )

    return _cells(width, cell)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct((p["n"] - q["n"]).alias("n"), p["x"].bitwiseXOR(q["x"]).alias("x")))


def difference(a: Column, b: Column, width: int) -> Column:
    """``subtract(sketch(a), sketch(b))``, built in one go."""

    def with_sign(items: Column, n: int) -> Column:
        return F.transform(items, lambda d: F.struct(F.lit(n).alias("n"), d.alias("x")))

    signed = F.concat(with_sign(a, 1), with_sign(b, -1))

    def cell(items: Column, at: Column, place: Callable[[Column], Column]) -> Column:
        own = F.filter(items, lambda d: place(d["x"]) == at)
        return F.aggregate(own, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x")), lambda acc, d: F.struct((acc["n"] + d["n"]).alias("n"), acc["x"].bitwiseXOR(d["x"]).alias("x")))

    return let(signed, lambda items: _cells(width, lambda at, place: cell(items, at, place)))


def peel(cells: Column, width: int) -> Column:
    """Digests recovered from a difference: an array of (count, xor), or null on failure.

    Count 1 stands for digests of the first text, -1 for those of the second.
    """

    def pure(cell: Column, i: Column) -> Column:
        part, at = _at(i, width)
        low = cell["x"].bitwiseAND(F.lit(_LOW))
        one = (F.abs(cell["n"]) == 1) & (_place(cell["x"], part, width) == at) & (low.bitwiseOR(_check(low)) == cell["x"])
        return F.when(one, cell)

    def all_pure(cells: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(cells, pure), lambda p: p.isNotNull()))

    def taken_out(cells: Column, found: Column) -> Column:
        def cell(c: Column, i: Column) -> Column:
            part, at = _at(i, width)
            own = F.filter(found, lambda p: _place(p["x"], part, width) == at)
            return F.aggregate(own, c, lambda acc, p: F.struct((acc["n"] - p["n"]).alias("n"), acc["x"].bitwiseXOR(p["x"]).alias("x")))

        return F.transform(cells, cell)

    def step(state: Column, _: Column) -> Column:
        some = let(
            taken_out(state["cells"], state["fresh"]),
            lambda left: F.struct(left.alias("cells"), all_pure(left).alias("fresh"), F.concat(state["found"], state["fresh"]).alias("found")),
        )
        return F.when(F.size(state["fresh"]) == 0, state).otherwise(some)

    def run(cells: Column) -> Column:
        start = F.struct(cells.alias("cells"), all_pure(cells).alias("fresh"), F.filter(cells, lambda c: F.lit(False)).alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda end: F.when(F.forall(end["cells"], lambda c: (c["n"] == 0) & (c["x"] == 0)), end["found"]))

    return let(cells, run)


def _counts(found: Column, way: int) -> Column:
    """How many recovered digests are the first text's, and how many the second's; ``way`` tells who found them."""
    return let(found, lambda f: F.when(f.isNotNull(), F.struct(F.size(F.filter(f, lambda p: p["n"] == 1)).alias("a"), F.size(F.filter(f, lambda p: p["n"] == -1)).alias("b"), F.lit(way).alias("way"))))


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """(a, b, way): how many digests only the first and only the second text has.

    Fingerprints first (way 0), then groups with sketches of growing width (ways 1 and 2, the
    larger one that a group took); digests of a group that no width resolves (two sharing all
    cells) are compared as they are (way 3).
    """
    # Groups by digest bits that no width uses for places, in two steps, so that a long text's
    # digests are filtered twice the square root of its groups, not once for each group.
    bits = F.greatest(F.lit(0), F.ceil(F.log2((F.size(a) + F.size(b) + 1) / F.lit(float(GROUP))))).cast("int")
    outer, inner = F.call_function("shiftleft", F.lit(1), F.shiftright(bits, 1)), F.call_function("shiftleft", F.lit(1), bits - F.shiftright(bits, 1))

    def members(items: Column, shift: int, count: Column, g: Column) -> Column:
        return F.filter(items, lambda d: F.shiftright(d, shift).bitwiseAND(count.cast("long") - 1) == g)

    def compared(p: Column, q: Column) -> Column:
        tries = [_counts(peel(difference(p, q, w), w), way) for way, w in enumerate(RETRIES, 1)]
        return F.coalesce(*tries, F.struct(F.size(F.array_except(p, q)).alias("a"), F.size(F.array_except(q, p)).alias("b"), F.lit(len(RETRIES) + 1).alias("way")))

    def over(count: Column, acc: Column, p: Column, q: Column, shift: int, use: Callable[[Column, Column, Column], Column]) -> Column:
        step = lambda acc, g: let(members(p, shift, count, g), lambda x: let(members(q, shift, count, g), lambda y: use(acc, x, y)))
        return F.aggregate(F.sequence(F.lit(0), count - 1), acc, step)

    def add(acc: Column, p: Column, q: Column) -> Column:
        some = let(compared(p, q), lambda m: F.struct((acc["a"] + m["a"]).alias("a"), (acc["b"] + m["b"]).alias("b"), F.greatest(acc["way"], m["way"]).alias("way")))
        return F.when((F.size(p) == 0) & (F.size(q) == 0), acc).otherwise(some)

    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("way"))
    total = let(F.struct(outer.alias("o"), inner.alias("i")), lambda n: over(n["o"], zero, a, b, 7, lambda acc, p, q: over(n["i"], acc, p, q, 23, add)))
    # A difference of more digests than cells can't be peeled, so it isn't tried.
    fits = F.abs(F.size(a) - F.size(b)) <= 3 * WIDTH
    return F.coalesce(F.when(fits, _counts(peel(subtract(sketch_a, sketch_b), WIDTH), 0)), total)


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Shared digests by all digests of two texts; two texts without paragraphs are alike."""
    shared = F.size(a) - difference["a"]
    every = F.size(a) + difference["b"]
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def as_string(cells: Column, n_chars: Column) -> Column:
    """A fingerprint in writing: the code points of the text, then each cell's count and xor."""
    return F.concat_ws(";", n_chars.cast("string"), F.array_join(F.transform(cells, lambda c: F.concat(c["n"].cast("string"), F.lit(":"), F.lower(F.hex(c["x"])))), ","))


def _longs(values: list[int]) -> Column:
    """A constant array, as one short expression however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _last_start(starts: Column, key: Column) -> Column:
    """The number, from 0, of the last of ascending ``starts`` that isn't over ``key``; 0 without a key."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= key)) - 1, F.lit(0))


def with_range(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``range`` of their ``key`` and ``tie``: a long that ascends with them.

    Ranges lie between quantiles, of all keys and then of those between two, and divide what lies
    between two of these in equal steps; so they follow the keys' distribution and their number
    the number of rows.  The rows of a key that several quantiles meet, and those without a key,
    are divided by their ties.  What comes to the driver are quantiles and the counts of such keys,
    at most ``CUTS * CUTS`` of each.
    """
    cuts, key = [i / CUTS for i in range(CUTS)], F.col("key")
    ids = rows.select("key")
    found = ids.agg(F.count("key").alias("n"), F.count_if(key.isNull()).alias("nulls"), F.min("key").alias("least"), F.max("key").alias("most"), F.percentile_approx("key", cuts, 10_000).alias("cuts")).first()
    n, quantiles = found["n"], [found["least"], *found["cuts"]] if found["n"] else [0]
    coarse = sorted(set(quantiles))
    fine = [[c] for c in coarse]
    if n > RANGE_ROWS * CUTS:
        bins = ids.where(key.isNotNull()).groupBy(_last_start(_longs(coarse), key).alias("bin")).agg(F.percentile_approx("key", cuts, 1_000).alias("cuts"))
        for row in bins.collect():
            quantiles += row["cuts"]
            fine[row["bin"]] = sorted({coarse[row["bin"]], *row["cuts"]})
    several = [q for q, times in Counter(quantiles).items() if times > 2] if n > RANGE_ROWS else []
    hot = {r["key"]: r["count"] for r in ids.where(key.isin(several)).groupBy("key").count().collect()} if several else {}
    parts = {k: min(-(-c // RANGE_ROWS), 1 << 16) for k, c in hot.items() if c > RANGE_ROWS}
    starts = [s for part in fine for s in part]
    steps = max(1, min(n // (RANGE_ROWS * len(starts)), (1 << 24) - 2))

    # A column at a time, so that no long expression is repeated.
    rows = rows.withColumn("at", _last_start(_longs(coarse), key))
    if len(starts) > len(coarse):
        first = [sum(map(len, fine[:i])) for i in range(len(fine))]
        own = F.slice(_longs(starts), F.element_at(_longs(first), F.col("at") + 1).cast("int") + 1, F.element_at(_longs([*map(len, fine)]), F.col("at") + 1).cast("int"))
        rows = rows.withColumn("at", F.element_at(_longs(first), F.col("at") + 1).cast("int") + _last_start(own, key))
    rows = rows.withColumn("start", F.element_at(_longs(starts), F.col("at") + 1)).withColumn("end", F.element_at(_longs([*starts[1:], found["most"] or 0]), F.col("at") + 1))

    def beyond_start(c: Column) -> Column:  # as exact as a long can tell
        return F.coalesce(F.try_subtract(c, F.col("start")).cast("double"), c.cast("double") - F.col("start").cast("double"))

    share = beyond_start(key) * steps / F.greatest(beyond_start(F.col("end")), F.lit(1.0))
    step = F.when(key.isNull() | (key == F.col("start")), 0).otherwise(1 + F.least(F.lit(steps - 1), F.floor(share)))
    rows = rows.withColumn("step", step.cast("long"))
    known = F.try_element_at(F.map_from_arrays(_longs(list(parts)), _longs(list(parts.values()))), key) if parts else F.lit(None).cast("long")
    divided = F.when(key.isNull(), F.lit(min(-(-found["nulls"] // RANGE_ROWS), 1 << 16))).otherwise(F.coalesce(known, F.lit(1)))
    by_tie = F.floor(F.conv(F.substring("tie", 1, 8), 16, 10).cast("double") / float(1 << 32) * divided)
    place = F.when(key.isNull(), F.lit(len(starts))).otherwise(F.col("at")).cast("long")
    rows = rows.withColumn("range", F.shiftleft(place, 40) + F.shiftleft("step", 16) + F.when(F.col("step") == 0, by_tie).otherwise(0).cast("long"))
    return rows.drop("at", "start", "end", "step")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document in descending order of ids.

    Null ids come last, equal ids in the order of their texts' hashes, and after the last document
    stands the first.  Texts move once, to ranges of ids; the first row of each range also goes to
    the range before it.
    """
    # The complement of an id descends with it and, unlike its negative, always fits.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.bitwise_not(F.col("doc_id").cast("long")))
    rows = rows.withColumn("tie", F.md5("text"))
    rows = with_range(rows)
    place = F.struct(F.col("key").isNull().alias("none"), "key", "tie")
    firsts = materialize(rows.groupBy("range").agg(F.min(place).alias("first")), "iblt-firsts")
    # One small row per range meets here.
    ring = Window.partitionBy(F.lit(1)).orderBy("range")
    before = F.coalesce(F.lag("range").over(ring), F.max("range").over(Window.partitionBy(F.lit(1))))
    firsts = materialize(firsts.select(F.col("range").alias("own_range"), before.alias("range_before"), F.col("first.tie").alias("first_tie")), "iblt-ring")
    # Told to, as texts would move a second time to meet them; of a checked size.
    few = F.broadcast(firsts) if firsts.count() <= RING else firsts
    edge = rows.join(few, (F.col("range") == F.col("own_range")) & (F.col("tie") == F.col("first_tie")))
    # Several rows may have the first one's text; any of them serves.
    edge = edge.groupBy("range_before").agg(F.min_by("text", place).alias("text"))
    everything = rows.select("range", "doc_id", "key", "text", "tie", F.lit(0).alias("edge"))
    lone = everything.schema
    everything = everything.unionByName(edge.select(F.col("range_before").alias("range"), F.lit(None).cast(lone["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("key"), "text", F.lit("").alias("tie"), F.lit(1).alias("edge")))
    order = Window.partitionBy("range").orderBy("edge", F.asc_nulls_last("key"), "tie")
    return everything.withColumn("next_text", F.lead("text").over(order)).where(F.col("edge") == 0).select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text replaces the last ``floor(n_chars / 2)`` code points by the first as many (or
    all) of the next document.  Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``, and the ways (see ``differing``) in which the two
    likenesses were found.  Null texts count as empty, and two texts
    without paragraphs have likeness 1; a lone document is its own next; repeated rows follow one
    another; other columns are not read.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    staged = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    staged = staged.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    # One expression each for the three texts and the two pairs.
    of_texts = F.transform(F.array("text", "edited", "next_text"), digests)
    staged = staged.select("doc_id", "n_chars", F.length("edited").alias("edited_chars"), F.sha2("edited", 256).alias("edited_sha256"), of_texts.alias("sets"))
    staged = staged.select("*", F.transform("sets", lambda items: sketch(items, WIDTH)).alias("sketches"))
    sets, sketches = F.col("sets"), F.col("sketches")
    pairs = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(F.get(sets, i).alias("set"), F.get(sketches, i).alias("sketch")))
    found = F.transform(pairs, lambda p: let(differing(sets[0], p["set"], sketches[0], p["sketch"]), lambda d: F.struct(likeness(sets[0], p["set"], d).alias("near"), d["way"].alias("way"))))
    staged = staged.select("*", found.alias("found"))
    return staged.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(sketches[0], F.col("n_chars")).alias("fingerprint"),
        as_string(sketches[1], F.col("edited_chars")).alias("edited_fingerprint"),
        F.col("found")[0]["near"].alias("near_edited"),
        F.col("found")[1]["near"].alias("near_next"),
        F.col("found")[0]["way"].alias("way_edited"),
        F.col("found")[1]["way"].alias("way_next"),
    )
