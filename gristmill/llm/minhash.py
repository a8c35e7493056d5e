"""Near-duplicates: MinHash bands propose pairs, sequential Bayesian tests prune them, full sets
confirm them.

1. Texts become sets of word shingles; texts of equal sets are one class.
2. Classes that agree on all hashes of a band share a bucket.  Buckets with the same members are
   one; a large bucket is cut into tiles, and tasks compare tile with tile.
3. Inside a task, signatures are compared batch by batch.  After each batch a pair is dropped if
   the posterior probability (uniform prior) that its similarity reaches the threshold is below
   the chosen miss probability.  Survivors are confirmed on their full sets.  Pairs that earlier
   confirmed links of the task connect need no test, so a task returns a spanning forest of its
   members and never all pairs.
4. Components of the confirmed links give each document's group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, prepare, texts, unused

#: Bands of rows: at similarity 0.8 all bands miss a pair with probability (1 - 0.8**5)**30, 7e-6.
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: Hashes in a batch, and the probability at which the Bayesian test may drop a true pair.
BATCH, MISS = 30, 1e-5
#: Members of a tile.
TILE = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20240229)
    return rnd.integers(0, 2**63, HASHES, dtype=np.uint64), rnd.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of a text.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text of fewer words is
    one shingle; a text without words has none.
    """

    def __init__(self, width: int):
        import xxhash

        self.hash, self.width = xxhash.xxh3_64_intdigest, width
        self.factors = np.random.default_rng(7).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([self.hash(b"\x00" + b" ".join(words))], np.uint64)
        h = np.fromiter(map(self.hash, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        total = np.zeros(n, np.uint64)
        for i, factor in enumerate(self.factors):
            total += h[i : i + n] * factor
        return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each hash function."""
    salt, factor = _hash_functions()
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[at : at + 1024, None] ^ salt) * factor).min(0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per row and band; bands never share buckets."""
    bands = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        key = _mixed(key + bands[:, :, r] + _MIX)
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest matches with which a pair goes on.

    With m matches in n the posterior of the similarity is Beta(m + 1, n - m + 1), whose upper
    tail at the threshold is the chance of at most m successes in n + 1 trials.
    """

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return tuple(next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(BATCH, HASHES + 1, BATCH))


def compare_tile(ids: list[int], side: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], band: int, across: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Confirmed links of one tile, or between two, that connect what was not connected yet.

    A pair is compared in the bucket of its first shared band alone.
    """
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    least = least_matches(percent / 100)
    sizes = np.array([len(s) for s in sets])
    for x in range(len(ids) - 1):
        rest = np.arange(x + 1, len(ids))
        if across:
            rest = rest[side[rest] != side[x]]
        rest = rest[100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x])]
        matches = np.zeros(len(rest), int)
        for batch, enough in enumerate(least):
            part = slice(batch * BATCH, (batch + 1) * BATCH)
            matches = matches + (signatures[rest, part] == signatures[x, part]).sum(1)
            rest, matches = rest[matches >= enough], matches[matches >= enough]
        if len(rest):
            shared = (signatures[rest] == signatures[x]).reshape(-1, BANDS, ROWS).all(2)
            rest = rest[shared.any(1) & (shared.argmax(1) == band)]
        for y in rest.tolist():
            a, b = find(x), find(y)
            if a == b:
                continue
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                parent[b] = a
                yield ids[x], ids[y]


def _halves(digest: int) -> tuple[int, int]:
    """A 128-bit digest as two longs."""
    return (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature``; equal sets have equal ``set_a, set_b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            n, a, b, signatures = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingler(text)
                both = _halves(xxhash.xxh3_128_intdigest(found.tobytes()))
                n.append(len(found))
                a.append(both[0])
                b.append(both[1])
                signatures.append(signature(found).tobytes() if n[-1] else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _bands(classes: DataFrame) -> DataFrame:
    """``key, band, set_a, set_b`` for every class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2"))
                own = [np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS) for i in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), *map(pa.array, own)], names=["key", "band", "set_a", "set_b"])

    return classes.select("set_a", "set_b", "signature").mapInArrow(run, "key long, band int, set_a long, set_b long")


def _tiles(classes: DataFrame) -> DataFrame:
    """``key, band, i, j, own, set_a, set_b``: which classes meet in which comparison of tiles."""
    bands = _bands(classes)
    member = F.xxhash64("set_a", "set_b")
    buckets = bands.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(member.bitwiseAND(F.lit(0xFFFFFFFF))).alias("total"), F.bit_xor(member).alias("parity"))
    # Buckets of the same members are one, in the earliest of their bands.
    kept = buckets.where("n > 1").groupBy("n", "total", "parity").agg(F.min(F.struct("band", "key")).alias("first"))
    kept = kept.select(F.col("first.key").alias("key"), F.ceil(F.col("n") / TILE).cast("long").alias("tiles"))
    rows = bands.join(kept, "key").withColumn("own", F.pmod(member, F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return rows.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_a", "set_b")


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``u, v``: ids of representatives of classes confirmed to be similar; a spanning forest."""
    tiles = materialize(_tiles(classes), "minhash-tiles")
    needed = tiles.select("set_a", "set_b").distinct().join(classes, ["set_a", "set_b"]).select("set_a", "set_b", "doc_id", "signature")
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).join(needed, "doc_id")

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            out = []
            for a, b, doc_id, sig, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingler(text).tobytes()
                if _halves(xxhash.xxh3_128_intdigest(found)) == (a, b):  # not another text of the same id
                    out.append({"set_a": a, "set_b": b, "doc_id": doc_id, "signature": sig, "shingles": found})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("doc_id", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())]))

    sets = rows.select("set_a", "set_b", "doc_id", "signature", "text").mapInArrow(make_sets, "set_a long, set_b long, doc_id long, signature binary, shingles binary")
    sets = sets.dropDuplicates(["set_a", "set_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def compared() -> pa.RecordBatch:
            ids = [r[5] for r in group]
            found = list(
                compare_tile(ids, np.array([r[4] for r in group]), np.frombuffer(b"".join(r[6] for r in group), "<u2").reshape(-1, HASHES), [np.frombuffer(r[7], np.uint64) for r in group], group[0][1], group[0][2] != group[0][3], percent)
            )
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for row in chain.from_iterable(zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True) for at in range(0, batch.num_rows, 64)):
                if group and (row[0], row[2], row[3]) != (group[0][0], group[0][2], group[0][3]):
                    yield compared()
                    group = []
                group.append(row)
        if group:
            yield compared()

    met = tiles.join(sets, ["set_a", "set_b"]).select("key", "band", "i", "j", "own", "doc_id", "signature", "shingles")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")
    return met.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``u, v`` edges reaches.

    Every round each node moves to the neighbour of least hash (itself included) and the graph
    contracts; nodes fall by a constant factor, whatever the shape of the graph.
    """
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "components-edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = F.struct(F.xxhash64("v", F.lit(len(moves))), "v")
        least = both.groupBy("u").agg(F.min(rank).alias("best"))
        own = F.struct(F.xxhash64("u", F.lit(len(moves))), F.col("u").alias("v"))
        move = materialize(least.select("u", F.least(F.col("best"), own)["v"].alias("to")), "components-move")
        moves.append(move)
        moved = edges.join(move, "u").select(F.col("to").alias("a"), "v").join(move.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        edges = materialize(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "components-edges")
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = moves[0].select(F.col("u").alias("node"), F.col("to").alias("label"))
    for move in moves[1:]:
        labels = labels.join(move.select(F.col("u").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = materialize(labels, "components-labels")
    return labels.join(labels.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their shingle sets.
    Null and empty texts have no shingles and no links.  Rows with equal ``doc_id`` are one node;
    a row with a null ``doc_id`` has no links, a null component and is not kept.  Other columns
    are not read.
    """
    prepare(docs.sparkSession)
    rows = materialize(shingled(docs, width), "minhash-rows")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "signature")).alias("first"))
    classes = materialize(classes.select("set_a", "set_b", "first.doc_id", "first.signature"), "minhash-classes")
    members = rows.join(classes.select("set_a", "set_b", F.col("doc_id").alias("first_id"), F.lit(True).alias("found")), ["set_a", "set_b"], "left")
    first = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id"))
    members = materialize(members.select("doc_id", "n_shingles", first.alias("first_id")), "minhash-members")
    # An id that stands for several texts connects their classes.
    several = members.groupBy("doc_id").agg(F.min("first_id").alias("u"), F.max("first_id").alias("most")).where("u < most")
    several = members.join(several, "doc_id").select("u", F.col("first_id").alias("v"))
    found = components(links(docs, classes, width, percent).unionByName(several))
    out = members.join(found, F.col("first_id") == F.col("node"), "left")
    component = F.coalesce("component", "first_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document of the smallest id.

    Of several rows with that id the one whose text has the least hash stays; rows with a null
    ``doc_id`` have no links and stay.
    """
    kept = groups(docs, width, percent).where("kept").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.md5(F.coalesce("text", F.lit(""))))
    (place,) = unused(docs, "place")
    known = docs.join(kept, "doc_id", "left_semi").withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return known.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
