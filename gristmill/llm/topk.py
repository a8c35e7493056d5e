"""Exact top-k search by inner product.

Queries go out in blocks of bounded size; every task multiplies a block with tiles of its shard,
picks from each tile what beats its running lists of the best ``k``, and a tree of merges joins
the lists of all tasks.  Scores are integers, so results do not depend on the order of merging.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, prepare

#: Bytes of queries that one pass over the vectors searches, and rows of queries and of candidates in a tile.
BLOCK_BYTES, QUERIES, TILE = 32 << 20, 1_024, 2_048
#: Lists that one merge joins.
FAN_IN = 16

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def matrices(ids: pa.Array, vectors: pa.ListArray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``ids`` and ``floor(scale * vector)`` by dimension, without rows that take no part."""
    lengths = np.diff(vectors.offsets.to_numpy())
    there = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[there]):
        rows = np.flatnonzero(there & (lengths == dim))
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(flat.reshape(len(rows), dim) * scale)
        fine = np.isfinite(values).all(1)
        if fine.any():
            yield ids.take(pa.array(rows[fine])).to_numpy(zero_copy_only=False).astype(np.int64), values[fine]


def scores(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exact; beyond a long they count as the nearest long.

    Rows of components so small that no sum reaches 2**53 are multiplied as floats, others up to
    2**63 as integers, and the few beyond as numbers of any length.
    """
    dim = max(1, tile.shape[1])
    small, middle = isqrt((2**53 - 1) // dim), isqrt((2**63 - 1) // dim)
    high = [np.abs(m).max(1, initial=0) for m in (queries, tile)]
    if max(h.max(initial=0) for h in high) <= small:
        return (queries @ tile.T).astype(np.int64)
    out = np.empty((len(queries), len(tile)), np.int64)
    ranks = [(h > small).astype(int) + (h > middle) for h in high]
    for a in range(3):
        for b in range(3):
            q, t = np.flatnonzero(ranks[0] == a), np.flatnonzero(ranks[1] == b)
            if not len(q) or not len(t):
                continue
            if max(a, b) == 0:
                found = (queries[q] @ tile[t].T).astype(np.int64)
            elif max(a, b) == 1:
                found = queries[q].astype(np.int64) @ tile[t].astype(np.int64).T
            else:
                whole = [np.array([[int(x) for x in row] for row in m], object).reshape(len(m), -1) for m in (queries[q], tile[t])]
                found = np.array([[min(max(int((x * y).sum()), _LEAST), _MOST) for y in whole[1]] for x in whole[0]], np.int64)
            out[np.ix_(q, t)] = found
    return out


class TopLists:
    """The best ``k`` candidates so far of every query of one dimension."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = own, queries, k
        self.ids, self.scores = (np.zeros((len(own), k), np.int64) for _ in range(2))
        self.held = np.zeros(len(own), np.int64)

    def add(self, ids: np.ndarray, tile: np.ndarray) -> None:
        """Fold in a tile.  A candidate with the query's own id takes no part; ties go to smaller ids."""
        for start in range(0, len(self.own), QUERIES):
            part = slice(start, start + QUERIES)
            found = scores(self.queries[part], tile)
            take = ids[None, :] != self.own[part, None]
            full = self.held[part] == self.k
            if full.any():
                least, last = self.scores[part, -1][full, None], self.ids[part, -1][full, None]
                take[full] &= (found[full] > least) | ((found[full] == least) & (ids[None, :] < last))
            if not full.all() and len(ids) > self.k:
                at, open_ = len(ids) - self.k, np.where(take[~full], found[~full], _LEAST)
                take[~full] &= open_ >= np.partition(open_, at, axis=1)[:, at, None]
            q, c = np.nonzero(take)
            if len(q):
                self._merge(start, q, ids[c], found[q, c])

    def _merge(self, start: int, q: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        rows = np.unique(q) + start
        old = np.repeat(rows, self.held[rows])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.held[rows]) - self.held[rows], self.held[rows])
        query = np.concatenate([old, q + start])
        ids, found = np.concatenate([self.ids[old, place], ids]), np.concatenate([self.scores[old, place], found])
        order = np.lexsort((ids, ~found, query))
        query, ids, found = query[order], ids[order], found[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        kept = place < self.k
        self.ids[query[kept], place[kept]], self.scores[query[kept], place[kept]] = ids[kept], found[kept]
        self.held[rows] = np.minimum(self.k, np.bincount(query, minlength=rows[-1] + 1)[rows])


def search_block(vectors: DataFrame, block: list[tuple[np.ndarray, np.ndarray]], k: int, scale: float) -> DataFrame:
    """Per task and query, the best ``k`` of the task's rows: ``query, query_id, node, top``.

    ``query`` numbers the queries of the block; the cost in ``top`` is the complement of the score.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("node", pa.int64()), ("top", pa.list_(pa.struct([("cost", pa.int64()), ("vec_id", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {queries.shape[1]: TopLists(own, queries, k) for own, queries in shared.value}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {dim: [] for dim in tops}

        def fold(dim: int) -> None:
            if waiting[dim]:
                tops[dim].add(np.concatenate([i for i, _ in waiting[dim]]), np.concatenate([v for _, v in waiting[dim]]))
                waiting[dim].clear()

        for batch in batches:
            for ids, values in matrices(batch.column(0), batch.column(1), scale):
                dim = values.shape[1]
                if dim in tops:
                    waiting[dim].append((ids, values))
                    if sum(len(i) for i, _ in waiting[dim]) >= TILE:
                        fold(dim)
        number = 0
        for dim, lists in tops.items():
            fold(dim)
            for start in range(0, len(lists.own), QUERIES):
                held = lists.held[start : start + QUERIES]
                inside = np.arange(k)[None, :] < held[:, None]
                entries = pa.StructArray.from_arrays([pa.array(~lists.scores[start : start + QUERIES][inside]), pa.array(lists.ids[start : start + QUERIES][inside])], names=["cost", "vec_id"])
                top = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(held)]).astype(np.int32), entries)
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(held)) + number + start), pa.array(lists.own[start : start + QUERIES]), pa.array(np.full(len(held), TaskContext.get().partitionId())), top], schema=schema
                )
                yield rows.filter(pa.array(held > 0))
            number += len(lists.own)

    return vectors.mapInArrow(run, "query long, query_id long, node long, top array<struct<cost: bigint, vec_id: bigint>>")


def merged(lists: DataFrame, tasks: int, k: int) -> DataFrame:
    """The lists of all tasks as one for each query, ``FAN_IN`` at a time."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    while True:
        tasks = -(-tasks // FAN_IN)
        lists = lists.groupBy("query", "query_id", F.floor(F.col("node") / FAN_IN).alias("node")).agg(best)
        if tasks <= 1:
            return lists


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best candidates of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of the same
    dimension but those with the query's own id.  Rows with a null id or vector, or with a null or
    non-finite component (scaled or not), take no part.  Repeated candidates each count; where
    several rows share a query's id, each distinct vector is searched and the rows come out
    together.  Scores are exact; one that no long can hold counts as the nearest long.  Other
    columns are not read.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be positive")
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    held = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    # Blocks by hash, as many as keep each near half of BLOCK_BYTES; only one is on the driver at a time.
    blocks = max(1, -(-held["n"] * max(1, held["dim"]) * 8 // (BLOCK_BYTES // 2)))
    parts = []
    for b in range(blocks):
        block = _block(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), float(scale))
        found = merged(search_block(rows, block, k, float(scale)), rows.rdd.getNumPartitions(), k).select("query_id", F.posexplode("top").alias("pos", "hit"))
        # A pass of its own each, so that neither the plan nor what is broadcast at a time grows with the queries.
        parts.append(materialize(found, "topk-pass") if blocks > 1 else found)
    found = reduce(DataFrame.unionAll, parts)
    return found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not(F.col("hit.cost")).alias("score"))


def _block(queries: DataFrame, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries of one block by dimension, in an order that doesn't depend on how they arrive."""
    found = queries.toArrow().combine_chunks()
    out = []
    if found.num_rows:
        for ids, values in matrices(found.column(0).chunk(0), found.column(1).chunk(0), scale):
            order = np.lexsort((*values.T[::-1], ids))
            out.append((ids[order], values[order]))
    return out
