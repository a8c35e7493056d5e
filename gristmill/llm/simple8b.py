"""Token ids in Simple-8b words.

Each 64-bit word holds a 4-bit selector and as many ids as fit in 60 bits at the selector's width.
An id of 2**60 - 1 or more is an escape: a word of the last selector that holds only ones, with
the id itself in the next word.  A block holds whole documents and their lengths, so that it is
decoded without any other; decoding expands all words of one selector at a time, as array
operations.

The file format is a Parquet table with one row per block, which gives atomic commits when tasks
are retried: ``shard, block, n_ids, doc_ids, lengths, words``.  ``lengths`` are ids per
document, whose running sums are the documents' offsets in the block; ``words`` are little-endian
64-bit words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, prepare, slices, texts
from gristmill.llm.encoders import json_id_cache
from gristmill.llm.segments import chunks

#: Fixed values of the format: ids per word and bits per id, by selector.  Selectors 0 and 1 are
#: runs of zeros; selector 15 holds one id of up to 60 bits, or an escape.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = (1 << 60) - 1
#: A block ends after so many ids.
BLOCK_IDS = 65_536
#: Bytes of input to a shard, as files hold them, and the most shards that quantiles can tell apart.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 50_000


def _needed(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; from 2**53 on possibly one too many, which no width below 60 admits."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """Simple-8b words of unsigned 64-bit ``ids``.

    Greedy: each word takes the selector with the most ids that fit.  The widest id of each window
    of 1, 2, 3 ... 240 ids comes from two overlapping shorter windows, for all positions at once;
    windows may run past the end, where zeros stand.
    """
    n = len(ids)
    if not n:
        return b""
    ids = ids.astype(np.uint64)
    widest = np.concatenate([_needed(ids), np.zeros(240, np.uint8)])
    choice = np.full(n, 15, np.int8)
    for s in range(14, -1, -1):
        step = COUNTS[s] - COUNTS[s + 1]
        np.maximum(widest[:-step], widest[step:], out=widest[:-step])
        choice[widest[:n] <= WIDTHS[s]] = s
    starts = []
    at = 0
    steps = np.array(COUNTS)[choice].tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = choice[starts]
    big = ids >= np.uint64(ESCAPE)
    escaped = big[starts] & (chosen == 15)
    slot = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for s in range(16):
        rows = np.flatnonzero(chosen == s)
        word = np.full(len(rows), s << 60, np.uint64)
        for j in range(COUNTS[s] if WIDTHS[s] else 0):
            word |= (padded[starts[rows] + j] & np.uint64(ESCAPE)) << np.uint64(j * WIDTHS[s]) if s < 15 else np.where(escaped[rows], np.uint64(ESCAPE), padded[starts[rows]])
        words[slot[rows]] = word
    words[slot[escaped] + 1] = ids[starts[escaped]]
    return words.astype("<u8").tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    """The first ``n`` ids of Simple-8b words."""
    words = np.frombuffer(data, "<u8")
    selectors = (words >> np.uint64(60)).astype(np.int8)
    is_escape = words == np.uint64((15 << 60) | ESCAPE)
    raw = np.zeros(len(words), bool)
    if is_escape.any():  # the word after an escape is an id, even if it looks like an escape
        at = 0
        marks = np.flatnonzero(is_escape).tolist()
        for mark in marks:
            if mark >= at:
                raw[mark + 1] = True
                at = mark + 2
    live = np.flatnonzero(~raw)
    counts = np.array(COUNTS)[selectors[live]]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(selectors[live] == s)
        if len(rows):
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for j in range(COUNTS[s]):
                out[starts[rows] + j] = (words[live[rows]] >> np.uint64(j * WIDTHS[s])) & mask
    jump = np.flatnonzero(is_escape & ~raw)
    out[starts[np.searchsorted(live, jump)]] = words[jump + 1] if len(jump) else 0
    return out[:n]


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Ids that cut ``docs`` into so many ranges of about equally many rows."""
    if shards < 2:
        return []
    cuts = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, min(10 * shards, 100_000))).first()[0]
    return sorted(set(found or []))


def encode_documents(docs: DataFrame, tokenizer: str, pattern: str, bounds: list[int], end_id: int = 0) -> DataFrame:
    """``shard, doc_id, n_tokens, ids``: each text's ids and ``end_id``, in 2 or 4 bytes each."""
    prepare(docs.sparkSession)
    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache, kind = json_id_cache(tokenizer, pattern)
        look_up, width, end = cache.__getitem__, np.dtype(kind).itemsize, np.array([end_id], kind).tobytes()
        for batch in batches:
            shards = np.searchsorted(cuts, batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            for first, group in slices(batch.column(1)):
                packed = [b"".join([b"".join(map(look_up, split(part))) for part in chunks(text)] + [end]) for text in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[first : first + len(group)], pa.int32()), batch.column(0).slice(first, len(group)), pa.array([len(x) // width for x in packed], pa.int64()), pa.array(packed, pa.binary())],
                    names=["shard", "doc_id", "n_tokens", "ids"],
                )

    return docs.mapInArrow(run, "shard int, doc_id long, n_tokens long, ids binary")


def write_shards(encoded: DataFrame, shards: int, path: str | None = None) -> DataFrame:
    """Write the file format in ascending ``doc_id`` order and return the files as a table.

    ``path`` is a new folder that all machines share; without one the files go to the folder for
    intermediate tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, total = None, 0, 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], "<u4").tobytes()
            row = {"shard": shard, "block": block, "n_ids": total, "doc_ids": keys, "lengths": lengths, "words": encode(np.concatenate(ids))}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for own, key, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (own != shard or total + n > BLOCK_IDS):
                    yield flush()
                    block, total, ids, keys = block + 1, 0, [], []
                if own != shard:
                    shard, block = own, 0
                ids.append(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4"))
                keys.append(key)
                total += n
        if keys:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary())])
    ordered = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", F.xxhash64("ids"))
    return materialize(ordered.mapInArrow(run, "shard int, block int, n_ids long, doc_ids array<bigint>, lengths binary, words binary"), "simple8b", path)


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files.

    ``start`` counts the ids of all documents before; blocks' starts come from one running sum
    over shards and one over the blocks of each shard.
    """
    prepare(shards.sparkSession)
    blocks = shards.select("shard", "block", "n_ids")
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # One row per shard.
    before = per_shard.withColumn("shard_start", F.coalesce(F.sum("ids").over(Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("inside", within).join(before, "shard").select("shard", "block", (F.col("inside") + F.col("shard_start")).alias("block_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                ids = memoryview(decode(row["words"], int(row["n_ids"])).astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    decoded = shards.mapInArrow(run, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def shard_count(docs: DataFrame) -> int:
    """Shards for ``docs``: the session's shuffle partitions, more where files are larger than so many shards take."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = 0 if size >= 1 << 60 else size // SHARD_BYTES  # beyond that, Spark doesn't know
    return min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size), MOST_SHARDS)


def token_files(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Encode all texts, write the files (to ``path``), read them back: one row per document.

    Null and empty texts have the end id alone.  A null ``doc_id`` comes first; documents of equal
    id stand together, in an order fixed by their ids.  Other columns are not read.
    """
    bounds = shard_bounds(docs, shard_count(docs))
    return read_shards(write_shards(encode_documents(docs, tokenizer, pattern, bounds, end_id), len(bounds) + 1, path))
