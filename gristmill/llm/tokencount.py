"""Token counts without a shuffle of pre-tokens.

A compact hash table of frequent pre-tokens and their token counts, built from a bounded sample of
rows, is broadcast.  Tasks look pre-tokens up there first; a miss goes to a cache in the Python
worker that outlasts the task, and only a miss in both is encoded.  The table and the caches change
the speed only: every pre-token of every text is counted exactly as the library encodes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import prepare, slices, texts
from gristmill.llm.encoders import json_encoder
from gristmill.llm.segments import WordCache, chunks

#: Rows sampled (about) for the table of frequent pre-tokens, and the most entries it can have, each
#: of 24 characters at most.
SAMPLE_ROWS, TABLE_ENTRIES = 2_000, 32_768


def frequent_words(docs: DataFrame, tokenizer: str, pattern: str, rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent pre-tokens of about ``rows`` rows, chosen by a hash of their ids.

    Tasks count before anything moves.  Rows of a null or equal id are chosen alike.
    """
    total = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        split, counts = json_encoder(tokenizer, pattern).split, Counter()
        for batch in batches:
            for _, group in slices(batch.column(0)):
                for text in group:
                    for part in chunks(text):
                        counts.update(w for w in split(part) if type(w) is str and len(w) <= 24)
            if len(counts) > 4 * entries:
                counts = Counter(dict(counts.most_common(2 * entries)))
        top = [(k, n) for k, n in counts.most_common(2 * entries) if n > 1]
        yield pa.RecordBatch.from_pydict({"word": [k for k, _ in top], "n": pa.array([n for _, n in top], pa.int64())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(total, 1))) < rows).select("text").mapInArrow(count, "word string, n long")
    top = sample.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)
    return [r.word for r in top.collect()]


@lru_cache(maxsize=1)
def _worker_cache(path: str, pattern: str, stamp: str) -> WordCache:
    encoder = json_encoder(path, pattern)
    return WordCache(lambda word: len(encoder.ids(word)))


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a byte-level BPE ``.json`` file, the same on every machine, and
    ``pattern`` its pre-token pattern.  Null and empty texts have no bytes and no tokens; a null
    ``doc_id`` stays; repeated rows each count; other columns are not read.
    """
    prepare(docs.sparkSession)
    docs = texts(docs)
    encoder = json_encoder(tokenizer, pattern)
    stamp = uuid.uuid4().hex
    table = docs.sparkSession.sparkContext.broadcast({w: len(encoder.ids(w)) for w in frequent_words(docs, tokenizer, pattern)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, split = _worker_cache(tokenizer, pattern, stamp), json_encoder(tokenizer, pattern).split
        if not cache.frequent:
            cache.frequent = table.value
            cache.update(table.value)
        look_up = cache.__getitem__
        for batch in batches:
            for first, group in slices(batch.column(1)):
                n = [sum(sum(map(look_up, split(part))) for part in chunks(text)) for text in group]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)), pa.array([len(t.encode()) for t in group], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
