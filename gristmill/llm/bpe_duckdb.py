"""Byte-level BPE by recursive queries.

Every Python worker has a DuckDB database with the merge table (each way of composing a token of
two others, with the token's rank) and the vocabulary.  Encoding puts a batch of distinct words
into a table of token-position rows; a recursive query joins neighbours with the merge table and
contracts the leftmost pair of least rank in each word until none is left.  Decoding joins ids
with the vocabulary and aggregates in order of position.

Two things keep the rounds few, and neither changes a result:

* A round contracts every occurrence of a word's least rank, where no pair that arises beside one
  has a lower rank, so that the occurrences would come next in any case.
* A long word goes in as overlapping windows.  Two neighbouring tokens of an encoding are the
  encoding of their own bytes, and tokens whose neighbours all are so form the encoding of the
  whole; so two windows with a token in common are joined at it.  Windows without one are widened,
  up to the whole word.

Bytes travel through DuckDB as Latin-1 letters, one for each byte.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import prepare, slices, texts
from gristmill.llm.encoders import read_ranks
from gristmill.llm.segments import Splitter, WordCache, chunks

#: Bytes of words in one recursive query, characters of text whose words are looked up together,
#: and ids in one decoding query.
QUERY_BYTES, GROUP, SLICE = 400_000, 2_000_000, 500_000
#: Bytes in a window of a long word, and how many of them the next window shares.
WINDOW, SHARED = 48, 20
#: A row's place is ``word << _POS_BITS | position``.
_POS_BITS = 32

ENCODE = f"""
    WITH RECURSIVE tokens(place, id, done) AS (
        SELECT place, id, FALSE FROM start
        UNION ALL
        (WITH near AS (
            SELECT place, place >> {_POS_BITS} AS word, id, lead(id) OVER places AS after, lead(place) OVER places AS right_place, row_number() OVER places AS n
            FROM tokens WHERE NOT done WINDOW places AS (ORDER BY place)),
        pairs AS (
            SELECT near.*, rank
            FROM near LEFT JOIN merges ON parts = CASE WHEN right_place >> {_POS_BITS} = word THEN (CAST(id AS BIGINT) << 32) + after END),
        best AS (SELECT word, min(rank) AS rank, min((CAST(rank AS BIGINT) << {_POS_BITS}) + (place & {(1 << _POS_BITS) - 1})) AS key FROM pairs GROUP BY word),
        hits AS (
            SELECT p.place, p.right_place, p.word, p.n, p.rank, (b.key & {(1 << _POS_BITS) - 1}) = (p.place & {(1 << _POS_BITS) - 1}) AS leftmost
            FROM pairs p JOIN best b ON p.word = b.word AND p.rank = b.rank),
        several AS (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS k
            FROM hits WHERE word IN (SELECT word FROM hits WHERE NOT leftmost)),
        around AS (
            SELECT s.*, EXISTS (SELECT 1 FROM hasty h WHERE h.rank = s.rank AND (h.before = l.id OR h.beyond = r.id OR h.twice)) AS alone
            FROM several s LEFT JOIN near l ON l.n = s.n - 1 AND l.word = s.word LEFT JOIN near r ON r.n = s.n + 2 AND r.word = s.word),
        chosen AS (
            SELECT place, right_place, rank FROM hits WHERE leftmost
            UNION ALL
            SELECT place, right_place, rank FROM (
                SELECT *, row_number() OVER (PARTITION BY word, n - k ORDER BY place) AS in_run, bool_or(alone) OVER (PARTITION BY word) AS one
                FROM around)
            WHERE NOT leftmost AND in_run % 2 = 1 AND NOT one)
        SELECT p.place, coalesce(c.rank, p.id), b.rank IS NULL
        FROM pairs p JOIN best b ON p.word = b.word LEFT JOIN chosen c ON c.place = p.place
        WHERE p.place NOT IN (SELECT right_place FROM chosen)))
    SELECT list(id ORDER BY place) AS ids FROM tokens WHERE done
    GROUP BY place >> {_POS_BITS} ORDER BY place >> {_POS_BITS}"""

#: With one thread, rows reach the aggregate in the order of the subquery.
DECODE = """
    SELECT doc, string_agg(piece, '') AS bytes
    FROM (SELECT doc, pos, piece FROM stream JOIN vocabulary USING (id) ORDER BY pos)
    GROUP BY doc ORDER BY doc"""


class Coder:
    """Encoder and decoder of one rank file, with its database."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.split = Splitter(pattern)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = ''")
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(pairs, np.int32).reshape(-1, 3).T
        self._table("merges", pa.table({"parts": (left.astype(np.int64) << 32) + right, "rank": rank}))
        # A token that stands as a part of one with a lower rank, and what must stand beside it.
        hasty = [(a, None, b, a == b) for a, b, r in pairs if r < a] + [(b, a, None, False) for a, b, r in pairs if r < b]
        kinds = [("rank", pa.int32()), ("before", pa.int32()), ("beyond", pa.int32()), ("twice", pa.bool_())]
        self._table("hasty", pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*hasty, strict=True) if hasty else [[]] * 4, kinds, strict=True)], names=[n for n, _ in kinds]))
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]}))
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.names = [str(i) for i in range(len(self.sizes))]
        self.cache = WordCache(lambda word: self.encode_words([word])[0])

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contract(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of some words, in queries of about ``QUERY_BYTES`` bytes."""
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= QUERY_BYTES):
                size += len(words[end])
                end += 1
            lengths = np.array([len(w) for w in words[at:end]], np.int64)
            places = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.db.register("start", pa.table({"place": (np.repeat(np.arange(end - at), lengths) << _POS_BITS) + places, "id": self.of_byte[np.frombuffer(b"".join(words[at:end]), np.uint8)]}))
            lists = self.db.sql(ENCODE).to_arrow_table().column(0)
            self.db.unregister("start")
            yield from lists.to_pylist()
            at = end

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed 32-bit ids of distinct non-empty words."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raw)
        waiting, width = list(range(len(raw))), WINDOW
        while waiting:
            windows = [[raw[i]] if len(raw[i]) <= width else [raw[i][at : at + width] for at in range(0, len(raw[i]) - SHARED, width - SHARED)] for i in waiting]
            found = self.contract([w for ws in windows for w in ws])
            again = []
            for i, own in zip(waiting, windows, strict=True):
                ids = self.joined([next(found) for _ in own], width - SHARED)
                if ids is None:
                    again.append(i)
                else:
                    out[i] = array("I", ids).tobytes()
            waiting, width = again, width * 8
        return out

    def joined(self, windows: list[list[int]], step: int) -> list[int] | None:
        """One list of ids from those of windows that begin ``step`` bytes apart; None if two have no token in common."""
        ids = windows[0]
        ends = np.cumsum(self.sizes[ids]).tolist() if len(windows) > 1 else []
        for n, more in enumerate(windows[1:], 1):
            # Tokens of both have the same id and end.
            own = np.cumsum(self.sizes[more]) + n * step
            place = {end: i for i, end in enumerate(own.tolist())}
            for back in range(len(ids) - 1, -1, -1):
                at = place.get(ends[back])
                if at is not None and more[at] == ids[back]:
                    ids = ids[: back + 1] + more[at + 1 :] if n == 1 else self._extend(ids, back, more[at + 1 :])
                    ends = self._extend(ends, back, own[at + 1 :].tolist())
                    break
                if ends[back] <= n * step:
                    return None
            else:
                return None
        return ids

    @staticmethod
    def _extend(items: list[int], last: int, more: list[int]) -> list[int]:
        del items[last + 1 :]
        items += more
        return items

    def encode(self, group: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[bytes]] = [[] for _ in group]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(group):
            for part in chunks(text):
                waiting.append((i, self.split(part)))
                size += len(part)
                if size >= GROUP:
                    self._look_up(waiting, out)
                    waiting, size = [], 0
        self._look_up(waiting, out)
        return [np.frombuffer(b"".join(x), "<u4") for x in out]

    def _look_up(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        cache = self.cache
        new: set[str] = set()
        for _, words in waiting:
            new.update(words)
        new = {w for w in new if w not in cache}
        missing = [w for w in new if w not in cache.old]
        # At most one change of generations follows, since a group has fewer words than a generation.
        for word, ids in [(w, cache.old[w]) for w in new if w in cache.old]:
            cache.keep(word, ids)
        rare = {}
        for word, ids in zip(missing, self.encode_words(missing), strict=True):
            if len(word) > cache.long:
                rare[word] = ids
            else:
                cache.keep(word, ids)
        for i, words in waiting:
            out[i].append(b"".join([rare[w] if w in rare else cache[w] for w in words] if rare else map(cache.__getitem__, words)))

    def decode(self, group: list[np.ndarray]) -> list[bytes]:
        """Bytes that each list of ids stands for."""
        ends = np.cumsum([len(x) for x in group])
        out: list[list[str]] = [[] for _ in group]
        flat = np.concatenate([*group, np.zeros(0, "<u4")])
        for at in range(0, len(flat), SLICE):
            part = flat[at : at + SLICE].astype(np.int32)
            places = np.arange(at, at + len(part))
            self.db.register("stream", pa.table({"doc": np.searchsorted(ends, places, "right").astype(np.int32), "pos": places, "id": part}))
            for doc, piece in zip(*(c.to_pylist() for c in self.db.sql(DECODE).to_arrow_table().columns), strict=True):
                out[doc].append(piece)
            self.db.unregister("stream")
        return ["".join(x).encode("latin-1") for x in out]

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the ids in decimal, with one space between two."""
        found = hashlib.sha256()
        for at in range(0, len(ids), SLICE):
            found.update((" " * (at > 0) + " ".join(map(self.names.__getitem__, ids[at : at + SLICE].tolist()))).encode())
        return found.hexdigest()


@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``ids`` if asked.

    ``ranks`` is the path of a rank file, the same on every machine.  Special strings are ordinary
    text.  Null and empty texts have no ids; repeated rows each get a row; of other columns only
    those in ``keep`` are read, and come along.  Memory is bounded by one text's ids.
    """
    prepare(docs.sparkSession)
    docs = texts(docs, *keep)
    names = [*keep, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for batch in batches:
            for first, group in slices(batch.column("text")):
                ids = own.encode(group)
                decoded = own.decode(ids)
                part = batch.slice(first, len(group))
                columns = [
                    *(part.column(c) for c in (*keep, "doc_id")),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([own.digest(x) for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, "doc_id")) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(run, schema + ", ids array<int>" * with_ids)
