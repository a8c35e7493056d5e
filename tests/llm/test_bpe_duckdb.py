import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from gristmill.llm import bpe_duckdb
from gristmill.llm.encoders import read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_words_of_any_length_merge_alike():
    own, whole, rnd = bpe_duckdb.coder(PATH, PATTERN), library(), random.Random(4)
    words = {"".join(rnd.choice("aehinorst") for _ in range(rnd.randint(1, 400))) for _ in range(300)} | {"a" * 50, "ab" * 40, "\x00\x01é\xff", "=" * 5000, "x" * 5001, "aaab" * 700, "-=" * 999, "lo" * 3000, "0" * 777}
    words |= {"".join(rnd.choice(("a", "aa", "b", "in", "ing", "ation", "=", "==")) for _ in range(rnd.randint(1, 80))) for _ in range(300)}
    words = sorted(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_words(words)] == [whole._core_bpe.encode_single_piece(w.encode()) for w in words]


def test_long_texts_decode_in_slices(monkeypatch):
    own = bpe_duckdb.coder(PATH, PATTERN)
    monkeypatch.setattr(bpe_duckdb, "SLICE", 1000)
    group = [np.array([220, 262] * n, "<u4") for n in (0, 3, 4000, 0, 1, 700)]
    assert own.decode(group) == [b"  the" * len(x[::2]) for x in group]
    for ids in group:
        assert own.digest(ids) == hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest()


def test_round_trip_equals_the_library(spark):
    texts = [None, "", " ", "Hello  world\n\n again, <|endoftext|>", "x" * 5000, "né 中文 ɐb 12 🙂", "it's 'll 5's  ", "word " * 20_000, "\x00 nul", "a", "a"]
    docs = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    whole, want = library(), []
    for i, text in enumerate(texts):
        ids = whole.encode_ordinary(text or "")
        want.append((i or None, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe_duckdb.encode_and_decode(docs, PATH, PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_duckdb.encode_and_decode(docs.limit(0), PATH, PATTERN).count() == 0
