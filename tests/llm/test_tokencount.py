import random

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from gristmill.llm import tokencount
from gristmill.llm.segments import Splitter, WordCache, chunks

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


ALPHABET = "ab1 \n\t!'s\x1c  é　²½\x85\xa0Ǆ_中\u0301ßLl"


def test_pre_tokens_equal_the_pattern():
    slow, own, rnd = regex.compile(PATTERN).findall, Splitter(PATTERN), random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14)))
        assert own(text) == slow(text)
        assert [w for part in chunks(text, 1) for w in own(part)] == slow(text)
    every = "".join(map(chr, range(0x250)))
    assert own(every) == slow(every) and own(" ".join(every)) == slow(" ".join(every))


def test_raw_stretches_cover_the_text():
    own, rnd = Splitter(PATTERN, raw=True, special=("<|endoftext|>",)), random.Random(6)
    for _ in range(5_000):
        text = "".join(rnd.choice([*ALPHABET, "<|endoftext|>"]) for _ in range(rnd.randint(0, 14)))
        assert "".join(w if isinstance(w, str) else w[0] for w in own(text)) == text
        assert not any("<|" in w for w in own(text) if isinstance(w, str))


def test_cache_forgets_but_never_errs():
    cache = WordCache(len, {"the": 3}, half=5, long=6)
    words = [w for i in range(200) for w in ("the", "x" * (i % 9 + 1), f"w{i % 13}")]
    assert list(map(cache.__getitem__, words)) == list(map(len, words))
    assert len(cache) <= 6 and "x" * 9 not in cache


def test_no_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from gristmill.llm import common

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_root(session)


def test_counts_equal_the_library(spark):
    texts = [None, "", " ", "a", "Hello  world\n\n again,\tand <|endoftext|> again<|endoftext|>", "x" * 5000, "né 中文 ɐb 12", "it's 'll 5's  ", "word " * 20_000]
    docs = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)] + [(3, "a", 7)], "doc_id long, text string, n_tokens int")
    whole = Tokenizer.from_file(PATH)
    rows = tokencount.count_tokens(docs, PATH, PATTERN).collect()
    want = sorted((len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 512) for t in [*texts, "a"])
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert tokencount.count_tokens(docs.limit(0), PATH, PATTERN).count() == 0
