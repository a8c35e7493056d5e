import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import simple8b

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@given(st.lists(st.one_of(st.just(0), st.integers(0, 2**64 - 1), st.integers(0, 50_000), st.sampled_from([2**60 - 2, 2**60 - 1, 2**60, 2**64 - 1])), max_size=300))
def test_round_trip(ids):
    got = simple8b.decode(simple8b.encode(np.array(ids, np.uint64)), len(ids))
    assert got.tolist() == ids


def test_runs_pack_tightly():
    assert len(simple8b.encode(np.zeros(240, np.uint64))) == 8
    assert len(simple8b.encode(np.full(60, 1, np.uint64))) == 8
    assert len(simple8b.encode(np.full(2, 2**30 - 1, np.uint64))) == 8


def test_files_hold_every_id_in_order(spark, monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_IDS", 64)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta,", "é\n", "<|endoftext|>", "77"]) for _ in range(rnd.randint(0, 60))), "x") for i in rnd.sample(range(-500, 500), 150)]
    rows += [(700, None, "x"), (None, "nobody", "x"), (701, "", "x"), (702, "long " * 20_000, "x"), (5000, "same", "x"), (5000, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(6)
    whole, start, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in simple8b.token_files(docs, PATH, PATTERN).collect()), key=lambda r: r[1])
    assert got == want
    assert simple8b.token_files(docs.limit(0), PATH, PATTERN).count() == 0
