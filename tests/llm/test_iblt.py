import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.llm import iblt


def parts(text):
    return {p.strip(" ") for p in re.split(r"\n+|(?<=[.!?])\s+", text, flags=re.ASCII)} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    for i, (doc_id, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(parts(text), parts(edited)), 9), round(jaccard(parts(text), parts(following)), 9)


SCHEMA = "doc_id long, text string, n_chars string, range int"


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE_ROWS", 1)
    rnd = random.Random(6)
    words = ["é", "two", "three four", "🙂", "x"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([". ", "\n", " ", "! "]) for _ in range(rnd.choice([0, 1, 3, 10, 60]))), "", 0) for i in rnd.sample(range(-90, 3000), 40)]
    rows += [(5000, None, "", 0), (None, "nobody. here", "", 0), (5001, "same. text", "", 0), (5001, "same. text", "", 0), (5002, "A long one.\n" * 3 + "".join(f"Line {i}.\n" for i in range(900)), "", 0)]
    got = iblt.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(brute(rows), key=str)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id == 5001, r.fingerprint), r)
    assert len([r for r in got if r.doc_id == 5001 and r.fingerprint == by_text[True, r.fingerprint].fingerprint]) == 2


def test_peeling_recovers_the_differing_digests(spark):
    a = "One.\nTwo.\nThree.\nFour."
    b = "One.\nTwo!\nThree.\nFive.\nSix."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(iblt.digests(F.col("a")).alias("a"), iblt.digests(F.col("b")).alias("b"))
    found = row.select("a", "b", iblt.peel(iblt.subtract(iblt.sketch(F.col("a"), 16), iblt.sketch(F.col("b"), 16)), 16).alias("found")).first()
    assert {p.x for p in found.found if p.n == 1} == set(found.a) - set(found.b)
    assert {p.x for p in found.found if p.n == -1} == set(found.b) - set(found.a)
    crowded = spark.createDataFrame([(" ".join(f"S{i}." for i in range(400)), "x")], "a string, b string")
    crowded = crowded.select(iblt.digests(F.col("a")).alias("a"), iblt.digests(F.col("b")).alias("b"))
    assert crowded.select(iblt.peel(iblt.subtract(iblt.sketch(F.col("a"), 16), iblt.sketch(F.col("b"), 16)), 16).alias("f")).first().f is None


def test_lone_and_no_documents(spark):
    one = iblt.fingerprints(spark.createDataFrame([(1, "a. b. c. d", "", 0)], SCHEMA)).first()
    assert one.near_next == pytest.approx(1.0)
    assert iblt.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_ascend_and_stay_small(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE_ROWS", 20)
    monkeypatch.setattr(iblt, "CUTS", 6)
    rnd = random.Random(9)
    keys = [rnd.randrange(10**6) for _ in range(600)] + [10**15 + rnd.randrange(10**4) for _ in range(300)] + [77] * 500 + [None] * 400 + [-(2**63), 2**63 - 1]
    rows = [(k, hashlib.md5(str(rnd.random()).encode()).hexdigest()) for k in keys]
    got = iblt.with_range(spark.createDataFrame(rows, "key long, tie string")).collect()
    order = sorted(got, key=lambda r: (r.key is None, r.key or 0, r.tie))
    ranges = [r.range for r in order]
    assert len(got) == len(rows) and ranges == sorted(ranges)
    sizes = {r: ranges.count(r) for r in set(ranges)}
    assert max(sizes.values()) <= 100 and len(sizes) >= 40
    for few in ([], [(None, "00" * 16)], [(5, "00" * 16)]):
        assert iblt.with_range(spark.createDataFrame(few, "key long, tie string")).count() == len(few)


def test_fingerprints_equal_brute_force_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE_ROWS", 3)
    monkeypatch.setattr(iblt, "CUTS", 4)
    rnd = random.Random(16)
    rows = [(rnd.choice([7, None, rnd.randrange(-(10**9), 10**9)]), f"text {rnd.randrange(10**6)}. more {i}\nend", "", 0) for i in range(120)] + [(-(2**63), "least id. yes", "", 0)]
    got = iblt.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(brute(rows), key=str)


def test_texts_move_once(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = iblt.with_next(docs)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert {r.doc_id: r.next_text for r in rows.collect()} == {i: f"text {(i - 1) % 300}" for i in range(300)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
