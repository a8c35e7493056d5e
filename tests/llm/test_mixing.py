import hashlib
import re

import pytest

from gristmill.llm import mixing


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return target


ROWS = [(i, "w " * (1 + i * 7 % 23), None if i % 10 == 9 else f"s{min(i % 10, 5)}", "x") for i in range(400)]
ROWS += [(500, None, "s1", "x"), (None, "a b c", "s0", "x"), (501, "", "empty", "x"), (502, "w " * 30_000, "s4", "x"), (600, "one", "s2", "x"), (600, "one", "s2", "x")]
SCHEMA = "doc_id long, text string, source string, size string"


def test_targets_and_takes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    sizes, ids = {}, {}
    for doc_id, text, source, _ in ROWS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        ids.setdefault(doc_id, source)
    target, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        source = ids[r.doc_id]
        assert r.target == pytest.approx(target[source], rel=1e-9) and r.source_size == sizes[source]
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    positions = [r.position for r in rows if r.position is not None]
    assert positions == sorted(positions)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_order_within_a_source_is_by_hash(spark):
    docs = spark.createDataFrame([(i, "a b c d", "big", "") for i in range(50)] + [(i, "a b", "small", "") for i in range(50, 60)], SCHEMA)
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    by_hash = sorted(range(50), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
    takes = [rows[i].taken for i in by_hash]
    assert takes == sorted(takes, reverse=True)


def test_inverse_demand(spark):
    from pyspark.sql import functions as F

    for tilt in (-0.5, 0.0, 0.5):
        for t in (0.0, 0.25, 1.0):
            amount = 80.0 * (t + tilt * (t * t - t))
            got = spark.range(1).select(mixing.inverse_demand(F.lit(amount), F.lit(80.0), F.lit(tilt)).alias("t")).first().t
            assert got == pytest.approx(t, abs=1e-9)


def test_schedules_decide_shares_and_times(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], "x") for i in range(400)], SCHEMA)
    shares = {}
    for name, schedules in {"even": ((1.0, 1.0),), "rising": ((0.0, 3.0), (0.5, 0.5))}.items():
        rows = mixing.mix(docs, schedules=schedules).collect()
        taken = {s: sum(r.taken for r in rows if "ab"[r.doc_id % 2] == s) for s in "ab"}
        early = {s: sum(10 * sum(t < 0.5 for t in r.positions) for r in rows if "ab"[r.doc_id % 2] == s) for s in "ab"}
        shares[name] = taken["a"] / sum(taken.values()), early["a"] / max(1, taken["a"])
    assert shares["even"] == pytest.approx((0.5, 0.5), abs=0.03)
    assert shares["rising"] == pytest.approx((0.75, 0.25), abs=0.01)
    with pytest.raises(ValueError, match="integral"):
        mixing.mix(docs, schedules=((0.0, 0.0),))


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, "")], SCHEMA)).first().taken == 0


def test_rows_of_null_and_repeated_ids_have_their_own_plans(spark):
    rows = [(None if i % 2 else i % 6, f"w{i} " * (1 + i % 7), f"s{i % 3}", "x") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix(docs).collect()
    want = sorted((r.doc_id or -1, r.size) for r in plan for _ in range(int(r.taken / r.size + 0.5)))
    got = mixing.apply_mix(docs).collect()
    assert sorted((r.doc_id or -1, len(r.text.split())) for r in got) == want and {tuple(r) for r in got} <= set(rows)
