import math

import numpy as np

from gristmill.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        hits = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(a))
        out |= {(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(hits[:k])}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(i, [((i * 7 + j * 13) % 11 - 5) / 10.0 for j in range(3)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (104, [1.0])]
    rows += [(200, [0.5, 0.5, 0.5])] * 9 + [(200, [0.1, -0.5, 0.5]), (201, [0.5, 0.5, 0.5]), (202, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string").repartition(5)
    for block_bytes in (32 << 20, 100):
        monkeypatch.setattr(topk, "BLOCK_BYTES", block_bytes)
        assert {tuple(r) for r in topk.top_k(df, k=4, every=10).collect()} == brute(rows, 4, 10)


def test_lists_equal_a_sort(monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 5)
    rnd = np.random.default_rng(3)
    own, queries = rnd.integers(0, 40, 12), rnd.integers(-3, 4, (12, 2)).astype(float)
    lists = topk.TopLists(own, queries, 4)
    every: list[tuple[int, np.ndarray]] = []
    for size in (1, 3, 30, 2, 17):
        ids, tile = rnd.integers(0, 40, size), rnd.integers(-3, 4, (size, 2)).astype(float)
        every += zip(ids.tolist(), tile, strict=True)
        lists.add(ids, tile)
    for i, q in enumerate(queries):
        want = sorted((-int(q @ v), n) for n, v in every if n != own[i])[:4]
        assert list(zip((-lists.scores[i]).tolist(), lists.ids[i].tolist(), strict=True)) == want


def test_large_components_and_empty_tables(spark):
    rows = [(0, [2.0**18, 1.0]), (1, [2.0**18, -1.0]), (2, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, k=2, every=3).collect()} == brute(rows, 2, 3)
    assert topk.top_k(df.limit(0), k=2, every=3).count() == 0
    # Products beyond 2**53, beyond a long, and beyond any double's whole numbers.
    rows = [(i, [s * x] * 4) for i, (s, x) in enumerate((s, x) for x in (1.0, 9e4, 5e5, 3e7, 1e30) for s in (1, -1, 0.7))] + [(20, [1e308] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [r for r in rows if r[0] != 20]
    assert {tuple(r) for r in topk.top_k(df, k=30, every=1).collect()} == brute_clamped(kept, 1)


def brute_clamped(rows, every):
    """All candidates, by scores that are cut to a long before they are compared."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    clamp = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    out = set()
    for q, a in whole:
        if q % every == 0:
            hits = sorted((-clamp(sum(x * y for x, y in zip(a, v, strict=True))), i) for i, v in whole if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)}
    return out
