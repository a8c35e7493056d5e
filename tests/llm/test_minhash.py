import random
import re

import numpy as np
import pytest

from gristmill.llm import minhash


def brute(rows, width, percent):
    sets = []
    for _, text, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    ids = [r[0] for r in rows]
    near = {i: {i} for i in ids if i is not None}
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if ids[a] is not None and ids[b] is not None and common and 100 * common >= percent * len(sets[a] | sets[b]):
                near[ids[a]].add(ids[b])
                near[ids[b]].add(ids[a])
    reach = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        reach[i] = min(seen)
    return sorted(((i, len(s), reach.get(i), i is not None and reach[i] == i) for i, s in zip(ids, sets, strict=True)), key=str)


SCHEMA = "doc_id long, text string, component_id string"


def corpus(rnd):
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 4) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.choice([1, 1, 2, 6, 14])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(["X", "yy", "é"])
            rows.append((n, rnd.choice([" ", "\n", "  "]).join(words), "z"))
            n += 1
    rows += [(5000, None, "z"), (5001, "", "z"), (5002, " \t", "z"), (5003, "", "z"), (None, rows[0][1], "z"), (None, "", "z"), (5004, "One two", "z"), (5005, "one TWO", "z")]
    rows += [(5006, rows[3][1], "z"), (5006, rows[40][1], "z"), (5006, rows[40][1], "z"), (5007, "very long " * 30_000 + "end", "z"), (5008, "very long " * 29_000 + "end", "z")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,tile", [(4, 256), (5, 4)])
def test_groups_equal_brute_force(spark, monkeypatch, width, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = corpus(random.Random(width))
    got = minhash.groups(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width, percent=80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, width, 80)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}


def test_posterior_bounds_and_signatures():
    least = minhash.least_matches(0.8, 1e-5)
    assert list(least) == sorted(least) and least[-1] < 0.8 * minhash.HASHES
    rnd = np.random.default_rng(1)
    both = rnd.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = both[:800], both[100:]  # similarity 700 / 900
    shares = [(minhash.signature(a + np.uint64(i)) == minhash.signature(b + np.uint64(i))).mean() for i in range(30)]
    assert np.mean(shares) == pytest.approx(7 / 9, abs=0.03)


def test_empty_table(spark):
    assert minhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_just_over_the_threshold_are_found(spark):
    rnd, rows = random.Random(11), []
    for pair in range(400):
        words = [f"w{pair}x{rnd.randrange(10**6)}" for _ in range(rnd.randint(60, 90))]
        other = list(words)
        n = len(words) - 3  # shingles of four words; a changed end changes as many as it is long
        most = next(c for c in range(n, -1, -1) if 100 * (n - c) >= 80 * (n + c))
        for i in range(1, most + 1):
            other[-i] = f"v{pair}x{i}"
        rows += [(2 * pair, " ".join(words), "z"), (2 * pair + 1, " ".join(other), "z")]
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, SCHEMA), width=4, percent=80).collect()}
    found = sum(got[2 * p + 1] == 2 * p for p in range(400))
    assert found >= 399 and len(set(got.values())) == 800 - found


def test_classes_are_told_apart_by_both_halves(spark, monkeypatch):
    # Digests that agree in their first half: still two classes.
    halves = minhash._halves
    monkeypatch.setattr(minhash, "_halves", lambda digest: (5, halves(digest)[1]))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "z") for i in range(6)] + [(6, " ".join(f"w0x{j}" for j in range(20)), "z")]
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, SCHEMA), width=4).collect()}
    assert got == {i: i for i in range(6)} | {6: 0}
