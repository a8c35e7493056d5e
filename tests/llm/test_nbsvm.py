import random
import zlib

import numpy as np
import pytest

from gristmill.llm import nbsvm


def corpus(rnd, n):
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(3, 60))]
        yield i, " ".join(words if good else [w.upper() + "!!" if j % 2 else w for j, w in enumerate(words)]), int(good)


def test_descent_reaches_the_optimum_of_the_hinge_loss():
    rnd = np.random.default_rng(3)
    rows = [np.unique(rnd.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    labels = np.array([int(r.min() < 3) for r in rows])
    ratio = nbsvm._ratio(rows, labels)
    by_hand = {b: np.log((1 + sum(b in r for r, y in zip(rows, labels, strict=True) if y)) / (1 + sum(b in r for r, y in zip(rows, labels, strict=True) if not y))) for b in range(40)}
    shift = {round(float(ratio[b]) - by_hand[b], 4) for b in range(40)}
    assert len(shift) == 1  # the same normalising constant everywhere
    model = nbsvm.Model(*nbsvm._descend(rows, labels), 1.0, 0.0)
    right = [(model.margin(r) > 0) == bool(y) for r, y in zip(rows, labels, strict=True)]
    assert np.mean(right) > 0.95


def test_descent_closes_the_duality_gap():
    rnd = np.random.default_rng(8)
    rows = [np.unique(rnd.integers(0, 60, 9)).astype(np.int32) for _ in range(120)]
    y = np.where([r.min() < 3 or rnd.random() < 0.1 for r in rows], 1.0, -1.0)
    values = [rnd.normal(size=len(r)).astype(np.float32) for r in rows]
    most = rnd.uniform(0.3, 2.0, len(rows))
    w, bias, alpha = nbsvm.dual_descent(rows, values, y, most, passes=400)
    assert ((alpha >= 0) & (alpha <= most + 1e-12)).all()
    x = np.zeros((len(rows), 61))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r], x[i, 60] = v, 1.0
    whole = (alpha * y) @ x  # the weights that the dual variables stand for
    assert np.allclose(whole[:60], w[:60], atol=1e-3) and whole[60] == pytest.approx(bias, abs=1e-6)
    primal = whole @ whole / 2 + (most * np.maximum(0, 1 - y * (x @ whole))).sum()
    dual = alpha.sum() - whole @ whole / 2
    assert 0 <= primal - dual + 1e-6 and primal - dual < 1e-3 * abs(primal)


def test_one_text_for_each_id_and_a_bound_on_grams(spark, monkeypatch):
    rows = list(corpus(random.Random(2), 300))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, rows[3][1])] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    plain = nbsvm.train(docs.where("doc_id <> 3").unionByName(docs.where("doc_id = 3").limit(1)), labels, "quality")
    assert np.allclose(plain.weights, nbsvm.train(docs, labels, "quality").weights)
    seen = []
    monkeypatch.setattr(nbsvm, "fit", lambda rows, labels: seen.append(rows))
    monkeypatch.setattr(nbsvm, "SAMPLE_GRAMS", 2_000)
    nbsvm.train(docs, labels, "quality")
    assert 0 < sum(map(len, seen[0])) <= 2_000


def test_held_out_accuracy(spark):
    rows = list(corpus(random.Random(1), 800))
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in rows] + [(None, None, 0.0), (9000, "", 0.0), (9001, "word " * 50_000, 0.0), (1, rows[1][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y if i % 5 else None) for i, _, y in rows], "doc_id long, quality int")
    got = nbsvm.quality(docs, labels).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else False)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.95
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, nbsvm.quality(docs.repartition(5), labels).collect()), key=str)


def test_no_or_one_sided_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert nbsvm.quality(docs, labels.limit(0)).first().score == pytest.approx(0.5)
    assert nbsvm.quality(docs, labels).first().score > 0.5
    assert nbsvm.quality(docs.limit(0), labels).count() == 0
