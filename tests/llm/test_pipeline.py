import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import minhash, mixing, nbsvm, pii


def write(folder, rnd):
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        text = [rnd.choice(words) for _ in range(rnd.randint(12, 60))]
        bad = i % 6 == 5
        if bad:
            text = [w.upper() + "!!" for w in text]
        if i % 6 == 4:
            text = rows[-1]["text"].split()[:-1] + ["changed"] if len(rows[-1]["text"].split()) > 40 else rows[-1]["text"].split()
        if i % 6 == 0:
            text.append(f"mail me@site{i}.org")
        rows.append({"doc_id": i, "text": " ".join(text), "lang": "en", "source": f"s{i % 3}", "n_chars": len(" ".join(text))})
        labels.append({"doc_id": i, "quality": int(not bad), "toxic": 0})
    rows += [{"doc_id": None, "text": "no id at all", "lang": None, "source": None, "n_chars": None}, {"doc_id": 900, "text": None, "lang": "en", "source": "s1", "n_chars": 0}, rows[0]]
    pq.write_table(pa.Table.from_pylist(rows), folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(labels), folder / "labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    write(tmp_path, random.Random(3))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, before, str(tmp_path))
        seen[name] = (before.collect(), rows := at.collect())
        if name != "tokens":
            assert at.columns == columns
            at = spark.createDataFrame(rows, docs.schema)
    before, after = seen["quality"]
    bad = {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 6 == 5}
    left = {r.doc_id for r in after}
    assert len(bad & left) <= len(bad) // 10 and len({r.doc_id for r in before} - bad - left) <= 4
    before, after = seen["near_duplicates"]
    groups = minhash.groups(spark.createDataFrame(before, docs.schema), 5, 80).collect()
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({g.doc_id for g in groups if g.kept})
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
    before, after = seen["personal_data"]
    assert len(before) == len(after) and not any(pii.find_spans(r.text or "") for r in after)
    assert any("[EMAIL]" in (r.text or "") for r in after) and all(r.n_chars == len(r.text) for r in after if r.text is not None)
    before, after = seen["mixture"]
    size = lambda rows, s: sum(len((r.text or "").split()) for r in rows if r.source == s)
    taken = {s: size(after, s) for s in ("s0", "s1", "s2")}
    assert taken["s0"] < taken["s1"] < taken["s2"] and all(taken[s] <= 3 * size(before, s) for s in taken)
    before, after = seen["tokens"]
    assert sorted((r.doc_id or -1) for r in before) == sorted((r.doc_id or -1) for r in after)


def test_run_equals_the_stages(spark, tmp_path):
    write(tmp_path, random.Random(4))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        at = spark.read.parquet(f"{tmp_path}/{n}")
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [tuple(r)[2:] for r in got] == [tuple(r)[2:] for r in sorted(at.collect())]
    # Rows stand in the order in which the mixture was written.
    plan = mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()
    first = {r.doc_id: r.position for r in plan}
    seen = list(dict.fromkeys(r.doc_id for r in got if r.doc_id is not None))
    assert seen == sorted(seen, key=lambda d: first[d])


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    write(tmp_path, random.Random(5))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    extra = {name: F.lit("kept") for name in ("place", "mix_row", "mix_content", "mix_position", "size", "score", "cls", "part", "ids", "n_tokens", "label", "key", "node")}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, str(tmp_path))
        wide = stage(spark, docs.withColumns(extra), str(tmp_path))
        if name != "tokens":
            assert wide.columns == [*docs.columns, *extra] and {tuple(r) for r in wide.select(*extra).collect()} <= {("kept",) * len(extra)}
        assert rows.count() == wide.count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        void = docs.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
        assert stage(spark, void, str(tmp_path)).count() <= 3


def test_the_last_stage_gives_token_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, ""), (None, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert len(rows) == 3 and all(len(r.ids) == r.n_tokens for r in rows.values()) and rows[1].ids and not rows[2].ids
    assert all(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in rows.values())


def test_keep_only_filters(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "a b", "y")], "doc_id long, text string, score string")
    model = nbsvm.fit([], __import__("numpy").zeros(0, int))
    assert nbsvm.keep(docs, model, 0.4).collect() == docs.collect() and nbsvm.keep(docs, model, 0.6).count() == 0
