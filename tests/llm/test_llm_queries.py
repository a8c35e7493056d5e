"""The registered queries of the ten operators, on the smallest tables, against SQL or plain code."""

import hashlib
import math
import re
from pathlib import Path

import duckdb
import pytest

from gristmill.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, views, name):
    rows = queries.QUERIES[name](spark, str(DATA))
    found = views.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(rows.columns)
    assert sorted(map(repr, (tuple(r) for r in rows.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    """The contract's patterns, one by one, as they are written."""
    yield from (("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            yield "ip", m
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            yield "phone", m


def test_pii_rows_equal_plain_patterns(spark, views):
    texts = dict(views.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = queries.QUERIES["op2_pii"](spark, str(DATA)).collect()
    assert len(rows) == len(texts) and sum(r.n_email for r in rows) > 0
    for r in rows:
        own = list(base_spans(texts[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _ in own) for kind in ("email", "ip", "card", "phone")]
        listed = [f"{kind}:{m.start()}:{m.end()}" for kind, m in own]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(spans)
        kinds = ["email", "ip", "card", "phone", "iban", "ssn"]
        places = [(kinds.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert places == sorted(places)


def test_quality_holds_out_and_separates(spark, views):
    rows = queries.QUERIES["op6_quality"](spark, str(DATA)).collect()
    truth = dict(views.execute("SELECT doc_id, max(quality) FROM labels GROUP BY doc_id").fetchall())
    assert len(rows) == views.execute("SELECT count(*) FROM documents").fetchone()[0] and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) > 0.8 * len(held)


def test_token_columns_agree_between_queries(spark):
    counts = {r.doc_id: r.n_tokens for r in queries.QUERIES["op5_token_counts"](spark, str(DATA)).collect()}
    files = {r.doc_id: r for r in queries.QUERIES["op3_simple8b_files"](spark, str(DATA)).collect()}
    ranks = {r.doc_id: r.n_tokens for r in queries.QUERIES["op8_bpe_round_trip"](spark, str(DATA)).collect()}
    assert {d: n + 1 for d, n in counts.items()} == {d: r.n_tokens for d, r in files.items()}
    start = 0
    for doc_id in sorted(files):
        assert files[doc_id].start == start
        start += files[doc_id].n_tokens
    # Special strings aside, both files hold one vocabulary.
    assert sum(ranks[d] != n for d, n in counts.items()) <= len(counts) // 100
