import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import pii

DOCS = "doc_id long, text string, spans string"


def brute(text):
    """The base patterns as stated, scanned from every start."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a0127.@-+ ()é"), max_size=40))
def test_base_spans_equal_a_plain_scan(text):
    assert pii.base_spans(text) == brute(text)


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    text = "Pay to IBAN GB82 WEST 1234 5698 7654 32 or not GB83 WEST 1234 5698 7654 32; ssn 123-45-6789"
    kinds = [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text) if s.kind in ("iban", "ssn")]
    assert kinds == [("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert not [s for s in pii.find_spans("part 123-45-6789 in stock") if s.kind == "ssn"]
    assert pii.mask("mail a@b.cc now", pii.find_spans("mail a@b.cc now")) == "mail [EMAIL] now"


def test_ibans_of_any_grouping_and_before_other_words():
    def ibans(text):
        return [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"]

    for iban in ("CH93 0076 2011 6238 5295 7", "HR12 1001 0051 8630 0016 0", "LV80 BANK 0000 4351 9500 1", "LI21 0881 0000 2324 013A A", "NO93 8601 1117 947", "BE68 5390 0754 7034", "DE89370400440532013000", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for before, after in (("", ""), ("to ", "."), ("AB12 ", " EUR 500"), ("IBAN ", " BIC ABNANL2A"), ("DE89 ", " 7"), ("", " or " + iban)):
            text = before + iban + after
            assert ibans(text) == [iban] * text.count(iban), text
        assert ibans(iban.replace(" ", "")) == [iban.replace(" ", "")]
        assert not ibans(iban[:4] + iban[4:].translate(str.maketrans("01", "10"))) and not ibans(iban + "0")
    text = "Pay NL91 ABNA 0417 1643 00 BIC ABNANL2A"
    assert pii.mask(text, pii.find_spans(text)) == "Pay [IBAN] BIC ABNANL2A"
    # Of a country without a known length, the whole run counts.
    assert ibans("to XX57 WEST 1234 5698 7654 32.") == ["XX57 WEST 1234 5698 7654 32"]


def test_nulls_empty_and_repeated_rows(spark):
    long = "word " * 50_000 + "x@y.zz"
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, long, "c"), (2, long, "c")], DOCS)
    rows = pii.detect(docs).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in rows) == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert {r.base_sha256 for r in rows if r.doc_id != 2} == {hashlib.sha256(b"").hexdigest()}
    assert pii.detect(docs.limit(0)).count() == 0
