"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Four base kinds (email, ip, card, phone) are always reported.  The method adds two kinds whose
patterns alone would be too weak: ``iban``, confirmed by mod-97, and ``ssn``, which has no
checksum and so needs a context word nearby to reach the threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import prepare, texts

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits can only begin a match at its first digit, so these look at no other start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_RUN = re.compile(r"(?:[ ]?[A-Z0-9]){15,34}")
_ALNUM = re.compile(r"[A-Za-z0-9]")
#: Whole runs of groups, for countries without a known length.
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
#: Characters of an account number by country.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
        26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Score of a span by its pattern alone, what a passed checksum adds, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
CHECKSUM, CONTEXT, REACH, THRESHOLD = 0.5, 0.25, 48, 0.5
#: In English, French, German and Spanish.
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write to", "courriel", "kontakt", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse", "serveur", "dirección", "servidor"),
    "card": ("card", "visa", "credit", "payment", "carte", "paiement", "karte", "kreditkarte", "zahlung", "tarjeta", "pago"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "téléphone", "appelez", "telefon", "handy", "anruf", "teléfono", "móvil", "llame"),
    "iban": ("iban", "account", "bank", "transfer", "compte", "banque", "virement", "konto", "überweisung", "cuenta", "banco", "transferencia"),
    "ssn": ("ssn", "social security", "taxpayer", "sécurité sociale", "sozialversicherung", "seguridad social"),
}
_NEAR = {kind: re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE) for kind, words in CONTEXT_WORDS.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From each @ back over its local part and on over its domain: the same matches as a scan
    # from every start, in time linear in the text.
    bound, at = 0, text.find("@")
    while at >= 0:
        before = text[bound:at]
        start = bound + len(before.rstrip(_LOCAL))
        bound = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            bound = domain.end()
        at = text.find("@", bound)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    # Of a run of groups, which may go on into other words, the account number is what has the
    # length of its country.
    at = 0
    while (head := _IBAN_START.search(text, at)) is not None:
        start = at = head.start()
        at += 1
        run, length = _IBAN_RUN.match(text, start), IBAN_LENGTH.get(head[0][:2])
        if run and length and (end := _group_end(text, start, run.end(), length)) and mod97(text[start:end].replace(" ", "")):
            yield start, end
            at = end
        elif (whole := _IBAN.match(text, start)) and 15 <= len(c := whole[0].replace(" ", "")) <= 34 and mod97(c):
            yield start, whole.end()
            at = whole.end()


def _group_end(text: str, start: int, stop: int, length: int) -> int:
    """Where ``length`` characters other than spaces from ``start`` end, if a group ends there; else 0."""
    end = start
    while length and end < stop:
        length -= text[end] != " "
        end += 1
    return 0 if length or _ALNUM.match(text, end) else end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def find_spans(text: str) -> list[Span]:
    """All spans of ``text`` by kind as in ``KINDS``, then start."""
    found = base_spans(text)
    found += [("iban", *span) for span in _ibans(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out = []
    for kind, start, end in found:
        score = PRIOR[kind] + CHECKSUM * (kind in ("card", "iban"))
        near = f"{text[max(0, start - REACH) : start]} \n {text[end : end + REACH]}"
        score = min(1.0, score + CONTEXT * bool(_NEAR[kind].search(near)))
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(kind, start, end, score))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            out += [text[at : span.start], f"[{span.kind.upper()}]"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: counts and places of its personal data.

    ``base_sha256`` hashes the base spans, ``spans`` lists all, ``top_score`` is the highest score
    (0 without spans), ``masked`` the text with every span masked.  Null texts count as empty and
    have no spans; repeated rows each get a row; other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score", "masked")}
            for text in batch.column(1).to_pylist():
                spans = find_spans(text)
                base = [s for s in spans if s.kind in BASE]
                for kind in BASE:
                    rows[f"n_{kind}"].append(sum(s.kind == kind for s in base))
                places = [",".join(f"{s.kind}:{s.start}:{s.end}" for s in group) for group in (base, spans)]
                rows["base_sha256"].append(hashlib.sha256(places[0].encode()).hexdigest())
                rows["spans"].append(places[1])
                rows["top_score"].append(max((s.score for s in spans), default=0.0))
                rows["masked"].append(mask(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[k]) for k, v in rows.items())], names=["doc_id", *rows])

    kinds = {k: pa.int64() for k in ("n_email", "n_ip", "n_card", "n_phone")} | {k: pa.string() for k in ("base_sha256", "spans", "masked")} | {"top_score": pa.float64()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double, masked string")


def mask_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars``, where there is one, brought up to date.

    Null texts stay null, as does their ``n_chars``; every row and all other columns stay.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask(t, find_spans(t)))

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
