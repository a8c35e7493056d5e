"""Column functions over text: tokens, citations, image URLs, buckets, model replies."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
TOKEN = r"(?U)\w+|[^\w\s]"
BETWEEN_WORDS = r"[^a-z0-9]+"
CITATION = r"\[(\w+)\]"
PHOTO_CITATION = r"\[photo of (\w+)\]"
BRACKET = r"\[[^\]]*\]"
JUDGE_KEYS = ("correctness", "faithfulness", "completeness", "conciseness")


def text_of(c: Column | str) -> Column:
    """Text with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_words(c: Column | str) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def split_sentences(c: Column | str) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def token_len(c: Column | str) -> Column:
    """Words and single other characters; Unicode letters count as word characters."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def search_tokens(c: Column | str) -> Column:
    # What lies between two words is shorter to match than a word.
    return F.array_remove(F.split(F.lower(text_of(c)), BETWEEN_WORDS), "")


def normalize_question(c: Column | str) -> Column:
    return F.lower(F.array_join(split_words(c), " "))


def question_hash(c: Column | str) -> Column:
    return F.sha2(normalize_question(c), 256)


def citations(c: Column | str) -> Column:
    """Ids cited as ``[id]``, each once, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CITATION), 1))


def photo_citations(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PHOTO_CITATION), 1))


def malformed_citations(c: Column | str) -> Column:
    """Bracketed strings that are neither kind of citation, repeats included."""
    well_formed = rf"^(?:{CITATION}|{PHOTO_CITATION})$"
    return F.filter(F.regexp_extract_all(c, F.lit(BRACKET), 0), lambda b: ~b.rlike(well_formed))


def abstained(c: Column | str, sentence: str) -> Column:
    """Whether the agreed sentence of abstention occurs anywhere."""
    return F.contains(c if isinstance(c, Column) else F.col(c), F.lit(sentence))


def truncated(c: Column | str, n: int) -> Column:
    return F.substring(strip(c), 1, n)


def rating_bucket(c: Column | str) -> Column:
    """``1-2``, ``3`` or ``4-5`` for the whole ratings 1 to 5, in any type; otherwise null."""
    value = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")
    return F.when(value.isin(1.0, 2.0), "1-2").when(value == 3.0, "3").when(value.isin(4.0, 5.0), "4-5")


def image_urls(images: Column | str) -> Column:
    """The best URL of each image: large, else medium, else small; images without any drop out."""
    best = lambda i: F.coalesce(*(F.nullif(i[f"{size}_image_url"], F.lit("")) for size in ("large", "medium", "small")))
    return F.filter(F.transform(F.coalesce(images, F.array()), best), lambda u: u.isNotNull())


def department(categories: Column | str) -> Column:
    """The second breadcrumb, or null."""
    return F.try_element_at(categories, F.lit(2))


def keyword_pattern(terms: Iterable[str]) -> str:
    """One pattern for any of the terms as whole words, longest first, whatever the case."""
    body = "|".join(re.escape(t).replace(r"\-", "-").replace(r"\ ", " ") for t in sorted(terms, key=lambda t: (-len(t), t)))
    return rf"(?iU)\b(?:{body})\b"


def matches_any(c: Column | str, terms: Iterable[str]) -> Column:
    return text_of(c).rlike(keyword_pattern(terms))


def excerpt(doc_id: Column | str, text: Column | str, has_photo: Column | str, max_chars: int) -> Column:
    """A document as a prompt shows it: id, photo flag, snippet."""
    flag = F.when(F.coalesce(F.col(has_photo) if isinstance(has_photo, str) else has_photo, F.lit(False)), "yes").otherwise("no")
    return F.format_string("[%s] has_photo: %s\n%s", F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, flag, truncated(text_of(text), max_chars))


def render(template: str, **values: Column | str) -> Column:
    """A prompt: ``$name`` in ``template`` replaced by columns, in one pass, so that a value that
    holds a placeholder stays as it is."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\$(\$|[A-Za-z_]\w*)", template):
        parts.append(F.lit(template[at : m.start()]))
        if m[1] == "$":
            parts.append(F.lit("$"))
        else:
            value = values[m[1]]
            parts.append(text_of(value))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def judge_scores(c: Column | str) -> Column:
    """The rubric of a model's reply as a struct; its ``error`` is null when the reply is valid.

    Valid is a JSON object, fenced or not, with a whole number from 1 to 5 for each key (no
    booleans, no strings, no fractions) and a rationale that isn't blank.
    """
    body = F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    is_whole = [F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "BIGINT", F.lit(False)) for k in JUDGE_KEYS]
    score = [F.when(ok, F.try_variant_get(parsed, f"$.{k}", "int")) for ok, k in zip(is_whole, JUDGE_KEYS, strict=True)]
    rationale = F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, "$.rationale", "variant")) == "STRING", F.lit(False)), F.try_variant_get(parsed, "$.rationale", "string"))
    error = F.when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), "no JSON object")
    for s, k in zip(score, JUDGE_KEYS, strict=True):
        error = error.when(~F.coalesce(s.between(1, 5), F.lit(False)), f"bad {k}")
    error = error.when(strip(text_of(rationale)) == "", "bad rationale")
    return F.struct(*(s.alias(k) for s, k in zip(score, JUDGE_KEYS, strict=True)), rationale.alias("rationale"), error.alias("error"))


def drafted_questions(c: Column | str) -> Column:
    """Questions of a reply that holds a JSON array of objects with ``question``."""
    body = F.regexp_extract(text_of(c), r"(?s)\[.*\]", 0)
    rows = F.from_json(body, "array<struct<question: string, rationale: string>>")
    return F.filter(rows, lambda r: strip(text_of(r["question"])) != "")


def required_questions(c: Column | str, label: Column | str) -> Column:
    """Questions and rationales of a reply that must hold a JSON array, fenced or not, of objects
    with ``question``; any other reply fails and is shown."""
    reply = text_of(c)
    body = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    rows = F.from_json(F.nullif(body, F.lit("")), "array<struct<question: string, rationale: string>>")
    name = F.col(label).cast("string") if isinstance(label, str) else label
    bad = F.raise_error(F.concat(F.lit("no array of questions for "), name, F.lit(": "), reply))
    fine = rows.isNotNull() & F.forall(rows, lambda r: r.isNotNull() & r["question"].isNotNull())
    cleaned = F.transform(rows, lambda r: F.struct(strip(r["question"]).alias("question"), strip(text_of(r["rationale"])).alias("rationale")))
    return F.when(F.coalesce(fine, F.lit(False)), cleaned).otherwise(bad)


def plain_number(c: Column | str) -> Column:
    """A number without trailing zeros: ``4`` and ``4.5``."""
    return F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("double").cast("string"), r"\.0$", "")


def completion_parts(c: Column | str, sentence: str) -> Column:
    """Answer, citations, cited photos and abstention of a completion."""
    return F.struct(strip(text_of(c)).alias("answer_text"), citations(text_of(c)).alias("cited_doc_ids"), photo_citations(text_of(c)).alias("cited_photo_ids"), abstained(text_of(c), sentence).alias("abstained"))
