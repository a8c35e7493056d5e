import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as X


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(use(F.col("v")).alias("x")).first().x


def test_white_space_and_words(spark):
    assert one(spark, "a   b\n\nc\td", X.normalize_whitespace) == "a b c d"
    assert one(spark, "\n a \t", X.strip) == "a"
    assert one(spark, "  a  b ", X.split_words) == ["a", "b"]
    assert one(spark, None, X.normalize_whitespace) is None


def test_token_len_counts_unicode_words(spark):
    for text in ("Él dijo: no!", "", "a_b  c", "naïve—co-op"):
        assert one(spark, text, X.token_len) == len(re.findall(r"\w+|[^\w\s]", text))
    assert one(spark, None, X.token_len) == 0


def test_sentences(spark):
    assert one(spark, "One. Two!  Three?\nFour", X.split_sentences) == ["One.", "Two!", "Three?", "Four"]


@pytest.mark.parametrize("rating,bucket", [("1", "1-2"), ("2.0", "1-2"), ("3", "3"), ("4", "4-5"), ("5", "4-5"), ("0", None), ("6", None), ("4.5", None), ("NaN", None), ("five stars", None), (None, None)])
def test_rating_bucket(spark, rating, bucket):
    assert one(spark, rating, X.rating_bucket) == bucket


def test_citations(spark):
    text = "x [128775] … [161398] … [128775] [photo of 9] [see review 1] []"
    assert one(spark, text, X.citations) == ["128775", "161398"]
    assert one(spark, text, X.photo_citations) == ["9"]
    assert one(spark, text, X.malformed_citations) == ["[see review 1]", "[]"]


def test_judge_scores(spark):
    def judge(raw):
        return one(spark, raw, X.judge_scores)

    good = '{"correctness": 5, "faithfulness": 4, "completeness": 3, "conciseness": 1, "rationale": "fine"}'
    assert judge(good).error is None and judge(good).correctness == 5
    assert judge(f"```json\n{good}\n```").error is None
    for bad in ("0", "6", "-1", "10", "4.5", '"5"', "true", "null"):
        assert judge(good.replace("5", bad, 1)).error == "bad correctness"
    for rationale in ('" "', "3", "null"):
        assert judge(good.replace('"fine"', rationale)).error == "bad rationale"
    for broken in ("no json", "{broken", "", None):
        assert judge(broken).error == "no JSON object"


def test_render_leaves_placeholders_of_values_alone(spark):
    row = spark.createDataFrame([("$b costs $$", "x")], "a string, b string").select(X.render("$a|$b|$$", a="a", b="b").alias("x")).first()
    assert row.x == "$b costs $$|x|$"


def test_image_urls(spark):
    kind = "array<struct<small_image_url: string, medium_image_url: string, large_image_url: string>>"
    images = [("s", "m", "l"), ("s", "", None), ("", None, ""), (None, "m", None)]
    assert one(spark, images, X.image_urls, kind) == ["l", "s", "m"]
    assert one(spark, None, X.image_urls, kind) == []


def test_keywords_are_whole_words(spark):
    use = lambda c: X.matches_any(c, ["fit", "true to size"])
    assert [one(spark, t, use) for t in ("It FIT.", "outfit", "true to size!", None, "fité")] == [True, False, True, False, False]
