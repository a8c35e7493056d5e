"""Sources: JSON lines, Parquet, CSV, record loaders, templates, decisions."""

from __future__ import annotations

import json
import shutil
import time
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import strip
from gristmill.sources.sinks import sha256_file

#: Schemas of the record files, all read by ``read_records``.
RECORDS = {
    "questions": "id string, category string, question string, is_negative boolean, image_target boolean",
    "drafts": "id string, category string, question string, rationale string",
    "pools": "question_id string, category string, is_negative boolean, pool_size int, n_retrievers_used int, overlap_count int, doc_ids array<string>, hits array<struct<doc_id: string, retriever: string, rank: int, score: double>>",
    "labels": "question_id string, doc_id string, relevant int, reason string",
    "answers": "question_id string, answer string, cited_doc_ids array<string>, is_abstention boolean",
    "photos": "question_id string, doc_id string, reason string",
    "entries": "id string, type string, is_negative boolean, question string, relevant_ids array<string>, reference_answer string, cited_doc_ids array<string>, is_abstention boolean, image_target boolean, best_photo_id string",
    "transcripts": "question_id string, question string, context_doc_ids array<string>, context_text string, context_photo_flags map<string, boolean>, raw_completion string, answer_text string, cited_doc_ids array<string>, cited_photo_ids array<string>, abstained boolean",
}
REVIEW = (
    "rating double, title string, text string, images array<struct<small_image_url: string, medium_image_url: string, large_image_url: string, attachment_type: string>>, "
    "asin string, parent_asin string, user_id string, timestamp long, helpful_vote long, verified_purchase boolean"
)
METADATA = "parent_asin string, title string, main_category string, categories array<string>, store string, average_rating string, price string"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, gzipped by suffix or not; blank lines are skipped, a malformed line fails.

    Gzip files can't be split: spread the rows afterwards where a file is large.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, kind: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A record file of a known kind; a null in a ``required`` column fails the query."""
    rows = read_jsonl(spark, path, RECORDS[kind])
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{kind}: missing {name}"))).otherwise(F.col(name)))
    return rows


def count_records(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).where(strip("value") != "").count()


def sample_head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by ``order``; nested values stay nested."""
    return (rows.orderBy(*order) if order else rows).limit(n)


def schema_summary(rows: DataFrame, *order: str) -> DataFrame:
    """Per column: type, nulls, their share in percent, and an example of at most 120 characters:
    the first value there is by ``order``, nulls last, then in the order of the rows as they are read.

    Files are read in an order that depends on their number and sizes, so only ``order`` tells
    which value is the example of a table of several files.
    """
    n = F.count(F.lit(1))
    at = F.struct(*(x for i, c in enumerate(order) for x in (F.col(f"`{c}`").isNull().alias(f"none{i}"), F.col(f"`{c}`").alias(f"key{i}"))), F.col("_at"))
    parts = []
    for field in rows.schema:
        c = F.col(f"`{field.name}`")
        nulls = F.count_if(c.isNull())
        shown = F.to_json(c) if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        example = F.min_by(F.substring(shown, 1, 120), F.when(c.isNotNull(), at))
        share = F.rint(F.try_divide(nulls * 100.0, n) * 100) / 100
        parts.append(F.struct(F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("dtype"), nulls.alias("null_count"), share.alias("null_pct"), example.alias("example")))
    return rows.withColumn("_at", F.monotonically_increasing_id()).agg(F.array(*parts).alias("c")).select(F.inline("c"))


def lean_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata with the used columns alone; prices and ratings that are no numbers become null."""
    rows = read_jsonl(spark, path, METADATA)
    return rows.withColumns({c: F.col(c).try_cast("double") for c in ("average_rating", "price")})


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def parse_decisions(text: str) -> dict:
    """Accepted, rejected and negative questions of a decision file in JSON (or YAML, where a
    parser is installed); an id in both lists is an error."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    both = {a["id"] for a in found.get("accepted", [])} & {r["id"] for r in found.get("rejected", [])}
    if both:
        raise ValueError(f"accepted and rejected: {sorted(both)}")
    return {k: found.get(k, []) for k in ("accepted", "rejected", "negative_questions")}


def download(url: str, path: str, chunk: int = 1 << 20, tries: int = 5, wait_s: float = 1.0, sha256: str | None = None) -> Path:
    """A file from a server, going on where an earlier attempt stopped.

    Bytes go to ``<path>.part``; the file takes its name when it is whole (and has the hash).
    """
    target, part = Path(path), Path(f"{path}.part")
    if target.exists():
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    for attempt in range(tries):
        have = part.stat().st_size if part.exists() else 0
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        try:
            with urllib.request.urlopen(request, timeout=60) as reply, part.open("ab" if have and reply.status == 206 else "wb") as out:
                shutil.copyfileobj(reply, out, chunk)
            break
        except urllib.error.HTTPError as error:
            if error.code == 416:  # nothing is left to send
                break
            if error.code < 500 or attempt == tries - 1:
                raise
        except OSError:
            if attempt == tries - 1:
                raise
        time.sleep(wait_s * 2**attempt)
    if sha256 and sha256_file(str(part)) != sha256:
        part.unlink()
        raise ValueError(f"{url}: the file isn't the one expected")
    return part.replace(target)


def read_template(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")
