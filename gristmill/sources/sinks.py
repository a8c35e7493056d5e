"""Sinks: Parquet with a manifest, JSON lines, CSV, Markdown, hashes."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_hash(rows: DataFrame) -> Column:
    """MD5 of a row's values as JSON, columns by name."""
    return F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"}))


def content_fingerprint(hashed: DataFrame, hash_col: str = "h") -> DataFrame:
    """One row, ``n, fingerprint``: a hash of all rows whatever their order.

    Row hashes are cut into 32-bit words that are added up, so the sums form map-side and no task
    gathers the rows.
    """
    words = [F.conv(F.substring(hash_col, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    sums = hashed.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(w.cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"w{i}") for i, w in enumerate(words)))
    return sums.select("n", F.md5(F.concat_ws(":", "w0", "w1", "w2", "w3")).alias("fingerprint"))


def write_corpus(rows: DataFrame, path: str, manifest_path: str | None = None, files: int | None = None) -> dict:
    """Parquet and its manifest: row count, schema, content fingerprint."""
    (rows if files is None else rows.repartition(files)).write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    found = content_fingerprint(back.select(row_hash(back).alias("h"))).first()
    manifest = {"n_rows": found["n"], "fingerprint": found["fingerprint"], "columns": {f.name: f.dataType.simpleString() for f in back.schema}}
    if manifest_path:
        Path(manifest_path).write_text(json.dumps(manifest, indent=2, ensure_ascii=False))
    return manifest


def write_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """One file of JSON lines in the given order, nulls written out."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """One CSV file with a header; nested columns as JSON."""
    nested = [f.name for f in rows.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    rows.withColumns({c: F.to_json(c) for c in nested}).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(one_row: DataFrame, path: str) -> dict:
    """A one-row frame as a JSON file."""
    report = json.loads(one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False))
    return report


def markdown_table(rows: DataFrame, *order: str, limit: int = 1000) -> str:
    """A small frame as a Markdown table."""
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v).replace('|', chr(92) + '|').replace(chr(10), ' ') for v in r)} |\n" for r in rows.orderBy(*order).limit(limit).collect())


def worksheet(groups: DataFrame, title: Column, items: Column) -> DataFrame:
    """One Markdown section per row: a title and a bullet for each item."""
    return groups.select(F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- [ ] "), i)), "\n")).alias("section"))


def sha256_file(path: str, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as data:
        while block := data.read(chunk):
            digest.update(block)
    return digest.hexdigest()
