"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.cluster import clean, materialize, scratch_root, ship  # noqa: F401

#: Words of a text, here and in SQL: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch; texts can be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 500, 64 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by rows and bytes, and let executors import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, with null texts as empty ones, after the columns ``keep``."""
    return docs.select(*keep, "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Parts of a column of texts, each of about ``most`` characters at most or one text: (first row, texts)."""
    first, group, size = 0, [], 0
    for i, text in enumerate(x.as_py() for x in column):
        if group and size + len(text) > most:
            yield first, group
            first, group, size = i, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def with_place(df: DataFrame, part: str, row: str) -> DataFrame:
    """``df`` with where each row stands: the number of its file and its row in it.

    Rows that were sorted before they were written are in order of these two, in whatever order
    files are read.  Where ``df`` isn't read from files, its partitions take the files' place.
    """
    try:
        file = F.regexp_extract(F.col("_metadata.file_name"), r"part-([0-9]+)", 1).try_cast("int")
        return df.select("*", file.alias(part), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # more than a scan: it has no such column
        return df.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(row))
