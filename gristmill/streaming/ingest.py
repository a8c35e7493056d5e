"""Incremental ingest: the corpus filters over a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.corpus import drop_empty_text, normalize_columns


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def clean_stream(rows: DataFrame, event_time: str, keys: list[str], late: str = "1 hour", min_chars: int = 5) -> DataFrame:
    """White space collapsed, near-empty texts dropped, copies within the lateness dropped.

    State is bounded by the watermark."""
    cleaned = drop_empty_text(normalize_columns(rows, ["text"]), "text", min_chars)
    return cleaned.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(rows: DataFrame, event_time: str, width: str, key: str, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(event_time, late).groupBy(F.window(event_time, width), key).agg(F.count(F.lit(1)).alias("n"))


def append_corpus(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the stream's present input is used up; exactly once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
