"""The corpus pipeline: from raw documents to token ids of the training mix.

Each stage takes what its predecessor kept, from Parquet, and all but the last return documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe_duckdb, common, minhash, mixing, nbsvm, pii

#: Least quality score that a document needs.
QUALITY = 0.7
#: Not expressible in SQL: the classifier, the masking and the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the quality classifier puts under the threshold."""
    model = nbsvm.train(docs, common.table(spark, sf_dir, "labels"), "quality", nbsvm.fold_of() != 2)
    return nbsvm.keep(docs, model, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: 5-word shingles, similarity 0.8."""
    return minhash.deduplicate(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data."""
    return pii.mask_texts(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out and repeat documents so that sources meet their weights, in training order."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to.

    ``part`` and ``row`` say where a document stands in the mixture's files: sorted by the two, rows
    are in training order.
    """
    part, row = common.unused(docs, "part", "row")
    placed = common.with_place(docs, part, row)
    return bpe_duckdb.encode_and_decode(placed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, keep=(part, row))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
