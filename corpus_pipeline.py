"""From raw documents to token ids: toxicity, near-duplicates, benchmark passages, secrets, encoding.

Each stage reads what the one before kept and returns the columns of ``documents``, the last one token ids. The filters
judge each row by its own text, also rows without an id and rows that repeat one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyflow.llm import byte_bpe, decontaminate, jaccard, secret_scan, toxicity
from tallyflow.llm.common import free_name, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest id stays (null ids last; of equal ones any one row)."""
    row = free_name(docs, "row_of_stage")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    of_row = groups.select(F.col("doc_id").alias("row"), "component_id")
    places = stage(rows.select(F.col(row).alias("row"), "doc_id").join(of_row, "row"), "places")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row")
    # Joined by row only: a large group is one key of the aggregation, which tasks reduce to a row before it is dealt.
    copies = places.select("row").join(places.groupBy("component_id").agg(first).select("row"), "row", "left_anti")
    return rows.join(copies.withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``."""
    done = byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.when(F.col("n_tokens") > 0, F.split("ids_text", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return done.select("doc_id", "n_tokens", ids.alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: A learned score and a learned forest decide: there is no SQL for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
