"""Roll-up of many latency reports into one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyflow.functions.exprs import NAME_FIELDS
from tallyflow.operators.aggregates import REPORT_PERCENTILES, pivot_percentiles
from tallyflow.sources.files import scan_results_dir

RUN_FIELDS = ("engine", *NAME_FIELDS)


def results_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run below ``folder``: its metadata, the percentiles and the losses."""
    return pivot_percentiles(scan_results_dir(spark, folder).drop("path"), RUN_FIELDS)


def latency_over_throughput(rollup: DataFrame) -> DataFrame:
    """Median and p95 against throughput for every engine and commit interval."""
    return rollup.select(
        "engine",
        F.col("batch_length_ms").cast("double").alias("batch_length_ms"),
        F.col("throughput").cast("bigint").alias("throughput"),
        "median",
        "p95",
    ).orderBy("engine", "batch_length_ms", "throughput")


__all__ = ["REPORT_PERCENTILES", "RUN_FIELDS", "latency_over_throughput", "results_rollup"]
