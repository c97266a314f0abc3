"""Bulk movement of a sharded table into a sink, with an integrity check of what arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyflow.operators.aggregates import exact_key_sum, integrity_check
from tallyflow.sinks.tables import sink_stream_of_changes
from tallyflow.sources.files import scan_csv_sharded


def bulk_copy(
    spark: SparkSession,
    source: str,
    write: Callable[[DataFrame], None],
    read_back: Callable[[], DataFrame],
    n: int | None = None,
    time: int = 0,
) -> DataFrame:
    """Copy the CSV shards at ``source`` and return the verdict on what ``read_back`` finds.

    Rows and keys are counted and summed by the pass that copies them, so the source is read once; ``ok`` takes that
    the same number and sum of keys arrive, and, where ``n`` is given, that there are so many.
    """
    sent = Observation()
    rows = sink_stream_of_changes(scan_csv_sharded(spark, source), time)
    write(rows.observe(sent, F.count(F.lit(1)).alias("n"), exact_key_sum().alias("keys")))
    count, keys = sent.get["n"], sent.get["keys"]
    landed = integrity_check(read_back(), count if n is None else n)
    # A sum beyond 64 bits is null in the verdict, which then rests on the keys being dense.
    same = (F.col("count") == count) & (F.col("sum_k").isNull() | (F.col("sum_k") == F.lit(str(keys)).cast("decimal(38,0)")))
    return landed.withColumn("ok", F.col("ok") & same)
