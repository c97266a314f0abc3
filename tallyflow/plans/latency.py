"""From input and output timelines to per-record latencies, percentiles and losses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyflow.functions.exprs import NAME_FIELDS
from tallyflow.operators.aggregates import (
    LOST,
    REPORT_PERCENTILES,
    latency_by_engine_time,
    latency_by_timestamp,
    latency_percentiles,
    lost_count,
)
from tallyflow.operators.joins import join_lower_bound
from tallyflow.operators.ordered import running_count, running_total
from tallyflow.session import settle


def without_first_outputs(outputs: DataFrame, word: str = "word") -> DataFrame:
    """Outputs without the first one of each word.

    The measuring tool being matched loses it when it sets up a word's list; this is for like-for-like
    comparison with its figures only.
    """
    copies = outputs.withColumn("_known", F.col("engine_time").isNotNull())
    merged = copies.groupBy(word, "timestamp", "count", "_known", "engine_time").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(merged, F.col("_n"), ["timestamp", "count", "_known", "engine_time"], [word], running="_upto")
    # Copies of an output are one merged row, so only a first row of a single copy goes away whole.
    return placed.where((F.col("_upto") > F.col("_n")) | (F.col("_n") > 1)).select(
        word, "timestamp", "count", "engine_time"
    )


def match_latencies(
    inputs: DataFrame, outputs: DataFrame, tie: Sequence[str], drop_first_output: bool = False
) -> DataFrame:
    """Every input with its latency, null where it is lost.

    ``inputs``: ``timestamp, word`` and the ``tie`` columns that make the order total (topic partition
    and offset); ``outputs``: ``timestamp, word, count, engine_time``.
    """
    numbered = running_count(inputs, "word", ["timestamp", *tie])
    if drop_first_output:
        outputs = without_first_outputs(outputs)
    matched = join_lower_bound(numbered, outputs, "word", "count", "timestamp")
    return matched.withColumn("latency", F.col("out_time") - F.col("timestamp"))


@dataclass
class LatencyProfile:
    percentiles: DataFrame  # p, value, with the loss row p = -1
    timeline: DataFrame  # timestamp, latency
    by_timestamp: DataFrame  # after the skipped prefix
    by_timestamp_prefix: DataFrame  # the skipped prefix
    by_engine_time: DataFrame  # all records


def latency_profile(
    inputs: DataFrame,
    outputs: DataFrame,
    skip: int = 0,
    tie: Sequence[str] = ("offset",),
    drop_first_output: bool = False,
) -> LatencyProfile:
    """The whole report.  ``skip`` drops the first matched records, after losses are taken out."""
    matched = settle(match_latencies(inputs, outputs, tie, drop_first_output))
    found = matched.where(F.col("latency").isNotNull())
    order = ["timestamp", "word", *tie]
    numbered = settle(running_total(found, F.lit(1).cast("bigint"), order, running="_nth"))
    kept, prefix = numbered.where(F.col("_nth") > skip), numbered.where(F.col("_nth") <= skip)
    lost = lost_count(matched, "latency").select(F.lit(LOST).cast("bigint").alias("p"), F.col("lost").alias("value"))
    return LatencyProfile(
        percentiles=latency_percentiles(kept, REPORT_PERCENTILES).unionByName(lost),
        timeline=kept.select("timestamp", "latency"),
        by_timestamp=latency_by_timestamp(kept),
        by_timestamp_prefix=latency_by_timestamp(prefix),
        by_engine_time=latency_by_engine_time(found),
    )


def report_name(meta: dict[str, str]) -> str:
    """The dashed name of a result file.  A dash inside a field would split it, so it is refused."""
    values = [str(meta[f]) for f in NAME_FIELDS]
    if any("-" in v for v in values):
        raise ValueError("run metadata must not contain dashes")
    return "-".join(values)


def with_meta(df: DataFrame, meta: dict[str, str]) -> DataFrame:
    fields = ["engine", *NAME_FIELDS]
    return df.select(*[F.lit(str(meta[f])).alias(f) for f in fields], *df.columns)


def sink_latency_report(profile: LatencyProfile, folder: str, meta: dict[str, str]) -> dict[str, str]:
    """Write the frames of a profile below ``folder/<engine>/``; returns the path of each."""
    base = f"{folder}/{meta['engine']}/{report_name(meta)}"
    frames = {
        "latency": profile.percentiles,
        "timeline": profile.timeline,
        "aggregated-timeline": profile.by_timestamp.select("timestamp", "max", "p95", "med", "p05", "min", "count"),
        "pref-aggregated-timeline": profile.by_timestamp_prefix.select(
            "timestamp", "max", "p95", "med", "p05", "min", "count"
        ),
        "ptime-aggregated-timeline": profile.by_engine_time.select(
            "engine_time", "max", "p95", "med", "p05", "min", "count"
        ),
    }
    paths = {}
    for name, frame in frames.items():
        paths[name] = f"{base}-{name}.csv"
        framed = frame if name == "timeline" else with_meta(frame, meta)
        framed.write.mode("overwrite").csv(paths[name])
    return paths
