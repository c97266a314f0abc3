"""Aggregations.  All combine map-side, so a hot group reaches the shuffle as one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.operators.ordered import exact_median, holds_position, ranked_histogram, running_total

# The percentiles of a latency report, and its eleven deciles.
REPORT_PERCENTILES = (0, 1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99, 100)
DECILES = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)
LOST = -1

CHUNK = 1024


def wordcount(df: DataFrame, col: str = "word") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def wordcount_map_reduce(df: DataFrame, col: str = "word") -> DataFrame:
    """The same counts as a sum of ones."""
    return df.select(col, F.lit(1).cast("bigint").alias("one")).groupBy(col).agg(F.sum("one").alias("count"))


def reduce_by_key_sum(df: DataFrame, key: str, value: str, name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(name))


def out_degree(edges: DataFrame) -> DataFrame:
    """``u, degree``; repeated edges count."""
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))


def in_vertices(edges: DataFrame) -> DataFrame:
    return edges.select("v").distinct()


def degrees_union_sum(edges: DataFrame) -> DataFrame:
    """``u, degree`` of every vertex, 0 for those without an out-edge, in one pass over the edges."""
    ends = edges.select(F.expr("stack(2, u, 1L, v, 0L)").alias("u", "one"))
    return ends.groupBy("u").agg(F.sum("one").alias("degree"))


def inflow_sum(flows: DataFrame) -> DataFrame:
    """``v, inflow`` from ``v, outflow, copies``."""
    return flows.groupBy("v").agg(F.sum(F.col("outflow") * F.col("copies")).alias("inflow"))


def neighbour_list(edges: DataFrame) -> DataFrame:
    """Distinct targets per source as ``u, chunk, neighbours, degree_part``.

    A chunk holds the targets in ``[chunk * 1024, (chunk + 1) * 1024)``, hence at most 1024 of them:
    no list grows with the number of edges of a hub.
    """
    distinct = edges.select("u", "v").distinct()
    # Whole numbers throughout: a double would misplace targets above 2^53.
    size = F.lit(CHUNK).cast("bigint")
    chunk = F.call_function("div", F.col("v") - F.pmod("v", size), size).alias("chunk")
    return distinct.groupBy("u", chunk).agg(
        F.sort_array(F.collect_list("v")).alias("neighbours"),
        F.count(F.lit(1)).alias("degree_part"),
    )


def global_count(df: DataFrame, name: str = "cnt") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def conditional_count(df: DataFrame, cond: Column, name: str = "hits") -> DataFrame:
    return df.agg(F.count_if(cond).alias(name))


def exact_key_sum() -> Column:
    """Keys are summed as decimals: exactly, whatever their size."""
    return F.coalesce(F.sum(F.col("k").cast("decimal(20,0)")), F.lit(0))


def integrity_check(df: DataFrame, n: int) -> DataFrame:
    """One row of aggregates over ``k, name, value, flag[, diff]`` and whether all of them fit.

    Keys must be ``0..n-1``, names ``item_<k>``, no column null and, where changes are recorded,
    every row an insertion.  Keys are summed exactly whatever their size; ``sum_k`` is null where it does not
    fit into 64 bits.
    """
    measures = [
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.min("k"), F.lit(-1)).alias("min_k"),
        F.coalesce(F.max("k"), F.lit(-1)).alias("max_k"),
        exact_key_sum().alias("exact_sum"),
        F.count_if(F.col("name") != F.concat(F.lit("item_"), F.col("k").cast("string"))).alias("bad_name"),
        F.count_if(F.col("value").isNull() | F.col("flag").isNull() | F.col("name").isNull()).alias("null_cols"),
    ]
    fits = (
        (F.col("count") == n)
        & (F.col("min_k") == (0 if n else -1))
        & (F.col("max_k") == n - 1)
        & (F.col("exact_sum") == F.lit(str(n * (n - 1) // 2)).cast("decimal(38,0)"))
        & (F.col("bad_name") == 0)
        & (F.col("null_cols") == 0)
    )
    if "diff" in df.columns:
        measures.append(F.coalesce(F.sum(F.col("diff").cast("bigint")), F.lit(0)).alias("sum_diff"))
        fits = fits & (F.col("sum_diff") == n)
    return (
        df.agg(*measures).withColumn("ok", fits)
        .withColumn("exact_sum", F.col("exact_sum").try_cast("bigint")).withColumnRenamed("exact_sum", "sum_k")
    )


def message_count_check(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("messages")).withColumn("ok", F.col("messages") == n)


def latency_percentiles(
    lat: DataFrame, ps: Sequence[int] = REPORT_PERCENTILES, by: Sequence[str] = (), value: str = "latency"
) -> DataFrame:
    """``by, p, value``: the element at index ``((n - 1) * p) div 100`` of the sorted latencies."""
    ranked = ranked_histogram(lat.where(F.col(value).isNotNull()), value, by)

    def index_of(p: Column) -> Column:
        return F.call_function("div", (F.col("size") - 1) * p, F.lit(100).cast("bigint"))

    wanted = F.filter(
        F.array(*[F.lit(p).cast("bigint") for p in ps]),
        lambda p: holds_position(index_of(p)),
    )
    return ranked.select(*by, F.explode(wanted).alias("p"), F.col(value).alias("value"))


def _bucket_stats(lat: DataFrame, by: str, value: str) -> DataFrame:
    ranked = ranked_histogram(lat.where(F.col(by).isNotNull() & F.col(value).isNotNull()), value, [by])
    n = F.col("size")

    def div(a: Column, b: int) -> Column:
        return F.call_function("div", a, F.lit(b).cast("bigint"))

    def at(position: Column) -> Column:
        return F.max(F.when(holds_position(position), F.col(value)))

    return ranked.groupBy(by).agg(
        F.min(value).alias("min"),
        at(div(n, 20)).alias("p05"),
        at(div(n, 2)).alias("med"),
        at(div(n * 19, 20)).alias("p95"),
        F.max(value).alias("max"),
        F.max("size").alias("count"),
    )


def latency_by_timestamp(lat: DataFrame, time: str = "timestamp", value: str = "latency") -> DataFrame:
    """Per input timestamp: min, p05, med, p95, max and count, at indexes n/20, n/2 and n*19/20."""
    return _bucket_stats(lat, time, value)


def latency_by_engine_time(lat: DataFrame, value: str = "latency") -> DataFrame:
    """The same by the engine's own commit time; records without one are left out."""
    return _bucket_stats(lat, "engine_time", value)


def lost_count(matched: DataFrame, match: str = "out_time") -> DataFrame:
    return matched.agg(F.count_if(F.col(match).isNull()).alias("lost"))


def speedup_over_base(df: DataFrame, value: str = "rows_per_second", order: str = "workers") -> DataFrame:
    """Add ``speedup``: the value over that of the first row in ``order`` that has one."""
    base = df.where(F.col(value).isNotNull()).agg(F.min_by(value, order).alias("base"))
    return df.withColumn("speedup", F.col(value) / base.scalar())


def throughput_report(runs: DataFrame, rows: int) -> DataFrame:
    """``workers, median_s, rows_per_second, speedup, ok`` from ``workers, seconds, ok`` runs.

    A failed run (no time) leaves the median and makes ``ok`` false.
    """
    medians = exact_median(runs, "seconds", ["workers"], "median_s")
    verdicts = runs.groupBy("workers").agg(
        F.bool_and(F.coalesce(F.col("ok"), F.lit(False)) & F.col("seconds").isNotNull()).alias("ok")
    )
    report = verdicts.join(medians, "workers", "left").withColumn("rows_per_second", F.lit(rows) / F.col("median_s"))
    return speedup_over_base(report).select("workers", "median_s", "rows_per_second", "speedup", "ok")


def pivot_percentiles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, p, value`` rows to one wide row per key, with ``lost`` for the loss row."""
    names = {p: "min" if p == 0 else "median" if p == 50 else "max" if p == 100 else f"p{p:02d}" for p in REPORT_PERCENTILES}
    names[LOST] = "lost"
    wide = rows.groupBy(*keys).pivot("p", list(names)).agg(F.first("value", ignorenulls=True))
    return wide.select(*keys, *[F.col(str(p)).alias(name) for p, name in names.items()])


def peak_memory(log: DataFrame) -> DataFrame:
    """``file, peak_bytes, duration_s`` from extracted log lines (``file, block, line`` ordered).

    A report is what lies between two report ends; its last heap, nonheap and managed gauge count.
    """
    reports = running_total(
        log.where(F.col("report_end") | F.col("gauge").isin("heap", "nonheap", "managed")),
        F.col("report_end").cast("bigint"),
        ["block", "line"],
        ["file"],
        running="_ends",
    )
    # The end line itself belongs to the report it closes; gauges after the last end are not reported.
    report = F.col("_ends") - F.col("report_end").cast("bigint")
    sums = (
        reports.withColumn("report", report)
        .groupBy("file", "report", "gauge")
        .agg(F.max_by("amount", F.struct("block", "line")).alias("amount"), F.bool_or("report_end").alias("closed"))
        .groupBy("file", "report")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("bytes"), F.bool_or("closed").alias("closed"))
    )
    peaks = sums.where("closed").groupBy("file").agg(F.max("bytes").alias("peak_bytes"))
    spans = log.groupBy("file").agg(
        F.max_by("started_at", F.when(F.col("started_at").isNotNull(), F.struct("block", "line"))).alias("started_at"),
        F.max_by("ended_at", F.when(F.col("ended_at").isNotNull(), F.struct("block", "line"))).alias("ended_at"),
    )
    return spans.join(peaks, "file", "left").select(
        "file",
        F.coalesce("peak_bytes", F.lit(0)).alias("peak_bytes"),
        (F.col("ended_at") - F.col("started_at")).alias("duration_s"),
    )
