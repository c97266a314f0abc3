"""Registration, shared inputs over the given tables, and the SQL both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A multigraph with a dense 0-based edge id: user -> the number in the event's props."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("u"),
        F.get_json_object("props", "$.k").cast("bigint").alias("v"),
    )


EVENT_EDGES = "select event_id as id, user_id as u, cast(json_extract_string(props, '$.k') as bigint) as v from events"


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"))


PART_EDGES = "select l_partkey as u, l_suppkey as v from lineitem"


def kv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``k, name, value, flag`` with dense keys, from the events."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("k"),
        F.concat(F.lit("item_"), F.col("event_id").cast("string")).alias("name"),
        "value",
        (F.col("event_type") == "click").alias("flag"),
    )


KV_ROWS = "select event_id as k, 'item_' || event_id as name, value, event_type = 'click' as flag from events"


def event_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("word"))


def millis(col: str) -> F.Column:
    return F.unix_millis(F.col(col).cast("timestamp"))


def input_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """``timestamp`` in ms, ``word``, and ``offset`` as the tie-break."""
    return table(spark, sf, "events").select(
        millis("ts").alias("timestamp"), F.col("event_type").alias("word"), F.col("event_id").alias("offset")
    )


DAY_MS = 24 * 3600 * 1000
HOUR_MS = 3600 * 1000


def output_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Daily commits of the running count per word, out one hour after the day ended.

    The last day is still open, so it has no commit and its inputs are lost.
    """
    from pyspark.sql import Window

    inputs = input_timeline(spark, sf)
    day = F.call_function("div", F.col("timestamp"), F.lit(DAY_MS).cast("bigint"))
    last = inputs.agg(F.max(day).alias("last")).first()["last"]
    # One row per word and day is all that reaches the window.
    per_day = inputs.groupBy("word", day.alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("day") < last)
    upto = Window.partitionBy("word").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.select(
        ((F.col("day") + 1) * DAY_MS + HOUR_MS).alias("timestamp"),
        "word",
        F.sum("n").over(upto).alias("count"),
        ((F.col("day") + 1) * DAY_MS).alias("engine_time"),
    )


TIMELINES = f"""
inputs as (
  select epoch_us(ts) // 1000 as timestamp, event_type as word, event_id as "offset",
         row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as "count"
  from events),
per_day as (
  select word, timestamp // {DAY_MS} as day, count(*) as n from inputs group by all),
outputs as (
  select (day + 1) * {DAY_MS} + {HOUR_MS} as timestamp, word,
         (sum(n) over (partition by word order by day))::bigint as "count",
         (day + 1) * {DAY_MS} as engine_time
  from per_day where day < (select max(day) from per_day)),
hit as (
  select i.*, (select min({{'c': o."count", 't': o.timestamp, 'e': o.engine_time}}) from outputs o
               where o.word = i.word
                 and (o."count" > i."count" or (o."count" = i."count" and o.timestamp >= i.timestamp))) as m
  from inputs i),
matched as (
  select timestamp, word, "offset", "count", m.c as out_count, m.t as out_time, m.e as engine_time,
         m.t - timestamp as latency
  from hit)
"""


def sorted_values(source: str, by: str = "") -> str:
    """SQL: latencies with their 0-based sorted position and group size."""
    part = f"partition by {by}" if by else ""
    lead = f"{by}, " if by else ""
    return (
        f"select {lead}latency, row_number() over ({part} order by latency) - 1 as pos, "
        f"count(*) over ({part}) as n from {source} where latency is not null"
    )


PERCENTILE_ROWS = "(select unnest([0,1,5,10,20,30,40,50,60,70,80,90,95,99,100])::bigint as p)"


def pagerank_ctes(edges: str, prefix: str, steps: int) -> tuple[str, str]:
    """SQL: unrolled integer PageRank over the relation ``edges(u, v)``; returns CTEs and the last name."""
    parts = [
        f"{prefix}_deg as materialized (select vertex, sum(d)::bigint as degree from "
        f"(select u as vertex, 1 as d from {edges} union all select v, 0 from {edges}) group by vertex)",
        f"{prefix}_0 as (select vertex, degree, 6000::bigint as rank from {prefix}_deg)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"{prefix}_{i} as materialized (select d.vertex, d.degree, (1000 + coalesce(f.inflow, 0))::bigint as rank "
            f"from {prefix}_deg d left join (select e.v as vertex, sum((r.rank * 5) // nullif(r.degree * 6, 0)) as inflow "
            f"from {edges} e join {prefix}_{i - 1} r on e.u = r.vertex group by e.v) f on d.vertex = f.vertex)"
        )
    return ",\n".join(parts), f"{prefix}_{steps}"


# Commits of the events: half the table first, then a quarter at a time.
COMMITS = """
params as (select count(*) // 2 as start, greatest(1, count(*) // 4) as step from events),
commits as (
  select event_id as id, event_type as word,
         case when event_id + 1 <= start then 0 else (event_id + 1 - start + step - 1) // step end as commit_id
  from events, params),
changed as (
  select word, commit_id, (sum(n) over (partition by word order by commit_id))::bigint as "count"
  from (select word, commit_id, count(*) as n from commits group by all))
"""


def commit_sizes(n: int) -> tuple[int, int]:
    return n // 2, max(1, n // 4)
