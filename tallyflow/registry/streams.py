"""Streaming queries: the given tables are delivered in pieces and the results read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyflow.functions.exprs import batch_of_id, increment, ts_from_id
from tallyflow.operators.aggregates import global_count
from tallyflow.registry.base import (
    COMMITS,
    EVENT_EDGES,
    commit_sizes,
    event_edges,
    event_words,
    pagerank_ctes,
    query,
    table,
)
from tallyflow.session import scratch_path
from tallyflow.sinks import topics as sinks
from tallyflow.sources import files, topics
from tallyflow.sources.generators import gen_backfill_stream
from tallyflow.streaming import commits, graph
from tallyflow.streaming.wordcount import stream_wordcount, write_changelog, write_upserts

WORD_COMMITS = "id BIGINT, word STRING, commit_id BIGINT"
COMMIT_OF_EDGE = "case when id + 1 <= start then 0 else (id + 1 - start + step - 1) // step end"


def _append(sdf: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Parquet file sink: exactly once by its own log."""
    writer = sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(out)


def _word_topic(spark: SparkSession, sf: str, label: str) -> str:
    """JSON word records with control words among them."""
    path = scratch_path(spark, label)
    record = F.to_json(F.struct("word"))
    payloads = F.when(F.col("id") % 1000 == 999, F.array(record, F.lit("*COMMIT*"))).otherwise(F.array(record))
    event_words(spark, sf).repartitionByRange("id").select(F.explode(payloads).alias("value")).write.text(path)
    return path


def _replayed_words(
    spark: SparkSession, sf: str, start: Callable[[DataFrame, str, str], StreamingQuery]
) -> str:
    """Replay the events as words, one micro-batch per commit; ``start(counts, folder, checkpoint)`` keeps running."""
    folder = scratch_path(spark, "replay")
    words = event_words(spark, sf)
    gen_backfill_stream(words, *commit_sizes(words.count()), f"{folder}/staged")

    def run() -> StreamingQuery:
        sdf = spark.readStream.schema(WORD_COMMITS).parquet(f"{folder}/inbox")
        return start(stream_wordcount(sdf), folder, f"{folder}/checkpoint")

    commits.explicit_commit(spark, f"{folder}/staged", f"{folder}/inbox", run)
    return folder


# --- sources -------------------------------------------------------------------------------


@query("scan_event_time_table", f"""
select id, u, v, case when id <= (select count(*) // 2 from events) then 1 else id end as ts_ms from ({EVENT_EDGES})
""")
def scan_event_time_table(spark, sf):
    path, out, checkpoint = (scratch_path(spark, x) for x in ("edges", "timed", "checkpoint"))
    edges = event_edges(spark, sf)
    edges.write.json(path)
    sdf = files.scan_event_time_table(spark, path, table(spark, sf, "events").count() // 2)
    commits.drain_until_complete(_append(sdf, out, checkpoint))
    return spark.read.parquet(out).select("id", "u", "v", F.unix_millis("ts").alias("ts_ms"))


@query("stream_kafka_json", """select event_type as word, count(*) as "count" from events group by 1""")
def stream_kafka_json(spark, sf):
    path, out, checkpoint = _word_topic(spark, sf, "topic"), scratch_path(spark, "words"), scratch_path(spark, "checkpoint")
    words = topics.parse_json_values(topics.topic_folder(spark, path))
    commits.drain_until_complete(_append(words, out, checkpoint))
    return spark.read.parquet(out).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


RAW = """'{"k":' || event_id || '}'"""


@query("stream_topic_shared", f"select {RAW} as value from events")
def stream_topic_shared(spark, sf):
    path, out, checkpoint = (scratch_path(spark, x) for x in ("topic", "raw", "checkpoint"))
    table(spark, sf, "events").select(F.to_json(F.struct(F.col("event_id").alias("k"))).alias("value")).write.text(path)
    raw = topics.topic_folder(spark, path).select(F.col("value").cast("binary").alias("value"))
    commits.drain_until_complete(_append(raw, out, checkpoint))
    return spark.read.parquet(out).select(F.col("value").cast("string").alias("value"))


def _partitioned_topic(spark: SparkSession, sf: str, half: int, folder: str) -> None:
    """Deliver one half of every partition of an eight-partition topic."""
    events = table(spark, sf, "events")
    middle = events.count() // 2
    side = F.col("event_id") < middle if half == 0 else F.col("event_id") >= middle
    rows = events.where(side).select(
        F.to_json(F.struct(F.col("event_id").alias("k"))).alias("value"), (F.col("event_id") % 8).cast("int").alias("partition")
    )
    rows.write.mode("append").partitionBy("partition").text(folder)


@query("stream_topic_partition_reader", "select (event_id % 8)::int as partition, count(*) as messages, sum(event_id)::bigint as keys from events group by 1")
def stream_topic_partition_reader(spark, sf):
    folder, out, checkpoint = (scratch_path(spark, x) for x in ("topic-p8", "raw", "checkpoint"))
    for half in (0, 1):  # stopped after the first half, started again on the same checkpoint
        _partitioned_topic(spark, sf, half, folder)
        stream = topics.topic_folder(spark, folder, partitioned=True)
        commits.persist_and_resume(lambda c, s=stream: _append(s, out, c), checkpoint)
    key = F.get_json_object("value", "$.k").cast("bigint")
    return spark.read.parquet(out).groupBy("partition").agg(F.count(F.lit(1)).alias("messages"), F.sum(key).alias("keys"))


# --- counts and changelogs -----------------------------------------------------------------


@query("stream_wordcount", """select event_type as word, count(*) as "count" from events group by 1""")
def running_words(spark, sf):
    path, log, checkpoint = _word_topic(spark, sf, "topic"), scratch_path(spark, "log"), scratch_path(spark, "checkpoint")
    counts = stream_wordcount(topics.parse_json_values(topics.topic_folder(spark, path, files_per_trigger=4)))
    commits.drain_until_complete(write_upserts(counts, log, checkpoint))
    return sinks.read_upserted(spark.read.parquet(log), ["word"])


@query("explicit_commit", f"""with {COMMITS} select word, commit_id as commit, "count" from changed""")
def explicit_commit(spark, sf):
    folder = _replayed_words(spark, sf, lambda counts, f, c: write_upserts(counts, f"{f}/log", c, trigger=commits.ON_ARRIVAL))
    return spark.read.parquet(f"{folder}/log").select("word", F.col("commit").cast("bigint").alias("commit"), "count")


@query("sink_upsert_keyed", """select event_type as word, count(*) as "count" from events group by 1""")
def upsert_keyed(spark, sf):
    folder = _replayed_words(spark, sf, lambda counts, f, c: write_upserts(counts, f"{f}/log", c, trigger=commits.ON_ARRIVAL))
    return sinks.read_upserted(spark.read.parquet(f"{folder}/log"), ["word"])


@query("sink_update_text", f"""with {COMMITS} select commit_id as commit, word || ',' || "count" as value from changed""")
def update_text(spark, sf):
    folder = _replayed_words(spark, sf, lambda counts, f, c: sinks.sink_update_text(counts, f"{f}/text", c, commits.ON_ARRIVAL))
    return spark.read.text(f"{folder}/text").select(F.col("commit").cast("bigint").alias("commit"), "value")


CHANGES = f"""
with {COMMITS}
, steps as (select word, commit_id as time, "count", lag("count") over (partition by word order by commit_id) as before from changed)
select word, "count", time::bigint as time, 1::smallint as diff from steps
union all select word, before, time, -1::smallint from steps where before is not null
"""


@query("sink_changelog_dsv", f"""select word || ',' || "count" || ',' || time || ',' || diff as value from ({CHANGES})""")
def changelog_dsv(spark, sf):
    folder = _replayed_words(spark, sf, lambda counts, f, c: write_changelog(counts, f, c, as_text=True, trigger=commits.ON_ARRIVAL))
    return spark.read.text(f"{folder}/changes").select("value")


@query("changelog_retractions", CHANGES)
def changelog(spark, sf):
    folder = _replayed_words(spark, sf, lambda counts, f, c: write_changelog(counts, f, c, trigger=commits.ON_ARRIVAL))
    return spark.read.parquet(f"{folder}/changes").select("word", "count", "time", F.col("diff").cast("smallint").alias("diff"))


@query("sink_subscribe", f"""
with {COMMITS}
, totals as (select commit_id, (sum(count(*)) over (order by commit_id))::bigint as cnt from commits group by commit_id)
select cnt, commit_id as time, true as is_addition from totals
union all select lag(cnt) over (order by commit_id), commit_id, false from totals qualify lag(cnt) over (order by commit_id) is not null
""")
def subscribe(spark, sf):
    folder = scratch_path(spark, "subscribe")
    words = event_words(spark, sf)
    gen_backfill_stream(words, *commit_sizes(words.count()), f"{folder}/staged")

    def on_change(changes: DataFrame, time: int) -> None:
        row = changes.select("cnt", F.lit(time).cast("bigint").alias("time"), "is_addition")
        row.write.mode("overwrite").parquet(f"{folder}/seen/at={time}")

    def run() -> StreamingQuery:
        sdf = spark.readStream.schema(WORD_COMMITS).parquet(f"{folder}/inbox")
        total = sdf.groupBy(F.lit("all").alias("scope")).agg(F.count(F.lit(1)).alias("cnt"))
        return sinks.sink_subscribe(total, on_change, ["scope"], f"{folder}/log", f"{folder}/checkpoint", commits.ON_ARRIVAL)

    commits.explicit_commit(spark, f"{folder}/staged", f"{folder}/inbox", run)
    return spark.read.parquet(f"{folder}/seen").select("cnt", "time", "is_addition")


# --- triggers, watermarks, recovery --------------------------------------------------------


@query("commit_interval", """select event_type as word, count(*) as "count" from events group by 1""")
def commit_interval(spark, sf):
    path, log, checkpoint = _word_topic(spark, sf, "topic"), scratch_path(spark, "log"), scratch_path(spark, "checkpoint")
    counts = stream_wordcount(topics.parse_json_values(topics.topic_folder(spark, path, files_per_trigger=2)))

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.sink_upsert_keyed(batch, log, ["word"], batch_id)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    running = commits.commit_interval(writer, 100).start()
    running.processAllAvailable()
    running.stop()
    return sinks.read_upserted(spark.read.parquet(log), ["word"])


@query("minibatch_size", "select count(*) as rows, count(*) >= 0 as bounded from events")
def minibatch_size(spark, sf):
    path, out, checkpoint = _word_topic(spark, sf, "topic"), scratch_path(spark, "words"), scratch_path(spark, "checkpoint")
    reader = commits.minibatch_size(spark.readStream.schema("value STRING"), 1, "text")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/commit={batch_id}")

    sdf = topics.parse_json_values(reader.text(path))
    writer = sdf.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    commits.drain_until_complete(writer.foreachBatch(write).start())
    # Reports of progress are kept for the last batches only; the folders tell of all.
    parts = spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).distinct().count()
    seen = spark.read.parquet(out)
    return seen.agg(F.count(F.lit(1)).alias("rows"), (F.countDistinct("commit") == parts).alias("bounded"))


@query("watermark_ascending", """
select greatest(event_id, 1) as ts_ms, count(*) as n from events where event_id < (select max(event_id) from events) group by 1
""")
def watermark_ascending(spark, sf):
    """Counts per instant, final once the watermark has passed it; the last instant stays open."""
    folder = scratch_path(spark, "ascending")
    ids = event_words(spark, sf)
    gen_backfill_stream(ids, *commit_sizes(ids.count()), f"{folder}/staged")

    def run() -> StreamingQuery:
        sdf = spark.readStream.schema(WORD_COMMITS).parquet(f"{folder}/inbox")
        timed = commits.watermark_ascending(sdf.select(ts_from_id("id", 0).alias("ts")))
        closed = timed.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
        return _append(closed, f"{folder}/out", f"{folder}/checkpoint", commits.ON_ARRIVAL)

    commits.explicit_commit(spark, f"{folder}/staged", f"{folder}/inbox", run)
    return spark.read.parquet(f"{folder}/out").select(F.unix_millis("ts").alias("ts_ms"), "n")


@query("persist_and_resume", """select event_type as word, count(*) as "count" from events group by 1""")
def persist_and_resume(spark, sf):
    """The second commit fails after its output is written, and is repeated on restart."""
    folder = scratch_path(spark, "resume")
    words = event_words(spark, sf)
    gen_backfill_stream(words, *commit_sizes(words.count()), f"{folder}/staged")
    failures = []

    def start(checkpoint: str) -> StreamingQuery:
        sdf = spark.readStream.schema(WORD_COMMITS).parquet(f"{folder}/inbox")

        def write(batch: DataFrame, batch_id: int) -> None:
            sinks.sink_upsert_keyed(batch, f"{folder}/log", ["word"], batch_id)
            if batch_id == 1 and not failures:
                failures.append(batch_id)
                raise RuntimeError("lost between the write and the commit")

        writer = stream_wordcount(sdf).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).foreachBatch(write).start()

    for _ in commits.published(spark, f"{folder}/staged", f"{folder}/inbox"):
        known = len(failures)
        try:
            commits.persist_and_resume(start, f"{folder}/checkpoint")
        except Exception:
            if len(failures) == known:
                raise
            commits.persist_and_resume(start, f"{folder}/checkpoint")
    return sinks.read_upserted(spark.read.parquet(f"{folder}/log"), ["word"])


@query("drain_until_complete", "select count(*) as cnt from events")
def drain_until_complete(spark, sf):
    path, out, checkpoint = _word_topic(spark, sf, "topic"), scratch_path(spark, "words"), scratch_path(spark, "checkpoint")
    words = topics.parse_json_values(topics.topic_folder(spark, path, files_per_trigger=4))
    commits.drain_until_complete(_append(words, out, checkpoint))
    return global_count(spark.read.parquet(out))


@query("increment_stream", "select user_id + 1 as number from events")
def increment_stream(spark, sf):
    path, out, checkpoint = (scratch_path(spark, x) for x in ("numbers", "plus-one", "checkpoint"))
    table(spark, sf, "events").select(F.to_json(F.struct(F.col("user_id").alias("number"))).alias("value")).write.text(path)
    numbers = topics.parse_json_values(topics.topic_folder(spark, path), "number BIGINT")
    commits.drain_until_complete(_append(increment(numbers, "number"), out, checkpoint))
    return spark.read.parquet(out)


# --- ranking over a stream -----------------------------------------------------------------


def _ranks_sql(start: str, step: str, last: int) -> str:
    """Batch ranks after every commit."""
    ctes = [
        f"sizes as (select {start} as start, {step} as step from events)",
        f"marked as materialized (select u, v, {COMMIT_OF_EDGE} as commit_id from ({EVENT_EDGES}), sizes)",
    ]
    picks = []
    for c in range(last + 1):
        ctes.append(f"e{c} as materialized (select u, v from marked where commit_id <= {c})")
        chain, final = pagerank_ctes(f"e{c}", f"r{c}", 5)
        ctes.append(chain)
        picks.append(f"select {c}::int as commit, vertex, rank from {final}")
    return f"with {', '.join(ctes)} {' union all '.join(picks)}"


def _stream_ranks(spark: SparkSession, sf: str, start: int, step: int) -> DataFrame:
    edges, folder = event_edges(spark, sf), scratch_path(spark, "ranks")
    state = graph.backfill_pagerank(edges, folder, start, step)
    last = edges.agg(F.max(batch_of_id("id", start, step)).cast("int")).first()[0]
    return graph.rank_versions(spark, state, last)


@query("stream_pagerank", _ranks_sql("count(*) // 4", "count(*) // 4", 3))
def stream_pagerank(spark, sf):
    quarter = table(spark, sf, "events").count() // 4
    return _stream_ranks(spark, sf, quarter, quarter)


@query("backfill_pagerank", _ranks_sql("count(*) - 2", "1", 2))
def backfill_pagerank(spark, sf):
    """All but the last two edges at once, then one at a time: small commits on a large graph."""
    return _stream_ranks(spark, sf, table(spark, sf, "events").count() - 2, 1)
