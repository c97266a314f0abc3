"""Sources and file-shaped sinks.

Each query writes the given tables out in the format under test, below the shared folder, and reads
them back through the operator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyflow.functions.exprs import NAME_FIELDS, batch_of_id, coalesce_null, filename_meta, log_extract
from tallyflow.operators.aggregates import REPORT_PERCENTILES, integrity_check, latency_percentiles, message_count_check, peak_memory
from tallyflow.plans import bulk_copy as copying, reports
from tallyflow.plans.latency import latency_profile, match_latencies, report_name, sink_latency_report
from tallyflow.registry.base import (
    EVENT_EDGES,
    KV_ROWS,
    PERCENTILE_ROWS,
    TIMELINES,
    event_edges,
    input_timeline,
    kv_rows,
    millis,
    output_timeline,
    query,
    sorted_values,
    table,
)
from tallyflow.session import scratch_path
from tallyflow.sinks import files as file_sinks, tables as table_sinks, topics as topic_sinks
from tallyflow.sources import files, generators, topics


# --- sources -------------------------------------------------------------------------------


def _csv_shards(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "kv-csv")
    kv_rows(spark, sf).repartitionByRange("k").write.option("header", True).csv(path)
    return path


@query("scan_csv_sharded", KV_ROWS)
def scan_csv_sharded(spark, sf):
    return files.scan_csv_sharded(spark, _csv_shards(spark, sf))


def _jsonl(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct("id", "u", "v")).alias("value"))


@query("scan_jsonl_edges", EVENT_EDGES)
def scan_jsonl_edges(spark, sf):
    edges = event_edges(spark, sf)
    path = scratch_path(spark, "edges-jsonl")
    ends_block = (F.col("id") + 1) % 1000 == 0
    lines = F.when(ends_block, F.array("value", F.lit("*COMMIT*"))).otherwise(F.array("value"))
    marked = edges.withColumn("value", F.to_json(F.struct("id", "u", "v"))).select(F.explode(lines).alias("value"))
    marked.write.text(path)
    return files.scan_jsonl_edges(spark, path)


@query("scan_marked_edges", f"""
select id, u, v, case when id + 1 <= start then 0 else (id + 1 - start + step - 1) // step end as commit_id
from ({EVENT_EDGES}), (select count(*) // 2 as start, greatest(1, count(*) // 50) as step from events)
""")
def scan_marked_edges(spark, sf):
    n, path = table(spark, sf, "events").count(), scratch_path(spark, "edges-marked")
    generators.gen_marked_edges(event_edges(spark, sf), n // 2, max(1, n // 50), path, 8)
    return files.scan_marked_edges(spark, path)


@query("scan_json_inferred", EVENT_EDGES)
def scan_json_inferred(spark, sf):
    path = scratch_path(spark, "edges-json")
    event_edges(spark, sf).write.json(path)
    return files.scan_json_inferred(spark, path).select("id", "u", "v")


@query("scan_text_parse_json", f"select u, v from ({EVENT_EDGES})")
def scan_text_parse_json(spark, sf):
    path = scratch_path(spark, "edges-text")
    _jsonl(event_edges(spark, sf)).write.text(path)
    return files.scan_text_parse_json(spark, path).select("u", "v")


@query("scan_edge_tsv", f"select u, v from ({EVENT_EDGES})")
def scan_edge_tsv(spark, sf):
    path = scratch_path(spark, "edges-tsv")
    lines = event_edges(spark, sf).select(
        F.concat_ws("\n", F.when(F.col("id") % 1000 == 0, F.lit("# edges")), F.concat_ws("\t", "u", "v")).alias("value")
    )
    lines.write.text(path)
    return files.scan_edge_tsv(spark, path)


@query("scan_results_dir", f"""
with {TIMELINES}, s as ({sorted_values('matched', 'word')})
select word as engine, 'wordcount' as benchmark, p::int as p, latency as value
from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100
""")
def scan_results_dir(spark, sf):
    folder = _result_files(spark, sf)
    return files.scan_results_dir(spark, folder).select("engine", "benchmark", "p", "value")


RUN = {
    "benchmark": "wordcount",
    "run_timestamp": "1700000000.5",
    "workers": "1",
    "cores": "8",
    "batch_length_ms": "20",
    "batch_size": "1000000000",
    "throughput": "200000",
    "kind": "unaware",
    "code_version": "c1",
    "engine_version": "e1",
    "dict_size": "5000",
    "skip_prefix_length": "0",
    "wait_time_ms": "0",
    "recorded_dataset_size": "10000000",
}


def _result_files(spark: SparkSession, sf: str) -> str:
    """A latency report per event type, each in its own folder: one engine, one run."""
    folder = scratch_path(spark, "results")
    matched = match_latencies(input_timeline(spark, sf), output_timeline(spark, sf), ["offset"])
    rows = latency_percentiles(matched, by=["word"])
    lines = rows.select(
        F.concat_ws(",", "word", F.lit(report_name(RUN).replace("-", ",")), "p", "value").alias("line"),
        F.col("word").alias("engine"),
        F.lit(f"{report_name(RUN)}-latency.csv").alias("report"),
    )
    # One write: the path of a file carries what the run was.
    lines.write.partitionBy("engine", "report").text(folder)
    return folder


LOG_LINES = """
select job, pos, case kind
  when 0 then '2024-01-01 00:00:00,000 INFO jobmanager.Status.JVM.Memory.Heap.Used: ' || amount
  when 1 then '2024-01-01 00:00:00,000 INFO jobmanager.Status.JVM.Memory.NonHeap.Used: ' || amount
  when 2 then '2024-01-01 00:00:00,000 INFO m.Status.Flink.Memory.Managed.Used: ' || amount
  when 3 then '2024-01-01 00:00:00,000 INFO x.taskmanager.y.Status.JVM.Memory.Heap.Used: ' || amount
  else '2024-01-01 00:00:00,000 INFO Finished metrics report' end as line
from (select event_id // 1000 as job, event_id as pos, event_id % 5 as kind,
             cast(round(value * 100) as bigint) as amount from events)
"""


def _log_files(spark: SparkSession, sf: str) -> str:
    """Engine logs out of the events: a thousand lines to a job, each job in a file of its own."""
    folder = scratch_path(spark, "engine-logs")
    amount = F.round(F.col("value") * 100).cast("bigint").cast("string")
    head = "2024-01-01 00:00:00,000 INFO "
    kind = F.col("event_id") % 5
    line = (
        F.when(kind == 0, F.concat(F.lit(head + "jobmanager.Status.JVM.Memory.Heap.Used: "), amount))
        .when(kind == 1, F.concat(F.lit(head + "jobmanager.Status.JVM.Memory.NonHeap.Used: "), amount))
        .when(kind == 2, F.concat(F.lit(head + "m.Status.Flink.Memory.Managed.Used: "), amount))
        .when(kind == 3, F.concat(F.lit(head + "x.taskmanager.y.Status.JVM.Memory.Heap.Used: "), amount))
        .otherwise(F.lit(head + "Finished metrics report"))
    )
    job = F.call_function("div", F.col("event_id"), F.lit(1000).cast("bigint"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")), "yyyy-MM-dd HH:mm:ss")
    first, last = F.col("event_id") % 1000 == 0, F.col("event_id") % 1000 == 999
    lines = F.concat_ws(
        "\n",
        F.when(first, F.concat(stamp, F.lit(",000 INFO Received JobGraph submission"))),
        line,
        F.when(last, F.concat(stamp, F.lit(",000 INFO Job reached terminal state FINISHED"))),
    )
    placed = table(spark, sf, "events").select(job.alias("job"), "event_id", lines.alias("value"))
    by_job = placed.repartition("job").sortWithinPartitions("job", "event_id")
    by_job.select("job", "value").write.partitionBy("job").text(folder)
    return folder


def _job(df: DataFrame) -> DataFrame:
    return df.withColumn("job", F.regexp_extract("file", r"job=(\d+)", 1).cast("bigint"))


@query("scan_engine_log", f"""
select job, case when line like '%NonHeap%' then 'nonheap' when line like '%jobmanager%' then 'heap'
                 when line like '%Managed%' then 'managed' when line like '%taskmanager%' then 'task_heap' end as gauge,
       case when line not like '%Finished%' then cast(split_part(line, 'Used: ', 2) as bigint) else -1 end as amount,
       line like '%Finished metrics%' as report_end
from ({LOG_LINES})
""")
def scan_engine_log(spark, sf):
    lines = _job(files.scan_engine_log(spark, _log_files(spark, sf)))
    marked = lines.where("started_at is null and ended_at is null")
    return marked.select("job", "gauge", coalesce_null("amount", -1).alias("amount"), "report_end")


@query("log_extract", f"""
select pos, case when line like '%NonHeap%' then 'nonheap' when line like '%jobmanager%' then 'heap'
                 when line like '%Managed%' then 'managed' when line like '%taskmanager%' then 'task_heap' end as gauge,
       case when line not like '%Finished%' then cast(split_part(line, 'Used: ', 2) as bigint) else -1 end as amount,
       line like '%Finished metrics%' as report_end
from ({LOG_LINES})
""")
def log_lines(spark, sf):
    spark_lines = table(spark, sf, "events").select(
        F.col("event_id").alias("pos"),
        F.expr(
            "concat('2024-01-01 00:00:00,000 INFO ', case event_id % 5 "
            "when 0 then 'jobmanager.Status.JVM.Memory.Heap.Used: ' when 1 then 'jobmanager.Status.JVM.Memory.NonHeap.Used: ' "
            "when 2 then 'm.Status.Flink.Memory.Managed.Used: ' when 3 then 'x.taskmanager.y.Status.JVM.Memory.Heap.Used: ' "
            "else 'Finished metrics report' end, "
            "case when event_id % 5 < 4 then cast(cast(round(value * 100) as bigint) as string) else '' end)"
        ).alias("value"),
    )
    return log_extract(spark_lines).select("pos", "gauge", coalesce_null("amount", -1).alias("amount"), "report_end")


@query("peak_memory", f"""
with l as ({LOG_LINES}),
g as (select job, pos, line like '%Finished%' as report_end,
        case when line like '%NonHeap%' then 'nonheap' when line like '%jobmanager%' then 'heap'
             when line like '%Managed%' then 'managed' end as gauge,
        case when line not like '%Finished%' then cast(split_part(line, 'Used: ', 2) as bigint) end as amount from l),
r as (select *, sum(report_end::int) over (partition by job order by pos) - report_end::int as report from g
      where report_end or gauge is not null),
a as (select job, report, gauge, max_by(amount, pos) as amount, bool_or(report_end) as closed from r group by all),
s as (select job, report, coalesce(sum(amount), 0)::bigint as bytes, bool_or(closed) as closed from a group by all)
select job, max(bytes) as peak_bytes, 999::bigint as duration_s from s where closed group by job
""")
def peak(spark, sf):
    return _job(peak_memory(files.scan_engine_log(spark, _log_files(spark, sf)))).select("job", "peak_bytes", "duration_s")


@query("filename_meta", """
select event_id as id, event_type as engine, 'wordcount' as benchmark, user_id::varchar as workers,
       (event_id % 100)::varchar as batch_length_ms, event_id::varchar as recorded_dataset_size
from events
""")
def name_meta(spark, sf):
    fixed = {**RUN, "workers": None, "batch_length_ms": None, "recorded_dataset_size": None}
    varying = {
        "workers": F.col("user_id").cast("string"),
        "batch_length_ms": (F.col("event_id") % 100).cast("string"),
        "recorded_dataset_size": F.col("event_id").cast("string"),
    }
    name = F.concat_ws("-", *[F.lit(fixed[f]) if fixed[f] else varying[f] for f in NAME_FIELDS])
    paths = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("file:/r/results/"), "event_type", F.lit("/"), name, F.lit("-latency.csv")).alias("path"),
    )
    return filename_meta(paths).select("id", "engine", "benchmark", "workers", "batch_length_ms", "recorded_dataset_size")


_WIDE = ", ".join(
    f"max(latency) filter (where p = {p}) as {'min' if p == 0 else 'median' if p == 50 else 'max' if p == 100 else f'p{p:02d}'}"
    for p in REPORT_PERCENTILES
)


@query("results_table", f"""
with {TIMELINES}, s as ({sorted_values('matched', 'word')}),
r as (select word, p, latency from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100)
select word as engine, {", ".join(f"'{v}' as {k}" for k, v in RUN.items())}, {_WIDE}, null::bigint as lost
from r group by word
""")
def results_table(spark, sf):
    """The combined table with all of its columns, written and read back."""
    path = scratch_path(spark, "combined")
    reports.results_rollup(spark, _result_files(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query("results_rollup", f"""
with {TIMELINES}, s as ({sorted_values('matched', 'word')}),
r as (select word, p, latency from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100)
select word as engine, 200000::bigint as throughput, 20::double as batch_length_ms,
       max(latency) filter (where p = 50) as median, max(latency) filter (where p = 95) as p95
from r group by word
""")
def rollup(spark, sf):
    return reports.latency_over_throughput(reports.results_rollup(spark, _result_files(spark, sf)))


# --- generators ----------------------------------------------------------------------------


def _hex(digest: str, start: int, digits: int) -> str:
    return f"cast('0x' || substr({digest}, {start}, {digits}) as bigint)"


_LETTERS = " || ".join(f"chr(cast(97 + {_hex('w', 1 + 4 * i, 4)} % 26 as int))" for i in range(7))


@query("gen_words", f"""
select id, {_LETTERS} as word from (
  select event_id as id, md5('word:1:' || ({_hex("md5('draw:1:' || event_id)", 1, 8)} % 5000)) as w from events)
""")
def gen_words(spark, sf):
    return generators.words_for(table(spark, sf, "events").select(F.col("event_id").alias("id")))


@query("gen_kv_rows", f"""
select event_id as k, 'item_' || event_id as name,
       {_hex("md5('kv:1:' || event_id)", 1, 12)}::double / 281474976710656.0::double as value,
       {_hex("md5('kv:1:' || event_id)", 13, 4)} % 2 = 1 as flag
from events
""")
def gen_kv_rows(spark, sf):
    return generators.kv_rows_for(table(spark, sf, "events").select("event_id"), "event_id")


@query("gen_backfill_stream", f"""
select id, u, v, (case when id + 1 <= start then 0 else (id + 1 - start + step - 1) // step end)::int as commit_id
from ({EVENT_EDGES}), (select count(*) * 3 // 4 as start, greatest(1, count(*) // 8) as step from events)
""")
def gen_backfill_stream(spark, sf):
    edges = event_edges(spark, sf)
    n = table(spark, sf, "events").count()
    path = scratch_path(spark, "backfill")
    generators.gen_backfill_stream(edges, n * 3 // 4, max(1, n // 8), path)
    return spark.read.parquet(path).select("id", "u", "v", "commit_id")


@query("batch_of_id", """
select event_id as id, case when event_id + 1 <= start then 0 else (event_id + 1 - start + 999) // 1000 end as commit_id
from events, (select count(*) // 3 as start from events)
""")
def commit_of_id(spark, sf):
    events = table(spark, sf, "events")
    start = events.count() // 3
    return events.select(F.col("event_id").alias("id"), batch_of_id("event_id", start, 1000).alias("commit_id"))


# --- topics in bounded form ----------------------------------------------------------------


@query("scan_kafka_bounded", "select epoch_us(ts) // 1000 as timestamp, event_type as word from events")
def scan_kafka_bounded(spark, sf):
    events = table(spark, sf, "events")
    path = scratch_path(spark, "topic-parquet")
    record = F.to_json(F.struct(F.col("event_type").alias("word")))
    # Every 1000th record is followed by a control word.
    payloads = F.when(F.col("event_id") % 1000 == 999, F.array(record, F.lit("*COMMIT*"))).otherwise(F.array(record))
    raw = events.select(millis("ts").alias("timestamp"), F.explode(payloads).alias("value"))
    raw.withColumn("value", F.col("value").cast("binary")).write.parquet(path)
    return topics.bounded_timeline(spark.read.parquet(path), lambda c: F.from_json(c, topics.WORD_SCHEMA))


@query("sink_topic_json", KV_ROWS)
def sink_topic_json(spark, sf):
    path = scratch_path(spark, "topic-json")
    topic_sinks.topic_rows(kv_rows(spark, sf)).write.text(path)
    return spark.read.text(path).select(F.from_json("value", files.KV_SCHEMA).alias("r")).select("r.*")


@query("message_count_check", "select count(*) as messages, true as ok from events")
def messages(spark, sf):
    path = scratch_path(spark, "topic-count")
    rows = kv_rows(spark, sf)
    topic_sinks.topic_rows(rows).write.text(path)
    return message_count_check(spark.read.text(path), table(spark, sf, "events").count())


# --- sinks ---------------------------------------------------------------------------------

_VERDICT = """
select count(*) as "count", min(event_id) as min_k, max(event_id) as max_k, sum(event_id)::bigint as sum_k,
       0::bigint as bad_name, 0::bigint as null_cols, {diff}
       count(*) = max(event_id) + 1 and min(event_id) = 0 as ok
from events
"""
WITH_DIFF = "count(*) as sum_diff,"


def _n(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "events").count()


@query("integrity_check", _VERDICT.format(diff=WITH_DIFF))
def integrity(spark, sf):
    return integrity_check(table_sinks.sink_stream_of_changes(kv_rows(spark, sf), 0), _n(spark, sf))


@query("bulk_copy", _VERDICT.format(diff=WITH_DIFF))
def bulk_copy(spark, sf):
    target = scratch_path(spark, "copied")
    return copying.bulk_copy(
        spark,
        _csv_shards(spark, sf),
        lambda rows: rows.write.parquet(target),
        lambda: spark.read.parquet(target),
    )


@query("sink_stream_of_changes", f"select *, 7::bigint as time, 1::smallint as diff from ({KV_ROWS})")
def stream_of_changes(spark, sf):
    return table_sinks.sink_stream_of_changes(kv_rows(spark, sf), 7)


def _landed(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """The rows a database sink inserts, staged as a table: no database can be reached from here."""
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.parquet(path)


@query("sink_jdbc_replace", f"select *, 0::bigint as time, 1::smallint as diff from ({KV_ROWS})")
def jdbc_replace(spark, sf):
    return _landed(spark, table_sinks.landing_rows(kv_rows(spark, sf)), "jdbc")


@query("sink_clickhouse", _VERDICT.format(diff=WITH_DIFF))
def clickhouse(spark, sf):
    return integrity_check(_landed(spark, table_sinks.landing_rows(kv_rows(spark, sf)), "clickhouse"), _n(spark, sf))


@query("sink_questdb", f"select *, true as stamped from ({KV_ROWS})")
def questdb(spark, sf):
    rows = _landed(spark, table_sinks.with_ingestion_time(kv_rows(spark, sf)), "questdb")
    return rows.withColumn("stamped", F.col("timestamp").isNotNull()).drop("timestamp")


@query("sink_single_writer", _VERDICT.format(diff=WITH_DIFF))
def single_writer(spark, sf):
    return integrity_check(_landed(spark, table_sinks.landing_rows(kv_rows(spark, sf)), "single"), _n(spark, sf))


@query("sink_null", "select count(*) as rows from events")
def null_sink(spark, sf):
    return spark.createDataFrame([(file_sinks.sink_null(kv_rows(spark, sf))["rows"],)], "rows BIGINT")


@query("sink_files", KV_ROWS)
def write_files(spark, sf):
    path = scratch_path(spark, "files-csv")
    file_sinks.sink_files(kv_rows(spark, sf), path, "csv")
    return spark.read.schema(files.KV_SCHEMA).csv(path)


@query("sink_tsv_collect", f"select id, u, v from ({EVENT_EDGES})")
def write_tsv(spark, sf):
    path = scratch_path(spark, "files-tsv")
    file_sinks.sink_tsv_collect(event_edges(spark, sf), path)
    return spark.read.schema(files.EDGE_SCHEMA).option("sep", "\t").csv(path)


@query("sink_latency_report", f"""
with {TIMELINES}, s as ({sorted_values('matched')})
select p, latency as value from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100
union all select -1, count(*) filter (where latency is null) from matched
""")
def latency_report(spark, sf):
    profile = latency_profile(input_timeline(spark, sf), output_timeline(spark, sf))
    paths = sink_latency_report(profile, scratch_path(spark, "report"), {"engine": "spark", **RUN})
    lines = spark.read.text(paths["latency"]).select(F.split("value", ",").alias("f"))
    return lines.select(F.element_at("f", -2).cast("bigint").alias("p"), F.element_at("f", -1).cast("bigint").alias("value"))


_STATS = """max(latency) || ',' || max(latency) filter (where pos = (n * 19) // 20) || ',' || max(latency) filter (where pos = n // 2)
  || ',' || max(latency) filter (where pos = n // 20) || ',' || min(latency) || ',' || max(n)"""


@query("latency_report_outputs", f"""
with {TIMELINES},
found as (select * from matched where latency is not null),
numbered as (select *, row_number() over (order by timestamp, word, "offset") > 500 as kept from found),
s as ({sorted_values('(select latency from numbered where kept)')}),
by_input as (select kept, timestamp, latency, row_number() over (partition by kept, timestamp order by latency) - 1 as pos,
                    count(*) over (partition by kept, timestamp) as n from numbered),
by_engine as ({sorted_values('(select engine_time, latency from found where engine_time is not null)', 'engine_time')})
select 'latency' as output, p || ',' || latency as line from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100
union all select 'latency', '-1,' || count(*) filter (where latency is null) from matched
union all select 'timeline', timestamp || ',' || latency from numbered where kept
union all select case when kept then '' else 'pref-' end || 'aggregated-timeline', timestamp || ',' || {_STATS} from by_input group by kept, timestamp
union all select 'ptime-aggregated-timeline', engine_time || ',' || {_STATS} from by_engine group by engine_time
""")
def latency_report_outputs(spark, sf):
    """All five files of a report with a skipped prefix, each line without the columns that describe the run."""
    profile = latency_profile(input_timeline(spark, sf), output_timeline(spark, sf), skip=500)
    paths = sink_latency_report(profile, scratch_path(spark, "report"), {"engine": "spark", **RUN})
    lines = []
    for output, path in paths.items():
        own = 1 if output == "timeline" else len(reports.RUN_FIELDS) + 1
        line = F.array_join(F.slice(F.split("value", ","), own, 100), ",").alias("line")
        lines.append(spark.read.text(path).select(F.lit(output).alias("output"), line))
    return reduce(DataFrame.unionByName, lines)


_LATER = """later as (select * from outputs qualify row_number() over (partition by word order by timestamp, "count") > 1),
hit as ("""
DECILES = tuple(range(0, 101, 10))


@query("latency_deciles", f"""
with {TIMELINES.replace("hit as (", _LATER).replace("from outputs o", "from later o")}, s as ({sorted_values('matched')})
select p, latency as value from s join (select unnest({list(DECILES)})::bigint as p) on pos = ((n - 1) * p) // 100
""")
def latency_deciles(spark, sf):
    """The eleven deciles, where the first output of each word does not count."""
    matched = match_latencies(input_timeline(spark, sf), output_timeline(spark, sf), ["offset"], drop_first_output=True)
    return latency_percentiles(matched, DECILES)
