"""Scalar building blocks.  Every one is a native Spark expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

# The control words a topic or edge file may carry between records.
COMMIT_MARK = "*COMMIT*"
CONTROL_WORDS = ("*FINISH*", COMMIT_MARK)

# The dash-separated fields in the name of a latency result file.
NAME_FIELDS = (
    "benchmark",
    "run_timestamp",
    "workers",
    "cores",
    "batch_length_ms",
    "batch_size",
    "throughput",
    "kind",
    "code_version",
    "engine_version",
    "dict_size",
    "skip_prefix_length",
    "wait_time_ms",
    "recorded_dataset_size",
)

# Metric names looked for in an engine log, in the order they are tried.
LOG_GAUGES = (
    ("heap", ("jobmanager.Status.JVM.Memory.Heap.Used",)),
    ("nonheap", ("jobmanager.Status.JVM.Memory.NonHeap.Used",)),
    ("managed", ("Status.Flink.Memory.Managed.Used",)),
    ("task_heap", (".taskmanager.", "Status.JVM.Memory.Heap.Used")),
    ("task_nonheap", (".taskmanager.", "Status.JVM.Memory.NonHeap.Used")),
)
REPORT_END = "Finished metrics report"
JOB_START = "Received JobGraph submission"
JOB_END = "reached terminal state FINISHED"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- projection and arithmetic -------------------------------------------------------------


def project_rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep and rename columns: ``{old: new}``."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def literal_column(df: DataFrame, name: str, value: int | float | str | bool) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def int_arith(col: Column | str, mul: int = 1, add: int = 0) -> Column:
    """``col * mul + add`` in 64-bit integers."""
    return _col(col).cast("bigint") * F.lit(mul).cast("bigint") + F.lit(add).cast("bigint")


def floor_div(a: Column | str, b: Column | str) -> Column:
    """Integer division rounding down, exact over the whole bigint range (``b > 0``)."""
    a, b = _col(a).cast("bigint"), _col(b).cast("bigint")
    return F.call_function("div", a - F.pmod(a, b), b)


def whole_div(a: Column | str, b: Column | str) -> Column:
    """``a div b`` for non-negative operands, where truncating and rounding down agree."""
    return F.call_function("div", _col(a), _col(b))


def case_when(cond: Column, then: Column, otherwise: Column) -> Column:
    return F.when(cond, then).otherwise(otherwise)


def coalesce_null(col: Column | str, value: int | float | str) -> Column:
    return F.coalesce(_col(col), F.lit(value))


def is_null_filter(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def increment(df: DataFrame, col: str) -> DataFrame:
    """Stateless ``number + 1``; works on batch and streaming frames alike."""
    return df.withColumn(col, F.col(col) + 1)


# --- text and JSON -------------------------------------------------------------------------


def json_extract(col: Column | str, schema: str | DataType) -> Column:
    """JSON text to a struct; malformed text gives a struct of nulls."""
    return F.from_json(_col(col), schema)


def json_build(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def concat_fields(cols: Sequence[Column | str], sep: str = ",") -> Column:
    return F.concat_ws(sep, *[_col(c).cast("string") for c in cols])


def cast_bytes(col: Column | str) -> Column:
    return _col(col).cast("string")


def tokens(text: Column | str) -> Column:
    """Lower-case latin words of a text, as an array without empty entries."""
    return F.array_remove(F.split(F.lower(_col(text)), "[^a-z]+"), "")


def split_trim_unquote(col: Column | str) -> Column:
    """Fields of the last line of a payload, each without surrounding double quotes."""
    last_line = F.element_at(F.split(F.btrim(_col(col), F.lit(" \t\r\n")), "\n"), -1)
    return F.transform(F.split(last_line, ","), lambda f: F.btrim(f, F.lit('"')))


def filter_control_rows(df: DataFrame, col: str = "value") -> DataFrame:
    """Drop control words, header rows and retractions from a topic of count updates."""
    fields = split_trim_unquote(col)
    is_header = (F.element_at(fields, 1) == "word") & (F.get(fields, F.lit(1)) == "count")
    retraction = ((F.size(fields) == 4) & (F.get(fields, F.lit(3)) == "-1")) | (
        (F.size(fields) == 3) & (F.get(fields, F.lit(2)) == "-D")
    )
    return df.where(
        ~F.col(col).isin(*CONTROL_WORDS)
        & ~F.coalesce(is_header, F.lit(False))
        & ~F.coalesce(retraction, F.lit(False))
    )


def count_update(col: Column | str) -> Column:
    """``word, count, engine_time`` of one update line of 2, 3 or 4 fields."""
    fields = split_trim_unquote(col)
    return F.struct(
        F.element_at(fields, 1).alias("word"),
        F.element_at(fields, 2).cast("bigint").alias("count"),
        F.when(F.size(fields) == 4, F.get(fields, F.lit(2)).cast("bigint")).alias("engine_time"),
    )


# --- keys, commits and event time ----------------------------------------------------------


def pointer_key(*cols: Column | str) -> Column:
    """A 128-bit key from values.

    A 64-bit hash is bound to collide on the vertex counts of a web-scale graph, so the key is
    the full md5.  Every value is preceded by its length, hence ("ab", "c") and ("a", "bc") differ.
    """
    parts = []
    for c in cols:
        text = _col(c).cast("string")
        parts += [F.coalesce(F.length(text).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.md5(F.concat(*parts))


def ts_from_id(id_col: Column | str, backfill: int) -> Column:
    """Event time from an edge id, in ms; ids up to and including ``backfill`` share instant 1."""
    c = _col(id_col)
    return F.timestamp_millis(F.when(c <= F.lit(backfill), F.lit(1)).otherwise(c).cast("bigint"))


def batch_of_id(id_col: Column | str, start: int, step: int) -> Column:
    """Commit number of a 0-based id: the first ``start`` ids are commit 0, then ``step`` ids each."""
    past_start = _col(id_col).cast("bigint") + F.lit(1 - start).cast("bigint")
    rounded_up = whole_div(past_start + F.lit(step - 1).cast("bigint"), F.lit(step).cast("bigint"))
    return F.when(past_start <= 0, F.lit(0).cast("bigint")).otherwise(rounded_up)


def filename_meta(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Run metadata from ``.../<engine>/<dashed name>-latency.csv[/part-...]``.

    Folders of a partitioned write, ``engine=...`` and ``report=...``, are read without their column names.
    """
    engine = F.regexp_extract(path_col, r"(?:engine=)?([^/]+)/[^/]+-latency\.csv(/[^/]*)?$", 1)
    name = F.regexp_extract(path_col, r"(?:report=)?([^/]+)-latency\.csv(/[^/]*)?$", 1)
    parts = F.split(name, "-")
    out = df.withColumn("engine", engine)
    for i, field in enumerate(NAME_FIELDS):
        out = out.withColumn(field, F.get(parts, F.lit(i)))
    return out


def log_extract(df: DataFrame, col: str = "value") -> DataFrame:
    """Add ``gauge, amount, report_end, started_at, ended_at`` (epoch seconds) to log lines."""
    line = F.col(col)
    gauge = F.lit(None).cast("string")
    for name, parts in reversed(LOG_GAUGES):
        hit = F.lit(True)
        for part in parts:
            hit = hit & line.contains(part)
        gauge = F.when(hit, F.lit(name)).otherwise(gauge)
    gauge = F.when(line.contains(REPORT_END), F.lit(None)).otherwise(gauge)
    stamp = F.unix_timestamp(
        F.regexp_extract(F.substring_index(line, ",", 1), r"(\S+ \S+)$", 1), "yyyy-MM-dd HH:mm:ss"
    )
    return df.select(
        "*",
        gauge.alias("gauge"),
        F.when(gauge.isNotNull(), F.substring_index(F.rtrim(line), " ", -1).cast("bigint")).alias("amount"),
        line.contains(REPORT_END).alias("report_end"),
        F.when(line.contains(JOB_START), stamp).alias("started_at"),
        F.when(line.contains(JOB_END), stamp).alias("ended_at"),
    )
