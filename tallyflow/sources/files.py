"""Bounded readers over directories of files; splits of the files give the parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyflow.functions.exprs import COMMIT_MARK, CONTROL_WORDS, filename_meta, json_extract, log_extract, ts_from_id
from tallyflow.operators.ordered import running_total

KV_SCHEMA = "k BIGINT, name STRING, value DOUBLE, flag BOOLEAN"
EDGE_SCHEMA = "id BIGINT, u BIGINT, v BIGINT"


def scan_csv_sharded(spark: SparkSession, path: str, schema: str | StructType = KV_SCHEMA) -> DataFrame:
    """A directory of CSV shards with a header line and a declared schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def scan_jsonl_edges(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA) -> DataFrame:
    """JSON lines that may hold control words.

    Only the known control words are skipped; any other malformed line fails the job instead of
    turning into nulls or vanishing.
    """
    lines = spark.read.text(path).where(~F.trim("value").isin(*CONTROL_WORDS, ""))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def scan_marked_edges(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA) -> DataFrame:
    """Edges of JSON lines in which a mark ends each commit, with the ``commit_id`` that the marks before them give.

    Lines count in the order of files, of blocks in a file and of places in a block, so a file of any size is read
    in parallel: marks are counted within slices of that order, and what earlier slices hold is carried over.
    """
    lines = _placed_lines(spark, path).withColumn("value", F.trim("value"))
    is_mark = (F.col("value") == COMMIT_MARK).cast("bigint")
    counted = running_total(lines, is_mark, ["file", "block", "line"], running="commit_id")
    edges = counted.where(~F.col("value").isin(*CONTROL_WORDS, ""))
    return edges.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e"), "commit_id").select("e.*", "commit_id")


def scan_json_inferred(spark: SparkSession, path: str, sampling: float = 1.0) -> DataFrame:
    """Schema from the data; lower ``sampling`` to infer from a part of very large inputs."""
    return spark.read.option("samplingRatio", sampling).json(path)


def scan_text_parse_json(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA) -> DataFrame:
    """Text lines parsed row by row; a malformed line gives a row of nulls."""
    return spark.read.text(path).select(json_extract(F.trim("value"), schema).alias("r")).select("r.*")


def scan_edge_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``u, v`` separated by a tab, ``#`` comments skipped; another number of fields is an error."""
    return (
        spark.read.schema("u BIGINT, v BIGINT")
        .option("sep", "\t")
        .option("comment", "#")
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path)
    )


def scan_event_time_table(spark: SparkSession, path: str, backfill: int, delay: str = "1 millisecond") -> DataFrame:
    """Stream of edges with event time from their id and an ascending watermark."""
    edges = spark.readStream.schema(EDGE_SCHEMA).json(path)
    return edges.withColumn("ts", ts_from_id("id", backfill)).withWatermark("ts", delay)


def scan_results_dir(spark: SparkSession, path: str) -> DataFrame:
    """Latency result files anywhere below ``path``: metadata from the name, ``p`` and ``value`` per line."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("path"))
        .where(F.col("path").rlike(r"[^/]*latency[^/]*\.csv(/[^/]*)?$"))
    )
    fields = F.split("value", ",")
    rows = lines.select("path", F.element_at(fields, -2).cast("int").alias("p"), F.element_at(fields, -1).cast("bigint").alias("value"))
    return filename_meta(rows)


def scan_engine_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their gauges and stamps, and ``file, block, line`` to order them by.

    Within one split the running id rises with the line; the splits of a file are ordered by their
    start.  So a log of any size is read in parallel and still has a line order.
    """
    return log_extract(_placed_lines(spark, path))


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
