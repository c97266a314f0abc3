"""Message-topic readers.

The Kafka and Pulsar connectors are separate packages; with one on the class path these builders
read it directly.  ``topic_folder`` is the stand-in used where there is no broker: a folder of text
files, one record per line, optionally split in ``partition=N`` sub-folders.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyflow.functions.exprs import CONTROL_WORDS, cast_bytes, json_extract

WORD_SCHEMA = "word STRING"


def kafka_options(servers: str, topic: str, start: str = "latest", end: str | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if end is not None:
        options["endingOffsets"] = end
    return options


def pulsar_options(
    service_url: str,
    topic: str,
    subscription: str | None = None,
    start_from: str | None = None,
) -> dict[str, str]:
    """A named subscription is shared between workers; ``start_from`` lets the query own its offsets."""
    options = {"service.url": service_url, "topic": topic}
    if subscription is not None:
        options["predefinedSubscription"] = subscription
    if start_from is not None:
        options["startingOffsets"] = {"beginning": "earliest", "end": "latest"}.get(start_from, start_from)
    return options


def parse_json_values(raw: DataFrame, schema: str = WORD_SCHEMA) -> DataFrame:
    """Records of a topic to columns; control words and unparsable payloads are dropped."""
    text = raw.select(cast_bytes("value").alias("value")).where(~F.col("value").isin(*CONTROL_WORDS))
    parsed = text.select(json_extract("value", schema).alias("r")).select("r.*")
    return parsed.dropna(how="all")


def stream_kafka_json(spark: SparkSession, options: Mapping[str, str], schema: str = WORD_SCHEMA) -> DataFrame:
    return parse_json_values(spark.readStream.format("kafka").options(**options).load(), schema)


def bounded_timeline(raw: DataFrame, parse: Callable[[str], Column]) -> DataFrame:
    """``timestamp`` (ms) and the parsed payload of every record that is not a control word."""
    text = raw.select("timestamp", cast_bytes("value").alias("value")).where(~F.col("value").isin(*CONTROL_WORDS))
    return text.select("timestamp", parse("value").alias("r")).where("r is not null").select("timestamp", "r.*")


def scan_kafka_bounded(spark: SparkSession, options: Mapping[str, str], parse: Callable[[str], Column]) -> DataFrame:
    """Everything in a topic from its start to its current end, with broker append times in ms.

    The order is that of no one; operators that need one ask for it.
    """
    raw = spark.read.format("kafka").options(**options).load()
    return bounded_timeline(raw.select(F.unix_millis("timestamp").alias("timestamp"), "value"), parse)


def stream_topic_shared(spark: SparkSession, options: Mapping[str, str], fmt: str = "pulsar") -> DataFrame:
    """Raw payloads of a topic read by all workers on one shared subscription."""
    return spark.readStream.format(fmt).options(**options).load().select("value")


def stream_topic_partition_reader(
    spark: SparkSession, options: Mapping[str, str], start: str = "earliest", fmt: str = "pulsar"
) -> DataFrame:
    """Raw payloads, offsets per partition owned by the query's checkpoint."""
    return spark.readStream.format(fmt).options(**{**options, "startingOffsets": start}).load().select("value")


def topic_folder(spark: SparkSession, path: str, partitioned: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a folder of text files standing in for a topic."""
    schema = "value STRING, partition INT" if partitioned else "value STRING"
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)
