"""Topic sinks and the changelog formats sent to them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyflow.functions.exprs import concat_fields, json_build
from tallyflow.sinks import logs


def topic_rows(df: DataFrame) -> DataFrame:
    """One JSON message per row, as ``value``."""
    return json_build(df)


def sink_topic_json(df: DataFrame, options: Mapping[str, str], fmt: str = "kafka") -> None:
    """Publish from every task; the broker spreads the messages over the topic's partitions."""
    topic_rows(df).write.format(fmt).options(**options).mode("append").save()


def changelog_retractions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes that turn ``old`` into ``new``: their rows with ``diff`` -1 (retracted) or 1 (inserted).

    Both sides are unique in ``keys``; rows that stay the same do not appear.  Null keys are keys like others: the
    sides meet in a grouping, which, unlike a join, puts them together.
    """
    values = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*values).alias("_before"))
    after = new.select(*keys, F.struct(*values).alias("_after"))
    met = before.unionByName(after, allowMissingColumns=True).groupBy(*keys)
    both = met.agg(F.first("_before", True).alias("_before"), F.first("_after", True).alias("_after"))
    both = both.where(~F.col("_before").eqNullSafe(F.col("_after")))
    sides = F.array(
        F.struct(F.col("_before").alias("row"), F.lit(-1).cast("smallint").alias("diff")),
        F.struct(F.col("_after").alias("row"), F.lit(1).cast("smallint").alias("diff")),
    )
    changes = both.select(*keys, F.inline(sides).alias("row", "diff")).where("row is not null")
    return changes.select(*keys, *[F.col(f"row.{v}").alias(v) for v in values], "diff")


def sink_changelog_dsv(old: DataFrame, new: DataFrame, keys: Sequence[str], time: int) -> DataFrame:
    """Changelog lines ``<columns>,time,diff`` as ``value``."""
    changes = changelog_retractions(old, new, keys)
    return changes.select(concat_fields([*new.columns, F.lit(time), "diff"]).alias("value"))


def update_lines(counts: DataFrame) -> DataFrame:
    return counts.select(concat_fields(counts.columns).alias("value"))


def sink_update_text(sdf: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Update-mode ``word,count`` lines, one ``commit=N`` folder per micro-batch.

    A folder is overwritten when its micro-batch is repeated, so a restart leaves no line twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        update_lines(batch).write.mode("overwrite").text(f"{path}/commit={batch_id}")

    writer = sdf.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def sink_update_kafka(sdf: DataFrame, options: Mapping[str, str], checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = update_lines(sdf).writeStream.outputMode("update").format("kafka").options(**options)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sink_upsert_keyed(batch: DataFrame, path: str, keys: Sequence[str], batch_id: int) -> None:
    """Record the rows a micro-batch upserts.

    Only what changed is written, never the whole table; repeating a micro-batch overwrites its own
    folder.  ``read_upserted`` merges on read; every so many commits the log is folded into a snapshot.
    """
    logs.append(batch, path, keys, batch_id)
    logs.fold(batch.sparkSession, path, batch.schema, keys, batch_id, lambda log: read_upserted(log, keys))


def read_upserted(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest row per key of an upsert log (a frame with ``commit``); combines map-side."""
    values = [c for c in source.columns if c not in (*keys, "commit", logs.BUCKET)]
    latest = source.groupBy(*keys).agg(F.max_by(F.struct(*values), "commit").alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])


def sink_subscribe(
    sdf: DataFrame,
    on_change: Callable[[DataFrame, int], None],
    keys: Sequence[str],
    log_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Call ``on_change(changes, time)`` for every commit of an update-mode aggregate.

    ``keys`` must not be empty: give a whole-table aggregate a constant key.  ``changes`` holds the retracted and inserted rows with ``is_addition``; it is a frame, so a
    commit that changes very many rows is still handled by the executors.
    """

    def react(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            old = rows_before(batch, log_path, keys, batch_id)
            changes = changelog_retractions(old, batch, keys).withColumn("is_addition", F.col("diff") > 0)
            on_change(changes, batch_id)
            sink_upsert_keyed(batch, log_path, keys, batch_id)
        finally:
            batch.unpersist(blocking=True)

    writer = sdf.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(react).start()


def rows_before(batch: DataFrame, log_path: str, keys: Sequence[str], batch_id: int) -> DataFrame:
    """Rows of the batch's keys as they stood before this commit.

    Read are the last snapshot and the commits after it, and of these the buckets the batch's keys fall in.
    """
    if batch_id == 0:
        return batch.where("1 = 0")
    buckets = logs.bucket_list(batch.agg(logs.buckets_in(keys)).first()[0])
    history = logs.read(batch.sparkSession, log_path, batch.schema, batch_id - 1, buckets)
    wanted = batch.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return read_upserted(history.join(wanted, same, "left_semi"), keys)
