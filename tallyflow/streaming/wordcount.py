"""Running word counts and the changelog they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyflow.sinks.topics import changelog_retractions, sink_changelog_dsv, sink_upsert_keyed, rows_before


def stream_wordcount(sdf: DataFrame, col: str = "word") -> DataFrame:
    """Counts per word; in update mode each commit emits the words it changed.

    The counts of a micro-batch are combined before the shuffle, so a hot word costs one row a task.
    """
    return sdf.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def write_upserts(counts: DataFrame, path: str, checkpoint: str, key: str = "word", trigger: dict | None = None) -> StreamingQuery:
    """Keyed upsert log of an update-mode aggregate."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink_upsert_keyed(batch, path, [key], batch_id)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def write_changelog(
    counts: DataFrame, folder: str, checkpoint: str, key: str = "word", as_text: bool = False, trigger: dict | None = None
) -> StreamingQuery:
    """Retractions and insertions of every commit below ``folder/changes/commit=N``.

    The state before the commit comes from the upsert log in ``folder/log``: a snapshot and a short tail, restricted to
    the keys the commit touches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            old = rows_before(batch, f"{folder}/log", [key], batch_id)
            out = f"{folder}/changes/commit={batch_id}"
            if as_text:
                sink_changelog_dsv(old, batch, [key], batch_id).write.mode("overwrite").text(out)
            else:
                changes = changelog_retractions(old, batch, [key])
                changes.withColumn("time", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(out)
            sink_upsert_keyed(batch, f"{folder}/log", [key], batch_id)
        finally:
            batch.unpersist(blocking=True)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
