"""Triggers, watermarks and the replay of commit-marked inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamReader, DataStreamWriter

# Trigger of a query that keeps running and takes up what arrives at once.
ON_ARRIVAL = {"processingTime": "0 seconds"}


def commit_interval(writer: DataStreamWriter, ms: int) -> DataStreamWriter:
    """Commit at most every ``ms`` milliseconds."""
    return writer.trigger(processingTime=f"{ms} milliseconds")


def minibatch_size(reader: DataStreamReader, n: int, fmt: str = "kafka") -> DataStreamReader:
    """Bound a micro-batch: ``n`` records of a topic, or ``n`` files of a folder."""
    option = "maxOffsetsPerTrigger" if fmt == "kafka" else "maxFilesPerTrigger"
    return reader.option(option, n)


def watermark_ascending(sdf: DataFrame, ts: str = "ts") -> DataFrame:
    """For event times that only rise: nothing later than 1 ms is expected."""
    return sdf.withWatermark(ts, "1 millisecond")


def drain_until_complete(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an ``availableNow`` query to work off its backlog; a failure is raised here."""
    finished = query.awaitTermination(timeout_s) if timeout_s is not None else (query.awaitTermination(), True)[1]
    if not finished:
        raise TimeoutError("the stream did not drain in time")
    return query


def published(spark: SparkSession, staged: str, inbox: str) -> Iterator[int]:
    """Move the ``commit_id=N`` folders of ``staged`` into ``inbox``, in order; yields N after each.

    A folder arrives by a rename, all of its files at once, so a reader sees a commit whole or not at all.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(inbox))
    names = [status.getPath().getName() for status in fs.listStatus(path(staged))]
    for commit in sorted(int(n.partition("=")[2]) for n in names if n.startswith("commit_id=")):
        if not fs.rename(path(f"{staged}/commit_id={commit}"), path(f"{inbox}/commit_id={commit}")):
            raise OSError(f"commit {commit} could not be moved to {inbox}")
        yield commit


def explicit_commit(
    spark: SparkSession, staged: str, inbox: str, run: Callable[[], StreamingQuery]
) -> StreamingQuery:
    """Replay ``commit_id=N`` folders so that each becomes exactly one micro-batch of one running query.

    A commit is delivered whole, and the next one only when the query has worked it off, so the outcome depends
    neither on file times nor on how many files a commit has.  ``run`` must start a query on ``inbox``
    that keeps running (``ON_ARRIVAL``); it is stopped after the last commit and returned.
    """
    commits = published(spark, staged, inbox)
    first = next(commits, None)  # a stream of files needs a folder to look at
    running = run()
    try:
        if first is not None:
            running.processAllAvailable()
        for _ in commits:
            running.processAllAvailable()
    finally:
        running.stop()
    return running


def persist_and_resume(query_fn: Callable[[str], StreamingQuery], checkpoint: str) -> StreamingQuery:
    """Run ``query_fn(checkpoint)`` to the end of its input; on a restart it goes on where it was.

    Without loss or duplicates as long as the sink is idempotent per micro-batch.
    """
    return drain_until_complete(query_fn(checkpoint))


def deliver(df: DataFrame, folder: str, part: int) -> None:
    """Add records to a topic folder (``value`` text lines)."""
    df.select(F.col("value")).write.mode("overwrite").text(f"{folder}/delivery={part}")
