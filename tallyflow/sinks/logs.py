"""Logs of keyed rows: a folder per commit, below it one per bucket of the key, and folded snapshots.

A commit reads the last snapshot and the fewer than ``FOLD_EVERY`` commits after it, and of those only the
buckets its keys fall in.  Repeating a commit after a failure overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Buckets of a key, whose set fits in the bits of a long, and commits between two snapshots.
BUCKETS = 32
FOLD_EVERY = 64

BUCKET = "key_bucket"


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def buckets_in(keys: Sequence[str]) -> Column:
    """Aggregate: the buckets that occur, as the bits of a long (null without rows)."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bucket_of(keys)))


def bucket_list(bits: int | None) -> list[int]:
    return [b for b in range(BUCKETS) if bits is not None and bits >> b & 1]


def append(rows: DataFrame, path: str, keys: Sequence[str], commit: int, spread: Column | None = None) -> None:
    """Write a commit; ``spread`` deals the rows of a bucket to several tasks, where a key may hold very many."""
    place = [F.col(BUCKET)] if spread is None else [F.col(BUCKET), spread]
    dealt = rows.withColumn(BUCKET, bucket_of(keys)).repartition(*place)
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/commit={commit}")


def read(
    spark: SparkSession, path: str, schema: str | StructType, commit: int, buckets: Iterable[int] | None = None
) -> DataFrame:
    """Rows as they were logged up to ``commit``, each with its ``commit``; of some ``buckets`` only, if given."""
    first = commit // FOLD_EVERY * FOLD_EVERY
    tail = read_commits(spark, path, schema, range(first, commit + 1), buckets)
    if not first:
        return tail
    return read_commits(spark, f"{path}-folded", schema, [first - 1], buckets).unionByName(tail)


def read_commits(
    spark: SparkSession, path: str, schema: str | StructType, commits: Iterable[int], buckets: Iterable[int] | None = None
) -> DataFrame:
    """The folders of ``commits`` and ``buckets`` that exist; no other folder is listed."""
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType(list(declared.fields)).add("commit", "integer").add(BUCKET, "integer")
    folders = f"{path}/commit={{{','.join(map(str, commits))}}}"
    if buckets is not None:
        folders += f"/{BUCKET}={{{','.join(map(str, buckets)) or '-'}}}"
    try:
        found = spark.read.schema(whole).option("basePath", path).parquet(folders)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], whole)
    return found.drop(BUCKET)


def fold(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    keys: Sequence[str],
    commit: int,
    merge: Callable[[DataFrame], DataFrame],
    spread: Column | None = None,
) -> None:
    """Every ``FOLD_EVERY`` commits: write what ``merge`` makes of the log as its next snapshot."""
    if (commit + 1) % FOLD_EVERY == 0:
        append(merge(read(spark, path, schema, commit)), f"{path}-folded", keys, commit, spread)
