"""Order-based operators that never put an unbounded group into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, which fails when one key holds
a third of a large table.  So the rows are range-partitioned on ``(key, order)`` into slices of about equal size, the window runs inside ``(slice, key)``, and what the earlier slices hold of a key
is carried over.  A slice boundary cuts at most one key, so the carried table has fewer than
``2 * slices`` rows: a proven bound, whatever the data, which makes broadcasting it safe.

The slices are settled in the reliable checkpoint before their ids are used, so a lost executor
cannot lead to other slice bounds half-way.  ``order`` together with the keys must be unique, or the
equal rows cannot be told apart by the range partitioner.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyflow.session import settle, shuffle_width

SLICE = "_slice"

# True puts each key's rows into one task, in one shuffle less.  A choice of who knows that all keys are
# small; it does not look at the data.
ONE_TASK_PER_KEY = False


def into_slices(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition on ``order``, number the partitions, and fix the outcome."""
    width = shuffle_width(df.sparkSession)
    return settle(df.repartitionByRange(width, *order).withColumn(SLICE, F.spark_partition_id()))


def _by_key(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def _attach_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of the carried values; ``carry`` is below ``2 * slices`` rows (see above)."""
    renamed = carry.select(
        F.col(SLICE).alias("_at"), *[F.col(k).alias(f"_at_{k}") for k in keys], *columns
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys],
        F.col(SLICE) == F.col("_at"),
    )
    return local.join(F.broadcast(renamed), same, "left")


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    keys: Sequence[str] = (),
    running: str = "running",
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``order``; ``total`` adds the sum per key."""
    kept = df.columns
    of_key = Window.partitionBy(*_by_key(keys))
    upto_here = [Window.unboundedPreceding, Window.currentRow]
    if ONE_TASK_PER_KEY:
        sums = {running: F.sum(value).over(of_key.orderBy(*order).rowsBetween(*upto_here))}
        if total is not None:
            sums[total] = F.sum(value).over(of_key)
        return df.withColumns(sums)
    sliced = into_slices(df.withColumn("_x", value), [*keys, *order])
    per_slice = sliced.groupBy(SLICE, *keys).agg(F.sum("_x").alias("_part"))
    earlier = of_key.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_slice.withColumn("_before", F.coalesce(F.sum("_part").over(earlier), F.lit(0)))
        .withColumn("_all", F.sum("_part").over(of_key))
        .withColumn("_spans", F.count(F.lit(1)).over(of_key))
        .where(F.col("_spans") > 1)
    )
    in_slice = Window.partitionBy(SLICE, *keys)
    so_far = in_slice.orderBy(*order).rowsBetween(*upto_here)
    local = sliced.withColumn("_running", F.sum("_x").over(so_far))
    if total is not None:
        local = local.withColumn("_total", F.sum("_x").over(in_slice))
    out = _attach_carry(local, carry, keys, ["_before", "_all"])
    columns = [*kept, (F.col("_running") + F.coalesce("_before", F.lit(0))).alias(running)]
    if total is not None:
        columns.append(F.coalesce("_all", "_total").alias(total))
    return out.select(*columns)


def next_value(
    df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str], name: str
) -> DataFrame:
    """First non-null ``value`` at or after each row, per ``keys`` in ``order``.

    Runs downwards from the end of a slice, so that the frame only ever grows.
    """
    kept = df.columns
    of_key = Window.partitionBy(*_by_key(keys))
    downwards = [F.desc(o) for o in order]
    upto_here = [Window.unboundedPreceding, Window.currentRow]
    if ONE_TASK_PER_KEY:
        from_end = of_key.orderBy(*downwards).rowsBetween(*upto_here)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(from_end))
    sliced = into_slices(df, [*keys, *order])
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    later = of_key.orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    # The wanted value for a slice is the first one found in the slices after it that hold the key.
    carry = (
        sliced.groupBy(SLICE, *keys)
        .agg(F.min_by(value, position).alias("_first"))
        .withColumn("_later", F.last("_first", ignorenulls=True).over(later))
        .withColumn("_spans", F.count(F.lit(1)).over(of_key))
        .where(F.col("_spans") > 1)
    )
    backwards = Window.partitionBy(SLICE, *keys).orderBy(*downwards).rowsBetween(*upto_here)
    local = sliced.withColumn("_here", F.last(value, ignorenulls=True).over(backwards))
    out = _attach_carry(local, carry, keys, ["_later"])
    return out.select(*kept, F.coalesce("_here", "_later").alias(name))


def running_count(df: DataFrame, word: str, order: Sequence[str], name: str = "count") -> DataFrame:
    """The how-manieth occurrence of its word each row is, in ``order``."""
    return running_total(df, F.lit(1).cast("bigint"), order, [word], running=name)


def global_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """0-based position of every row in the total order."""
    numbered = running_total(df, F.lit(1).cast("bigint"), order, running="_n")
    return numbered.withColumn(name, F.col("_n") - 1).drop("_n")


def skip_prefix(df: DataFrame, n: int, order: Sequence[str], complement: bool = False) -> DataFrame:
    """Drop the first ``n`` rows of the total order, or keep only those."""
    indexed = global_row_index(df, order, "_index")
    keep = F.col("_index") < n if complement else F.col("_index") >= n
    return indexed.where(keep).drop("_index")


def sort_timeline(df: DataFrame, *order: str) -> DataFrame:
    """Range-partitioned sort."""
    return df.orderBy(*order)


def head_n(edges: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The first ``n`` records of a file whose records carry their 0-based line number."""
    return edges.where(F.col(id_col) < n)


def top_ranks(ranks: DataFrame, n: int = 10, rank: str = "rank", tie: str = "vertex") -> DataFrame:
    """The ``n`` highest ranks; ties go to the smaller vertex, so the outcome is fixed."""
    return ranks.orderBy(F.desc(rank), F.asc(tie)).limit(n)


def histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, value, n``: copies of a value are merged before anything is shuffled."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ranked_histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Histogram with ``upto`` (rows at or below the value) and ``size`` (rows of the key).

    The value at 0-based sorted position ``i`` is the one with ``upto - n <= i < upto``: sorted-array
    indexing without an array, exact for any number of rows and distinct values.  The histogram is
    settled: it is small beside the rows, which would otherwise be computed again for its group sizes.
    """
    return running_total(settle(histogram(df, value, keys)), F.col("n"), [value], keys, running="upto", total="size")


def holds_position(position: Column) -> Column:
    """On a ranked histogram: does this value sit at ``position``?"""
    return (F.col("upto") > position) & (F.col("upto") - F.col("n") <= position)


def exact_median(df: DataFrame, value: str, keys: Sequence[str], name: str = "median") -> DataFrame:
    """Mean of the two middle values per key."""
    two = F.lit(2).cast("bigint")
    low = F.call_function("div", F.col("size") - 1, two)
    high = F.call_function("div", F.col("size"), two)
    ranked = ranked_histogram(df.where(F.col(value).isNotNull()), value, keys)
    return ranked.groupBy(*keys).agg(
        (
            (F.max(F.when(holds_position(low), F.col(value))) + F.max(F.when(holds_position(high), F.col(value)))) / 2
        ).alias(name)
    )
