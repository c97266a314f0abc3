"""Deterministic generators: the value of a row depends on its id and the seed alone.

They therefore give the same table on any number of executors, and again after a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyflow.functions.exprs import COMMIT_MARK, batch_of_id

# The reference sizes.
DICT_SIZE = 5000
WORD_LETTERS = 7
SHARDS = 64


def _digest(label: str, seed: int, number: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{label}:{seed}:"), number.cast("string")))


def _hex_part(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def words_for(ids: DataFrame, id_col: str = "id", dict_size: int = DICT_SIZE, seed: int = 1) -> DataFrame:
    """One uniform draw from a dictionary of random seven-letter words per id.

    The dictionary is never materialised: a word is a function of its number.
    """
    drawn = F.pmod(_hex_part(_digest("draw", seed, F.col(id_col)), 1, 8), F.lit(dict_size))
    spelled = ids.select("*", _digest("word", seed, drawn).alias("_w"))
    letters = [
        F.chr(F.pmod(_hex_part(F.col("_w"), 1 + 4 * i, 4), F.lit(26)) + 97) for i in range(WORD_LETTERS)
    ]
    return spelled.withColumn("word", F.concat(*letters)).drop("_w")


def gen_words(spark: SparkSession, n: int, dict_size: int = DICT_SIZE, seed: int = 1) -> DataFrame:
    return words_for(spark.range(n), "id", dict_size, seed).select("word")


def kv_rows_for(ids: DataFrame, id_col: str = "id", seed: int = 1) -> DataFrame:
    """``k, name, value, flag`` per id: ``item_<k>``, uniform in [0, 1), a fair coin."""
    k = F.col(id_col)
    digest = _digest("kv", seed, k)
    return ids.select(
        k.alias("k"),
        F.concat(F.lit("item_"), k.cast("string")).alias("name"),
        (_hex_part(digest, 1, 12).cast("double") / F.lit(float(16**12))).alias("value"),
        (F.pmod(_hex_part(digest, 13, 4), F.lit(2)) == 1).alias("flag"),
    )


def gen_kv_rows(spark: SparkSession, n: int, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """``n`` rows in ``shards`` contiguous ranges, one file each when written."""
    return kv_rows_for(spark.range(0, n, 1, shards), "id", seed)


def gen_backfill_stream(edges: DataFrame, start: int, step: int, out_dir: str) -> None:
    """Edges in ``commit_id=N`` folders: commit 0 holds the first ``start`` edges, the others ``step``.

    Ranges of ids keep the files of a commit few, while a large first commit is still many files.
    """
    marked = edges.withColumn("commit_id", batch_of_id("id", start, step))
    marked.repartitionByRange("id").write.mode("overwrite").partitionBy("commit_id").parquet(out_dir)


def gen_marked_edges(edges: DataFrame, start: int, step: int, out_dir: str, files: int = SHARDS) -> None:
    """Edges ``id, u, v`` as JSON lines in order of their id, a mark after the last one of each commit."""
    here, after = batch_of_id("id", start, step), batch_of_id(F.col("id") + 1, start, step)
    line = F.to_json(F.struct("id", "u", "v"))
    lines = F.when(here < after, F.array(line, F.lit(COMMIT_MARK))).otherwise(F.array(line))
    placed = edges.repartitionByRange(files, "id").sortWithinPartitions("id")
    placed.select(F.explode(lines).alias("value")).write.mode("overwrite").text(out_dir)
