"""Joins.  Catalyst picks the strategy; only joins against a hot key get explicit salting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from tallyflow.operators.ordered import next_value, ranked_histogram
from tallyflow.session import scratch_path, shuffle_width

SALT = "_salt"
FAN = "_fan"


def join_inner_equi(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, on, "inner")


def join_full_outer(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, on, "full")


def join_left_anti(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, on, "left_anti")


def noted_sizes(sizes: DataFrame, size: str) -> tuple[DataFrame, int]:
    """``sizes`` written once, and the total that was observed on the way: its input is read no second time."""
    path, seen = scratch_path(sizes.sparkSession, "sizes"), Observation()
    sizes.observe(seen, F.sum(size).alias("total")).write.parquet(path)
    return sizes.sparkSession.read.schema(sizes.schema).parquet(path), seen.get.get("total") or 0


def fan_outs(sizes: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """``key, _fan`` for the keys that hold too much for one task.

    ``sizes`` has one row per key; ``total`` is their sum, where it is known.  A key counts as hot above ``total / (4 * width)`` rows, so there
    are fewer than ``4 * width`` hot keys: small enough to broadcast, whatever the data.
    """
    width = shuffle_width(sizes.sparkSession)
    if total is None:
        total = sizes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("t")).first()["t"]
    share = max(1, -(-total // (4 * width)))
    return sizes.where(F.col(size) > share).select(
        F.col(key), F.ceil(F.col(size) / F.lit(share)).cast("int").alias(FAN)
    )


def salted(big: DataFrame, key: str, fans: DataFrame, spread: str) -> DataFrame:
    """Give each row of a hot key one of ``_fan`` salts, chosen by ``spread``."""
    out = big.join(F.broadcast(fans), key, "left")
    fan = F.coalesce(FAN, F.lit(1))
    return out.withColumn(SALT, F.pmod(F.xxhash64(spread), fan).cast("int")).drop(FAN)


def fanned(small: DataFrame, key: str, fans: DataFrame) -> DataFrame:
    """Repeat each row of a hot key once per salt (below ``8 * width`` extra rows in all)."""
    out = small.join(F.broadcast(fans), key, "left")
    salts = F.sequence(F.lit(0), F.coalesce(FAN, F.lit(1)) - 1)
    return out.withColumn(SALT, F.explode(salts)).drop(FAN)


def edge_copies(edges: DataFrame) -> DataFrame:
    """``u, v, copies``: a multigraph edge and how often it occurs."""
    return edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("copies"))


def join_edges_outflow(edges: DataFrame, outflow: DataFrame) -> DataFrame:
    """``u, v, copies, outflow``: every distinct edge with the flow of its source.

    Copies of an edge stay merged, so a much-repeated edge is one row of weight ``copies``; a source
    with very many targets is spread over several tasks.
    """
    copies = edge_copies(edges)
    sizes, total = noted_sizes(edges.groupBy("u").agg(F.count(F.lit(1)).alias("size")), "size")
    fans = fan_outs(sizes, "u", "size", total)
    return (
        salted(copies, "u", fans, "v")
        .join(fanned(outflow, "u", fans), ["u", SALT])
        .select("u", "v", "copies", "outflow")
    )


def link_degrees(links: DataFrame) -> tuple[DataFrame, int]:
    """``u, degree`` of neighbour lists in chunks, written once, and the number of links."""
    return noted_sizes(links.groupBy("u").agg(F.sum("degree_part").alias("degree")), "degree")


def join_links_ranks(links: DataFrame, ranks: DataFrame, degrees: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Neighbour lists (in chunks, see ``neighbour_list``) with the rank of their source.

    ``degrees`` are those of ``link_degrees``, where they are at hand.
    """
    sizes, total = degrees or link_degrees(links)
    fans = fan_outs(sizes, "u", "degree", total)
    return salted(links, "u", fans, "chunk").join(fanned(ranks, "u", fans), ["u", SALT]).drop(SALT)


def join_self_key_time(edges: DataFrame) -> DataFrame:
    """Self-join on ``(id, ts)``: the identity where ``id`` is unique, and a check that it is."""
    right = edges.select("id", "ts", F.lit(1).alias("_matched"))
    return edges.join(right, ["id", "ts"]).drop("_matched")


def tag_bounds(inputs: DataFrame, outputs: DataFrame, by: str, key: str, time: str) -> DataFrame:
    """Inputs and outputs in one frame, ready for ``lower_bound_window``.

    Outputs equal in all of ``by, key, time`` are merged (earliest engine time, unknown first).  At
    equal position an input precedes an output, for an output at exactly ``(key, time)`` does match.
    """
    has_engine = "engine_time" in outputs.columns
    engine = F.col("engine_time") if has_engine else F.lit(None).cast("bigint")
    merged = outputs.groupBy(by, key, time).agg(
        F.min(F.struct(engine.isNotNull().alias("known"), engine.alias("at"))).alias("_engine")
    )
    extra = [c for c in inputs.columns if c not in (by, key, time)]
    left = inputs.select(by, key, time, F.struct(*[F.col(c) for c in extra] or [F.lit(0)]).alias("_row")).withColumn(
        "_side", F.lit(0)
    )
    right = merged.select(
        by,
        key,
        time,
        F.lit(1).alias("_side"),
        F.struct(F.col(key).alias("count"), F.col(time).alias("time"), F.col("_engine.at").alias("engine_time")).alias(
            "_out"
        ),
    )
    return left.unionByName(right, allowMissingColumns=True)


def lower_bound_window(tagged: DataFrame, by: str, key: str, time: str) -> DataFrame:
    """Each tagged row with ``matched``: the first output at or after it in ``(key, time)``."""
    return next_value(tagged, "_out", [key, time, "_side"], [by], "matched")


def join_lower_bound(inputs: DataFrame, outputs: DataFrame, by: str, key: str, time: str) -> DataFrame:
    """For each input the smallest output with ``(key, time) >=`` its own, per ``by``.

    Adds ``out_count, out_time, engine_time``, all null where no output accounts for the input.
    Inputs must be unique in ``(by, key)``, as numbered occurrences are.
    """
    extra = [c for c in inputs.columns if c not in (by, key, time)]
    filled = lower_bound_window(tag_bounds(inputs, outputs, by, key, time), by, key, time)
    return filled.where(F.col("_side") == 0).select(
        by,
        key,
        time,
        *[F.col(f"_row.{c}").alias(c) for c in extra],
        F.col("matched.count").alias("out_count"),
        F.col("matched.time").alias("out_time"),
        F.col("matched.engine_time").alias("engine_time"),
    )


def join_lookup_missing(inputs: DataFrame, outputs: DataFrame, by: str) -> DataFrame:
    """Inputs whose word never shows up in the outputs.

    Occurrences are counted per word first, so a hot word is one row in the join.
    """
    per_word = inputs.groupBy(by).agg(F.count(F.lit(1)).alias("inputs"))
    return per_word.join(outputs.select(by).distinct(), by, "left_anti")


def compare_sorted(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """One row: how many positions of the two sorted columns hold the same value.

    A value fills one interval of positions on each side, so the equal positions are the overlaps of
    those intervals, summed over the values both sides have.  No row is given an index.
    ``common`` is the size of the multiset intersection.
    """
    left = ranked_histogram(a.select(col), col).select(col, F.col("n").alias("n_a"), F.col("upto").alias("to_a"))
    right = ranked_histogram(b.select(col), col).select(col, F.col("n").alias("n_b"), F.col("upto").alias("to_b"))
    overlap = F.least("to_a", "to_b") - F.greatest(F.col("to_a") - F.col("n_a"), F.col("to_b") - F.col("n_b"))
    return (
        left.join(right, col, "full")
        .agg(
            F.sum(F.when(F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), F.greatest(overlap, F.lit(0)))).alias("equal"),
            F.coalesce(F.sum("n_a"), F.lit(0)).alias("size_a"),
            F.coalesce(F.sum("n_b"), F.lit(0)).alias("size_b"),
            F.sum(F.when(F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), F.least("n_a", "n_b"))).alias("common"),
        )
        .select(
            F.coalesce("equal", F.lit(0)).alias("equal"),
            "size_a",
            "size_b",
            F.coalesce("common", F.lit(0)).alias("common"),
            (F.coalesce("equal", F.lit(0)) / F.nullif(F.col("size_a"), F.lit(0))).alias("equal_fraction"),
        )
    )
