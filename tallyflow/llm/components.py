"""Connected components of a large graph: alternating large and small stars, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyflow.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge (``a``, ``b``); root is the smallest node that is reachable.

    Edges may repeat, run either way or be loops; edges with a null end are left out.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    e = stage(e.distinct(), "links")
    state = _state(e)
    while True:
        both = e.union(e.select("b", "a"))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(nearest, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(least, "b").where("a <> m").select("m", F.col("a").alias("b")).union(least.select("m", "b"))
        e = stage(down.select(F.col("m").alias("a"), "b").distinct(), "links")
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select("a", "a").distinct())


def _state(e: DataFrame) -> tuple[int, int | None]:
    """Changes whenever the edges do."""
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]
