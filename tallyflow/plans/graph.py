"""PageRank over an edge list, as a loop of DataFrame joins and sums.

Layout, fixed once before the loop:

* ``placed``: distinct edges with their number of copies, hash-partitioned and sorted by source.  Where
  a source has very many targets, its edges are spread over salts.  It is persisted, so no step shuffles or sorts
  the edges again.
* ``vertices``: one row per vertex with its out-degree, hash-partitioned by vertex and persisted.

A step shuffles the partially summed inflows, and nothing else: flows meet the edges where the ranks
already are (with hot sources, one row per source and salt is shuffled to them as well).  The loop is
one lazy plan of ``CHECKPOINT_EVERY`` steps at a time, written to the reliable checkpoint, after which
the persisted frames are released.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.functions.exprs import whole_div
from tallyflow.operators.joins import SALT, edge_copies, fan_outs, fanned, join_links_ranks, link_degrees, salted
from tallyflow.session import settle, shuffle_width

# Fixed values of the integer ranks: 1000 is one unit, damping 5/6, six units to start with.
UNIT = 1000
START_RANK = 6000
DAMPING_MUL = 5
DAMPING_DIV = 6

CHECKPOINT_EVERY = 5


@dataclass
class PlacedGraph:
    """Edges and vertices laid out for a ranking loop."""

    vertices: DataFrame  # vertex, degree
    edges: DataFrame  # u, [_salt,] v, copies
    fans: DataFrame | None  # u, _fan of the hot sources; None where there are none

    def release(self) -> None:
        for frame in (self.vertices, self.edges, self.fans):
            if frame is not None:
                frame.unpersist()


def place_graph(merged: DataFrame, raw: DataFrame | None = None) -> PlacedGraph:
    """Lay out weighted edges ``u, v, copies`` (unique in ``u, v``).

    ``raw`` are the same edges before their copies were merged, if at hand: the degrees then come
    from a pass that combines to one row per vertex and task, without shuffling the edges first.
    """
    spark = merged.sparkSession
    width = shuffle_width(spark)
    counted = merged if raw is None else raw.withColumn("copies", F.lit(1).cast("bigint"))
    ends = counted.select(F.expr("stack(2, u, copies, v, 0L)").alias("vertex", "degree"))
    vertices = (
        ends.groupBy("vertex")
        .agg(F.sum("degree").alias("degree"))
        .repartition(width, "vertex")
        .sortWithinPartitions("vertex")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    fans = fan_outs(vertices.withColumnRenamed("vertex", "u"), "u", "degree").persist(StorageLevel.MEMORY_AND_DISK)
    place = ["u", SALT]
    if fans.isEmpty():
        fans.unpersist()
        fans, place = None, ["u"]
    spread = merged if fans is None else salted(merged, "u", fans, "v")
    edges = spread.repartition(width, *place).sortWithinPartitions(*place).persist(StorageLevel.MEMORY_AND_DISK)
    # Filled now: only a cache whose adaptive plan is final tells the planner how it is partitioned
    # and sorted.  Planned before that, every step would shuffle and sort the edges again.
    edges.count()
    return PlacedGraph(vertices, edges, fans)


def _inflow(graph: PlacedGraph, ranks: DataFrame, outflow: Column) -> DataFrame:
    """``vertex, inflow``: what each vertex gets when every source sends ``outflow`` along each edge."""
    sources = ranks.where(F.col("degree") > 0).select(F.col("vertex").alias("u"), outflow.alias("outflow"))
    if graph.fans is None:
        flows = graph.edges.join(sources.hint("merge"), "u")
    else:
        flows = graph.edges.join(fanned(sources, "u", graph.fans).hint("merge"), ["u", SALT])
    return flows.groupBy(F.col("v").alias("vertex")).agg(
        F.sum(F.col("outflow") * F.col("copies")).alias("inflow")
    )


def _iterate(
    graph: PlacedGraph, ranks: DataFrame, steps: int, outflow: Column, update: Column, history: bool = False
) -> DataFrame:
    """``steps`` rounds over ``vertex, degree, rank``; with ``history``, every rank is kept in ``ranks``."""
    for step in range(1, steps + 1):
        inflow = _inflow(graph, ranks.select("vertex", "degree", "rank"), outflow).hint("merge")
        if history:
            joined = ranks.drop("rank").join(inflow, "vertex", "left").withColumn("rank", update)
            ranks = joined.select("vertex", "degree", "rank", F.concat("ranks", F.array("rank")).alias("ranks"))
        else:
            ranks = graph.vertices.join(inflow, "vertex", "left").select("vertex", "degree", update.alias("rank"))
        if step % CHECKPOINT_EVERY == 0 and step < steps:
            ranks = settle(ranks)
    return ranks


def _looped(
    merged: DataFrame,
    body: Callable[[PlacedGraph], DataFrame],
    raw: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = settle,
) -> DataFrame:
    """Run ``body`` on the placed graph; ``keep`` must store its outcome before the caches go."""
    graph = place_graph(merged, raw)
    try:
        return keep(body(graph))
    finally:
        graph.release()


def integer_flow(rank: Column | str, degree: Column | str) -> Column:
    """What a vertex sends along each of its edges."""
    rank, degree = (F.col(c) if isinstance(c, str) else c for c in (rank, degree))
    sent = whole_div(rank * F.lit(DAMPING_MUL).cast("bigint"), degree * F.lit(DAMPING_DIV).cast("bigint"))
    return F.when(degree > 0, sent).otherwise(F.lit(0).cast("bigint"))


def _integer_loop(
    merged: DataFrame,
    steps: int,
    raw: DataFrame | None = None,
    history: bool = False,
    keep: Callable[[DataFrame], DataFrame] = settle,
) -> DataFrame:
    update = F.coalesce("inflow", F.lit(0).cast("bigint")) + F.lit(UNIT).cast("bigint")

    def body(graph: PlacedGraph) -> DataFrame:
        start = graph.vertices.withColumn("rank", F.lit(START_RANK).cast("bigint"))
        if history:
            start = start.withColumn("ranks", F.array("rank"))
        ranks = _iterate(graph, start, steps, integer_flow("rank", "degree"), update, history)
        return ranks.select("vertex", "degree", "ranks") if history else ranks.select("vertex", "rank")

    return _looped(merged, body, raw, keep)


def pagerank_states(
    copies: DataFrame, steps: int = 5, keep: Callable[[DataFrame], DataFrame] = settle
) -> DataFrame:
    """``vertex, degree, ranks`` with the integer rank before the first and after every step."""
    return _integer_loop(copies, steps, history=True, keep=keep)


def pagerank_weighted(copies: DataFrame, steps: int = 5) -> DataFrame:
    """Integer PageRank of weighted edges ``u, v, copies`` (unique in ``u, v``) as ``vertex, rank``."""
    return _integer_loop(copies, steps)


def pagerank(edges: DataFrame, steps: int = 5) -> DataFrame:
    """Integer PageRank of a multigraph ``u, v``: every copy of an edge carries flow.

    Vertices without an in-edge keep one unit; vertices without an out-edge keep what they get.
    """
    return _integer_loop(edge_copies(edges), steps, edges.select("u", "v"))


def pagerank_neighbour_list(edges: DataFrame, steps: int = 5) -> DataFrame:
    """The variant on distinct edges that rounds twice: per target, and after damping the sum.

    Only sources hold a rank to send; a vertex that is a target alone appears once flow reaches it.
    """
    distinct = edges.select("u", "v").distinct().withColumn("copies", F.lit(1).cast("bigint"))
    share = whole_div("rank", "degree")
    damped = whole_div(
        F.coalesce("inflow", F.lit(0).cast("bigint")) * F.lit(DAMPING_MUL).cast("bigint"),
        F.lit(DAMPING_DIV).cast("bigint"),
    ) + F.lit(UNIT).cast("bigint")

    def body(graph: PlacedGraph) -> DataFrame:
        start = graph.vertices.withColumn("rank", F.lit(START_RANK).cast("bigint"))
        ranks = _iterate(graph, start, steps, share, damped)
        shown = ranks if steps else ranks.where("degree > 0")
        return shown.select("vertex", "rank")

    return _looped(distinct, body)


def pagerank_float(edges: DataFrame, steps: int = 5, reset: float = 1 / 6) -> DataFrame:
    """PageRank in doubles, scaled so that the ranks sum to the number of vertices."""
    outflow = F.col("rank") / F.col("degree")
    update = F.lit(reset) + F.lit(1.0 - reset) * F.coalesce("inflow", F.lit(0.0))

    def body(graph: PlacedGraph) -> DataFrame:
        start = graph.vertices.withColumn("rank", F.lit(1.0))
        return _iterate(graph, start, steps, outflow, update).select("vertex", "rank")

    unscaled = _looped(edge_copies(edges), body, edges.select("u", "v"))
    scale = unscaled.agg((F.count(F.lit(1)) / F.sum("rank")).alias("scale"))
    return unscaled.select("vertex", (F.col("rank") * scale.scalar()).alias("rank"))


def udtf_contribs(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per neighbour: ``vertex, contribution`` with the rank shared out evenly, rounded down.

    ``links`` comes in chunks of neighbours, so the degree is summed over the chunks of a source, once for the shares and
    for the hot sources.
    """
    degrees = link_degrees(links)
    sources = degrees[0].join(ranks, "u").select("u", whole_div("rank", "degree").alias("share"))
    return join_links_ranks(links, sources, degrees).select(F.explode("neighbours").alias("vertex"), F.col("share").alias("contribution"))
