import random

import pytest
from pyspark.sql import functions as F

from tallyflow.operators.joins import edge_copies, join_edges_outflow
from tallyflow.plans import graph
from tests.models import float_pagerank, integer_pagerank, list_pagerank

GRAPHS = {
    "duplicate, self-loop, sink, source": [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (4, 5), (2, 2)],
    "two components": [(1, 2), (2, 1), (10, 11), (11, 12)],
    "single edge": [(7, 8)],
    "single self-loop": [(7, 7)],
    "empty": [],
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "u BIGINT, v BIGINT").repartition(3)


def ranks(df):
    rows = df.collect()
    assert len({r["vertex"] for r in rows}) == len(rows)
    return {r["vertex"]: r["rank"] for r in rows}


def random_graph(seed, hub=False):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(150)]
    if hub:  # one source with a third of the edges, and one edge many times over
        edges += [(5, 100 + i) for i in range(80)] + [(6, 7)] * 60
    return edges


@pytest.mark.parametrize("name", GRAPHS)
def test_small_graphs(spark, name):
    edges = GRAPHS[name]
    assert ranks(graph.pagerank(frame(spark, edges), 5)) == integer_pagerank(edges, 5)
    assert ranks(graph.pagerank_neighbour_list(frame(spark, edges), 3)) == list_pagerank(edges, 3)


def test_golden(spark):
    got = ranks(graph.pagerank(frame(spark, GRAPHS["duplicate, self-loop, sink, source"]), 5))
    assert got == {1: 6365, 2: 7740, 3: 6384, 4: 1000, 5: 1416}


@pytest.mark.parametrize("steps", [0, 1, 7])
def test_hot_source_is_salted_and_exact(spark, steps):
    edges = random_graph(steps, hub=True)
    placed = graph.place_graph(edge_copies(frame(spark, edges)), frame(spark, edges))
    assert placed.fans is not None
    hot = {r["u"]: r["_fan"] for r in placed.fans.collect()}
    assert hot[5] > 1
    salts = placed.edges.where("u = 5").select("_salt").distinct().count()
    assert salts > 1
    placed.release()
    assert ranks(graph.pagerank(frame(spark, edges), steps)) == integer_pagerank(edges, steps)
    assert ranks(graph.pagerank_neighbour_list(frame(spark, edges), steps)) == list_pagerank(edges, steps)


def test_unsalted_graph(spark):
    edges = [(i, (i * 7 + 1) % 200) for i in range(200)] + [(i, (i * 3 + 2) % 200) for i in range(200)]
    placed = graph.place_graph(edge_copies(frame(spark, edges)))
    assert placed.fans is None
    placed.release()
    assert ranks(graph.pagerank(frame(spark, edges), 6)) == integer_pagerank(edges, 6)


def test_invariants(spark):
    edges = random_graph(3)
    got = ranks(graph.pagerank(frame(spark, edges), 5))
    assert set(got) == {x for e in edges for x in e}
    assert min(got.values()) >= 1000
    assert got == ranks(graph.pagerank(frame(spark, edges[::-1]), 5))


def test_float(spark):
    edges = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (4, 5)]
    got = ranks(graph.pagerank_float(frame(spark, edges), 5))
    want = {1: 1.756855592966704, 2: 1.113025314877167, 3: 1.602846364883402, 4: 0.218181818181818, 5: 0.309090909090909}
    assert got == pytest.approx(want, abs=1e-9)
    hub = random_graph(9, hub=True)
    assert ranks(graph.pagerank_float(frame(spark, hub), 4)) == pytest.approx(float_pagerank(hub, 4), abs=1e-9)


def exchanges_outside_caches(df):
    """Shuffles of the plan, without those that filled a cache before."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found, cached_at = 0, None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if cached_at is not None and indent > cached_at:
            continue
        cached_at = None
        if "InMemoryRelation" in line:
            cached_at = indent
        found += "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line
    return found, plan


def test_loop_shuffles_once_a_step_and_never_the_edges(spark):
    edges = [(i, (i * 7 + 1) % 200) for i in range(200)]
    placed = graph.place_graph(edge_copies(frame(spark, edges)))
    start = placed.vertices.selectExpr("vertex", "degree", "6000L AS rank")
    update = F.coalesce("inflow", F.lit(0).cast("bigint"))
    for steps in (1, 2, 4):
        count, plan = exchanges_outside_caches(graph._iterate(placed, start, steps, F.col("rank"), update))
        assert count == steps
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    placed.release()


def test_edges_outflow_keeps_copies_as_weight(spark):
    edges = random_graph(4, hub=True)
    flows = spark.createDataFrame([(u, u * 10) for u in {e[0] for e in edges}], "u BIGINT, outflow BIGINT")
    rows = join_edges_outflow(frame(spark, edges), flows).collect()
    assert sum(r["copies"] for r in rows) == len(edges)
    assert all(r["outflow"] == r["u"] * 10 for r in rows)
    assert len(rows) == len(set(edges))


def test_edges_are_read_twice_for_sizes_and_join(spark, tmp_path):
    """Once to note the sizes of the sources, once to be joined; the second plan reads what was noted."""
    path = str(tmp_path / "edges-in")
    frame(spark, random_graph(5, hub=True)).write.parquet(path)
    flows = spark.createDataFrame([(u, u) for u in range(200)], "u BIGINT, outflow BIGINT")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sizes", "sizes")
    try:
        joined = join_edges_outflow(spark.read.schema("u BIGINT, v BIGINT").parquet(path), flows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<u:bigint,v:bigint>") == 1 and "ReadSchema: struct<u:bigint,size:bigint>" in plan
    assert len(jobs.getJobIdsForGroup("sizes")) <= 2  # the write of the sizes: its shuffle and its result
    assert joined.count() == len(set(random_graph(5, hub=True)))
    assert join_edges_outflow(frame(spark, []), flows).count() == 0
