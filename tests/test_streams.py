import random
import re

import pytest
from pyspark.sql import functions as F

from tallyflow.sinks import logs, topics as sinks
from tallyflow.session import scratch_path
from tallyflow.sources.files import scan_event_time_table
from tallyflow.sources.generators import gen_backfill_stream
from tallyflow.streaming import commits, graph
from tallyflow.streaming.wordcount import stream_wordcount, write_changelog
from tests.models import integer_pagerank


def edge_frame(spark, edges):
    return spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(edges)], "id BIGINT, u BIGINT, v BIGINT")


def part_edges(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    return [tuple(r) for r in rows]


def ranks_at(spark, state, commit):
    return {r["vertex"]: r["rank"] for r in graph.ranks_at(spark, state, commit).collect()}


def test_backfill_is_right_at_every_commit(spark):
    edges = part_edges(spark)
    state = graph.backfill_pagerank(edge_frame(spark, edges), scratch_path(spark, "bf"), 4500, 500)
    for commit, seen in enumerate((4500, 5000, 5500, 6000)):
        upto = graph.graph_upto(spark, state, commit)
        assert upto.agg(F.sum("copies")).first()[0] == seen
        assert ranks_at(spark, state, commit) == integer_pagerank(edges[:seen], 5)
    changes = spark.read.parquet(f"{state}/changes/commit=3").collect()
    table = dict(ranks_at(spark, state, 2))
    for r in sorted(changes, key=lambda r: r["diff"]):
        if r["diff"] < 0:
            assert table.pop(r["vertex"]) == r["rank"]
        else:
            table[r["vertex"]] = r["rank"]
    assert table == ranks_at(spark, state, 3)
    assert len(changes) == 20


@pytest.mark.parametrize("rows", [100_000, 0])  # changes are broadcast, or both sides are shuffled
def test_repeated_commit_and_folding(spark, monkeypatch, rows):
    monkeypatch.setattr(logs, "FOLD_EVERY", 2)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
    rng = random.Random(1)
    edges = [(rng.randrange(12 + i // 4), rng.randrange(12 + i // 4)) for i in range(60)]
    state = scratch_path(spark, "state")
    for commit in range(4):
        batch = spark.createDataFrame(edges[commit * 15 : commit * 15 + 15], "u BIGINT, v BIGINT")
        graph.apply_commit(batch, commit, state, 2)
        if commit == 1:
            graph.apply_commit(batch, commit, state, 2)  # the same commit again, as after a failure
        assert ranks_at(spark, state, commit) == integer_pagerank(edges[: commit * 15 + 15], 2)
    versions = graph.rank_versions(spark, state, 3).collect()
    for commit in range(4):
        assert {r["vertex"]: r["rank"] for r in versions if r["commit"] == commit} == ranks_at(spark, state, commit)


def test_following_changes_equals_ranking_again(spark):
    """Hub, repeated edge, self-loop, new vertices, and a commit that changes nothing but a degree."""
    rng = random.Random(2)
    first = [(5, 100 + i) for i in range(40)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(120)]
    commits_ = [first, [(5, 5), (5, 101), (5, 101), (900, 5)], [(901, 902)], [(902, 901), (7, 7)], [(5, 300)]]
    state, seen = scratch_path(spark, "state"), []
    for commit, edges in enumerate(commits_):
        seen += edges
        graph.apply_commit(spark.createDataFrame(edges, "u BIGINT, v BIGINT"), commit, state, 5)
        assert ranks_at(spark, state, commit) == integer_pagerank(seen, 5)
    # an isolated edge touches its two ends only
    assert spark.read.parquet(f"{state}/states/commit=2").count() == 2


def test_a_large_commit_shuffles_its_edges_once_for_all_steps(spark, monkeypatch):
    """Commits with many edges, and with few that change many vertices, rank again; they log what a small commit logs."""
    rng = random.Random(3)
    first = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)] + [(0, 100 + i) for i in range(30)] + [(800, 801)]
    batches = [first, [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(0, 900)], [(0, 901)], [(700, 701)]]
    ranked, real = [], graph.pagerank_states
    monkeypatch.setattr(graph, "pagerank_states", lambda *a: ranked.append(1) or real(*a))
    logged = {}
    for rows in (10, 100_000):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
        state, seen = scratch_path(spark, "state"), []
        ranked.clear()
        for commit, edges in enumerate(batches):
            seen += edges
            graph.apply_commit(spark.createDataFrame(edges, "u BIGINT, v BIGINT"), commit, state, 5)
            assert ranks_at(spark, state, commit) == integer_pagerank(seen, 5)
            changes = spark.read.parquet(f"{state}/changes/commit={commit}")
            logged[rows, commit] = sorted(map(tuple, changes.collect()))
        assert len(ranked) == (3 if rows == 10 else 1)  # the isolated edge is followed
        assert spark.read.parquet(f"{state}/states/commit=1").where("vertex in (800, 801)").isEmpty()
    assert all(logged[10, c] == logged[100_000, c] for c in range(4))


def test_old_edges_are_not_shuffled_by_a_commit(spark):
    state = scratch_path(spark, "state")
    graph.apply_commit(spark.createDataFrame([(i, i + 1) for i in range(50)], "u BIGINT, v BIGINT"), 0, state, 2)
    delta = spark.createDataFrame([(3, 9, 1)], "u BIGINT, v BIGINT, copies BIGINT")
    edges = graph._log(spark, state, "edges", 0)
    flows = spark.createDataFrame([(3, 5000, 2500)], "u BIGINT, sent_before BIGINT, sent BIGINT")
    plan = graph._changed_inflow(delta, edges, flows, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_commit_reads_the_buckets_of_its_changes_only(spark, monkeypatch):
    state = scratch_path(spark, "state")
    chain = [(i, i + 1) for i in range(200)]
    graph.apply_commit(spark.createDataFrame(chain, "u BIGINT, v BIGINT"), 0, state, 2)
    bucket = {r["v"]: r["b"] for r in spark.range(300).selectExpr("id v").withColumn("b", logs.bucket_of(["v"])).collect()}
    real, reads = logs.read, []

    def noted(session, path, schema, commit, buckets=None):
        found = real(session, path, schema, commit, buckets)
        reads.append((path.rsplit("/", 1)[1], buckets, found.inputFiles()))
        return found

    monkeypatch.setattr(logs, "read", noted)
    graph.apply_commit(spark.createDataFrame([(3, 250)], "u BIGINT, v BIGINT"), 1, state, 2)
    # Step 1 reads the source's bucket, step 2 also those of the two targets; the states at the end the same.
    steps = [{bucket[3]}, {bucket[3], bucket[4], bucket[250]}]
    want = [steps[0], steps[0], steps[1], steps[1]]
    assert [set(buckets) for _, buckets, _ in reads[:4]] == want and [kind for kind, _, _ in reads] == ["states", "edges"] * 2 + ["states"]
    for _, buckets, files in reads:
        assert files and {int(re.search(r"key_bucket=(\d+)", f)[1]) for f in files} <= set(buckets)
    monkeypatch.undo()
    assert ranks_at(spark, state, 1) == integer_pagerank([*chain, (3, 250)], 2)


def test_a_commit_of_one_edge_is_few_jobs_of_one_query(spark):
    folder, edges = scratch_path(spark, "jobs"), part_edges(spark)
    gen_backfill_stream(edge_frame(spark, edges), len(edges) - 2, 1, f"{folder}/staged")
    inbox, jobs = f"{folder}/inbox", []
    arrivals = commits.published(spark, f"{folder}/staged", inbox)
    next(arrivals)
    source = spark.readStream.schema(graph.EDGE_STREAM_SCHEMA).parquet(inbox).select("u", "v")
    query = graph.stream_pagerank(source, f"{folder}/state", f"{folder}/cp", 5, commits.ON_ARRIVAL)
    try:
        query.processAllAvailable()
        for _ in arrivals:
            before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId)))
            query.processAllAvailable()
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) - before)
    finally:
        query.stop()
    assert len(jobs) == 2 and all(0 < n < 20 for n in jobs), jobs
    assert ranks_at(spark, f"{folder}/state", 2) == integer_pagerank(edges, 5)


def test_failing_commit_is_repeated(spark, monkeypatch):
    edges = [(i % 5, (i * 3) % 8) for i in range(40)]
    folder = scratch_path(spark, "fail")
    gen_backfill_stream(edge_frame(spark, edges), 20, 10, f"{folder}/staged")
    real, failures = graph.spread_changes, []

    def fragile(*args):
        if not failures:
            failures.append(1)
            raise RuntimeError("lost after the edges were written")
        return real(*args)

    monkeypatch.setattr(graph, "spread_changes", fragile)

    for _ in commits.published(spark, f"{folder}/staged", f"{folder}/inbox"):
        source = spark.readStream.schema(graph.EDGE_STREAM_SCHEMA).parquet(f"{folder}/inbox")
        start = lambda c: graph.stream_pagerank(source.select("u", "v"), f"{folder}/state", c, 4)  # noqa: E731, B023
        try:
            commits.persist_and_resume(start, f"{folder}/checkpoint")
        except Exception:
            assert failures
            commits.persist_and_resume(start, f"{folder}/checkpoint")
    assert failures
    for commit, seen in enumerate((20, 30, 40)):
        assert ranks_at(spark, f"{folder}/state", commit) == integer_pagerank(edges[:seen], 4)


def test_rows_before_finds_null_keys(spark):
    log = scratch_path(spark, "log")
    schema = "word STRING, count BIGINT"
    sinks.sink_upsert_keyed(spark.createDataFrame([(None, 1), ("a", 4)], schema), log, ["word"], 0)
    batch = spark.createDataFrame([(None, 2)], schema)
    assert [tuple(r) for r in sinks.rows_before(batch, log, ["word"], 1).collect()] == [(None, 1)]


def test_rows_before_read_a_bounded_tail(spark, monkeypatch):
    """However many commits there were: a snapshot and fewer than FOLD_EVERY folders, of the buckets asked for."""
    monkeypatch.setattr(logs, "FOLD_EVERY", 3)
    path, schema, table = scratch_path(spark, "log"), "word STRING, count BIGINT", {}
    for commit in range(11):
        rows = [(w, commit) for w in ("abc"[commit % 3], f"w{commit}")]
        batch = spark.createDataFrame(rows, schema)
        before = {r["word"]: r["count"] for r in sinks.rows_before(batch, path, ["word"], commit).collect()}
        assert before == {w: table[w] for w, _ in rows if w in table}
        sinks.sink_upsert_keyed(batch, path, ["word"], commit)
        table.update(rows)
    asked = spark.createDataFrame([(w, 0) for w in table], schema)
    files = logs.read(spark, path, schema, 10, None).inputFiles()
    folders = {re.search(r"(log[^/]*)/(commit=\d+)", f).groups() for f in files}
    assert {c for root, c in folders if root.endswith("-folded")} == {"commit=8"} and len(folders) == 1 + 2
    assert {r["word"]: r["count"] for r in sinks.rows_before(asked, path, ["word"], 11).collect()} == table
    one = logs.read(spark, path, schema, 10, logs.bucket_list(asked.where("word = 'a'").agg(logs.buckets_in(["word"])).first()[0]))
    assert len({re.search(r"key_bucket=\d+", f)[0] for f in one.inputFiles()}) <= 1
    assert {r["word"]: r["count"] for r in sinks.read_upserted(spark.read.parquet(path), ["word"]).collect()} == table


def test_a_commit_is_one_batch_of_one_running_query(spark):
    folder = scratch_path(spark, "one")
    gen_backfill_stream(edge_frame(spark, [(i, i) for i in range(30)]), 12, 6, f"{folder}/staged")
    seen = []

    def run():
        sdf = spark.readStream.schema(graph.EDGE_STREAM_SCHEMA).parquet(f"{folder}/inbox")
        note = lambda batch, n: seen.append((n, sorted(r["id"] for r in batch.collect())))
        writer = sdf.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(**commits.ON_ARRIVAL)
        return writer.foreachBatch(note).start()

    done = commits.explicit_commit(spark, f"{folder}/staged", f"{folder}/inbox", run)
    assert not done.isActive and done.exception() is None
    assert seen == [(0, list(range(12))), (1, list(range(12, 18))), (2, list(range(18, 24))), (3, list(range(24, 30)))]
    assert {str(p.runId) for p in done.recentProgress} == {str(done.runId)}
    assert {p.batchId for p in done.recentProgress if p.numInputRows} == {0, 1, 2, 3}


def test_changelog_is_right_at_every_commit(spark):
    words = ["a", "b", "a", "c", "a", "b", "d", "a", "a", "a", "b", "d"]
    frame = spark.createDataFrame(list(enumerate(words)), "id BIGINT, word STRING")
    folder = scratch_path(spark, "cl")
    gen_backfill_stream(frame, 6, 3, f"{folder}/staged")

    def run():
        sdf = spark.readStream.schema("id BIGINT, word STRING, commit_id BIGINT").parquet(f"{folder}/inbox")
        return write_changelog(stream_wordcount(sdf), folder, f"{folder}/checkpoint", trigger=commits.ON_ARRIVAL)

    commits.explicit_commit(spark, f"{folder}/staged", f"{folder}/inbox", run)
    table = {}
    for commit, upto in enumerate((6, 9, 12)):
        rows = spark.read.parquet(f"{folder}/changes/commit={commit}").collect()
        for r in sorted(rows, key=lambda r: r["diff"]):
            if r["diff"] < 0:
                assert table.pop(r["word"]) == r["count"]
            else:
                table[r["word"]] = r["count"]
        assert table == {w: words[:upto].count(w) for w in set(words[:upto])}


def test_ascending_watermark_drops_nothing(spark):
    folder = scratch_path(spark, "wm")
    edges = edge_frame(spark, [(i, i + 1) for i in range(40)])
    progress = []
    for part in range(4):
        edges.where(f"id >= {part * 10} and id < {part * 10 + 10}").write.mode("append").json(f"{folder}/in")
        sdf = scan_event_time_table(spark, f"{folder}/in", 14)
        counts = sdf.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
        q = (
            counts.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp")
            .trigger(availableNow=True).start(f"{folder}/out")
        )
        commits.drain_until_complete(q)
        progress += q.recentProgress
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 0
    got = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/out").select(F.unix_millis("ts"), "n").collect()}
    assert got == {1: 15, **{i: 1 for i in range(15, 39)}}


def test_a_failed_stream_is_not_taken_for_drained(spark):
    folder = scratch_path(spark, "bad")
    spark.range(3).selectExpr("cast(id as string) value").write.text(f"{folder}/in")

    def boom(batch, batch_id):
        raise RuntimeError("no")

    sdf = spark.readStream.schema("value STRING").text(f"{folder}/in")
    q = sdf.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).foreachBatch(boom).start()
    with pytest.raises(Exception):
        commits.drain_until_complete(q)
