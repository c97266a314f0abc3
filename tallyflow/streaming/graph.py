"""PageRank kept up to date over a stream of edges.

A small commit does not rank the graph again.  For every vertex the state holds its degree and its rank after
each step; a commit follows the changes it causes from step to step:

* a vertex sends something else when its degree or its previous rank changed;
* the difference goes along its old edges, the whole new flow along its new edges;
* whoever receives a difference that is not zero has a changed rank in this step.

Ranks are whole numbers, so small differences are rounded away and the changes die out.

Edges and states are logs laid out by bucket of the vertex (see ``sinks.logs``).  Each step writes its changes
and notes, on the way, how many they are and which buckets they fall in; the next step reads those buckets of
the two logs and no others.  Changes of up to ``BROADCAST_ROWS`` vertices are broadcast, so that old edges and
states are not shuffled.  Beyond that every step would read and shuffle the whole log of edges; ranking the graph
again shuffles it once for all steps, so that is what such a commit does.  The states that come out differently are
logged, as after a small commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyflow.operators.joins import edge_copies
from tallyflow.plans.graph import START_RANK, UNIT, integer_flow, pagerank_states
from tallyflow.session import shuffle_width
from tallyflow.sinks import logs
from tallyflow.sources.generators import gen_backfill_stream
from tallyflow.streaming.commits import ON_ARRIVAL, explicit_commit

# Vertices whose changes (below 100 bytes each) a step broadcasts; a commit that changes more ranks the graph again.
BROADCAST_ROWS = 100_000

EDGE_STREAM_SCHEMA = "id BIGINT, u BIGINT, v BIGINT, commit_id BIGINT"

SCHEMAS = {
    "edges": "u BIGINT, v BIGINT, copies BIGINT",
    "states": "vertex BIGINT, degree BIGINT, ranks ARRAY<BIGINT>, before BIGINT",
}


def _none() -> Column:
    return F.lit(0).cast("bigint")


def _parts(spark: SparkSession) -> int:
    """Parts of a bucket of edges: a source with very many targets keeps so many tasks busy."""
    return -(-8 * shuffle_width(spark) // logs.BUCKETS)


def _part(spark: SparkSession, vertex: str) -> Column:
    return F.pmod(F.xxhash64(vertex), F.lit(_parts(spark)))


def _log(spark: SparkSession, state_dir: str, kind: str, commit: int, buckets: list[int] | None = None) -> DataFrame:
    return logs.read(spark, f"{state_dir}/{kind}", SCHEMAS[kind], commit, buckets)


def _merged_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").agg(F.sum("copies").alias("copies"))


def _latest(states: DataFrame) -> DataFrame:
    newest = states.groupBy("vertex").agg(F.max_by(F.struct("degree", "ranks"), "commit").alias("s"))
    return newest.select("vertex", "s.degree", "s.ranks", F.lit(None).cast("bigint").alias("before"))


def graph_upto(spark: SparkSession, state_dir: str, commit: int) -> DataFrame:
    """``u, v, copies`` of the graph after ``commit``."""
    return _merged_edges(_log(spark, state_dir, "edges", commit))


def ranks_at(spark: SparkSession, state_dir: str, commit: int) -> DataFrame:
    """``vertex, rank`` as they stood after ``commit``."""
    states = _latest(_log(spark, state_dir, "states", commit))
    return states.select("vertex", F.element_at("ranks", -1).alias("rank"))


def rank_versions(spark: SparkSession, state_dir: str, last: int) -> DataFrame:
    """``commit, vertex, rank`` after each commit up to ``last``, in one pass over the states."""
    states = logs.read_commits(spark, f"{state_dir}/states", SCHEMAS["states"], range(last + 1))
    following = F.lead("commit").over(Window.partitionBy("vertex").orderBy("commit"))
    lasted = states.withColumn("_until", F.coalesce(following - 1, F.lit(last)))
    commits = F.explode(F.sequence("commit", "_until")).alias("commit")
    return lasted.select(commits, "vertex", F.element_at("ranks", -1).alias("rank"))


def _counted(rows: DataFrame, key: str, write: Callable[[DataFrame], None]) -> tuple[int, list[int]]:
    """Write ``rows``; their number and the buckets of their keys, observed in the same job."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n"), logs.buckets_in([key]).alias("buckets")))
    return seen.get["n"], logs.bucket_list(seen.get["buckets"])


def _with_states(moved: DataFrame, states: DataFrame, sums: list[str], rows: int) -> DataFrame:
    """``vertex, degree, ranks`` and the ``sums`` of a frame of changes (at most ``rows`` vertices).

    The found rows and the changes meet in a single aggregation.  A vertex not in the log has null
    ``degree`` and ``ranks``.
    """
    wanted = moved.select("vertex")
    found = states.join(F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted, "vertex", "left_semi")
    together = moved.unionByName(found.drop("before"), allowMissingColumns=True)
    newest = F.max_by(F.struct("degree", "ranks"), "commit").alias("s")
    known = together.groupBy("vertex").agg(newest, *[F.coalesce(F.sum(c), _none()).alias(c) for c in sums])
    return known.select("vertex", "s.degree", "s.ranks", *sums)


def _flows(moved: DataFrame, states: DataFrame, step: int, rows: int) -> DataFrame:
    """``u, sent_before, sent`` in ``step`` of all vertices that may send something else than before.

    ``moved`` holds the changes of degree (``added``) and of the previous rank (``change``).
    """
    known = _with_states(moved, states, ["added", "change"], rows)
    fresh = START_RANK if step == 1 else UNIT  # without old edges a vertex stands at one unit
    degree = F.coalesce("degree", _none())
    rank = F.coalesce(F.element_at("ranks", step), F.lit(fresh).cast("bigint"))
    return known.select(
        F.col("vertex").alias("u"),
        integer_flow(rank, degree).alias("sent_before"),
        integer_flow(rank + F.col("change"), degree + F.col("added")).alias("sent"),
    )


def _changed_inflow(delta: DataFrame, edges: DataFrame, flows: DataFrame, step: int) -> DataFrame:
    """``vertex, change``: by how much the inflow differs from what it was before the commit.

    Along an old edge goes the difference, along a new one all of the flow; one join serves both.  In the
    first step, the ends of new edges are there whatever they receive.
    """
    ends = step == 1
    old = edges.select("u", "v", "copies", F.lit(False).alias("is_new"))
    along = old.unionByName(delta.select("u", "v", "copies", F.lit(True).alias("is_new")))
    met = along.join(F.broadcast(flows), "u")
    more = (F.col("sent") - F.when(F.col("is_new"), 0).otherwise(F.col("sent_before"))) * F.col("copies")
    moved = met.select(F.col("v").alias("vertex"), more.alias("change"), "is_new")
    if not ends:
        moved = moved.where("change <> 0")
    summed = moved.groupBy("vertex").agg(F.sum("change").alias("change"), F.max("is_new").alias("is_new"))
    return summed.where(F.col("is_new") | (F.col("change") != 0) if ends else F.col("change") != 0).select("vertex", "change")


def spread_changes(
    spark: SparkSession, state_dir: str, commit: int, rows: int, buckets: list[int], steps: int
) -> DataFrame | None:
    """New states (as logged) of all vertices that ``commit`` affects; None where a step would have to broadcast too many.

    ``rows`` and ``buckets`` tell the number of its distinct edges and the buckets of their sources.
    """
    delta = logs.read_commits(spark, f"{state_dir}/edges", SCHEMAS["edges"], [commit]).drop("commit")
    added = delta.groupBy(F.col("u").alias("vertex")).agg(F.sum("copies").alias("added"))
    moved = added.withColumn("change", _none())
    shifts = [f"shift_{k}" for k in range(1, steps + 1)]
    log = added.select("vertex", "added", *[_none().alias(s) for s in shifts])
    seen, here = rows, buckets  # of the vertices that may send something else in the next step
    everywhere, total = set(buckets), rows
    for step in range(1, steps + 1):
        if seen > BROADCAST_ROWS:
            return None
        states, edges = (_log(spark, state_dir, kind, commit - 1, here) for kind in ("states", "edges"))
        change = _changed_inflow(delta, edges, _flows(moved, states, step, seen), step)
        path = f"{state_dir}/steps/step={step}"
        changed, fell = _counted(change, "vertex", lambda c, p=path: c.write.mode("overwrite").parquet(p))
        change = spark.read.schema("vertex BIGINT, change BIGINT").parquet(path)
        moved = added.withColumn("change", _none()).unionByName(change.select("vertex", _none().alias("added"), "change"))
        seen, here = rows + changed, sorted({*buckets, *fell})
        total, everywhere = total + changed, everywhere | set(fell)
        of_step = [(F.col("change") if s == f"shift_{step}" else _none()).alias(s) for s in shifts]
        log = log.unionByName(change.select("vertex", _none().alias("added"), *of_step))
    known = _with_states(log, _log(spark, state_dir, "states", commit - 1, sorted(everywhere)), ["added", *shifts], total)
    start = F.coalesce(F.element_at("ranks", 1), F.lit(START_RANK).cast("bigint"))
    later = [
        F.coalesce(F.element_at("ranks", k + 1), F.lit(UNIT).cast("bigint")) + F.col(f"shift_{k}")
        for k in range(1, steps + 1)
    ]
    return known.select(
        "vertex",
        (F.coalesce("degree", _none()) + F.col("added")).alias("degree"),
        F.array(start, *later).alias("ranks"),
        F.element_at("ranks", -1).alias("before"),
    )


def rank_again(
    spark: SparkSession, state_dir: str, commit: int, steps: int, keep: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """What ``keep`` makes of the new states (as logged) of all vertices that ``commit`` affects, from the whole graph."""
    logged = _latest(_log(spark, state_dir, "states", commit - 1))
    known = logged.select(F.col("vertex").alias("_vertex"), F.struct("degree", "ranks").alias("_was"))

    def changed(after: DataFrame) -> DataFrame:
        met = after.join(known, F.col("vertex").eqNullSafe(F.col("_vertex")), "left")
        differs = ~F.struct("degree", "ranks").eqNullSafe(F.col("_was"))
        return keep(met.where(differs).select("vertex", "degree", "ranks", F.element_at("_was.ranks", -1).alias("before")))

    return pagerank_states(graph_upto(spark, state_dir, commit), steps, changed)


def _rank_changes(states: DataFrame) -> DataFrame:
    old, new = F.col("before"), F.element_at("ranks", -1)
    sides = F.array(
        F.struct(old.alias("rank"), F.lit(-1).cast("smallint").alias("diff")),
        F.struct(new.alias("rank"), F.lit(1).cast("smallint").alias("diff")),
    )
    changed = states.where(~old.eqNullSafe(new))
    return changed.select("vertex", F.inline(sides).alias("rank", "diff")).where("rank is not null")


def apply_commit(batch: DataFrame, commit: int, state_dir: str, steps: int) -> None:
    """Add a commit's edges, bring the states up to date, record how the ranks changed."""
    spark = batch.sparkSession
    edges, states = f"{state_dir}/edges", f"{state_dir}/states"
    rows, buckets = _counted(edge_copies(batch), "u", lambda e: logs.append(e, edges, ["u"], commit, _part(spark, "v")))

    def record(after: DataFrame) -> DataFrame:
        logs.append(after, states, ["vertex"], commit)
        return logs.read_commits(spark, states, SCHEMAS["states"], [commit])

    if commit:
        spread = spread_changes(spark, state_dir, commit, rows, buckets, steps)
        done = rank_again(spark, state_dir, commit, steps, record) if spread is None else record(spread)
    else:
        fresh = lambda s: record(s.withColumn("before", F.lit(None).cast("bigint")))
        done = pagerank_states(graph_upto(spark, state_dir, 0), steps, fresh)
    _rank_changes(done).write.mode("overwrite").parquet(f"{state_dir}/changes/commit={commit}")
    logs.fold(spark, states, SCHEMAS["states"], ["vertex"], commit, _latest)
    logs.fold(spark, edges, SCHEMAS["edges"], ["u"], commit, _merged_edges, _part(spark, "v"))


def stream_pagerank(
    edges: DataFrame, state_dir: str, checkpoint: str, steps: int = 5, trigger: dict | None = None
) -> StreamingQuery:
    """Refresh the ranks below ``state_dir`` at every commit of the edge stream ``u, v``."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        # Settings of the stream's own session: the driver lists the folders of a log, which are few, without a job, and
        # the many small shuffles of a commit, of merged sums, run inside its jobs instead of one job each.
        own = batch.sparkSession.conf
        own.set("spark.sql.sources.parallelPartitionDiscovery.threshold", str(2 * logs.FOLD_EVERY * logs.BUCKETS))
        own.set("spark.sql.adaptive.enabled", "false")
        apply_commit(batch, batch_id, state_dir, steps)

    writer = edges.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(commit).start()


def backfill_pagerank(edges: DataFrame, folder: str, start: int, step: int, steps: int = 5) -> str:
    """One large first commit, then small ones, over edges ``id, u, v``; returns the state folder."""
    spark = edges.sparkSession
    staged, inbox, state = f"{folder}/staged", f"{folder}/inbox", f"{folder}/state"
    gen_backfill_stream(edges, start, step, staged)

    def run() -> StreamingQuery:
        source = spark.readStream.schema(EDGE_STREAM_SCHEMA).parquet(inbox)
        return stream_pagerank(source.select("u", "v"), state, f"{folder}/checkpoint", steps, ON_ARRIVAL)

    explicit_commit(spark, staged, inbox, run)
    return state
