"""Joins, aggregations, order-based operators, set operations and graph ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions.exprs import tokens, whole_div
from tallyflow.operators import aggregates as agg, joins, ordered, sets
from tallyflow.plans import graph, latency
from tallyflow.registry.base import (
    EVENT_EDGES,
    HOUR_MS,
    PART_EDGES,
    PERCENTILE_ROWS,
    TIMELINES,
    event_edges,
    input_timeline,
    output_timeline,
    pagerank_ctes,
    part_edges,
    query,
    sorted_values,
    table,
)
from tallyflow.functions.exprs import pointer_key
from tallyflow.session import settle

DEGREES = "(select vertex, sum(d)::bigint as degree from (select u as vertex, 1 as d from e union all select v, 0 from e) group by vertex)"

# Flow of a source after the start rank: the first step of the ranking.
OUTFLOW = f"(select vertex as u, (6000 * 5) // (degree * 6) as outflow from {DEGREES} where degree > 0)"


def _first_outflow(edges):
    degrees = agg.degrees_union_sum(edges).where("degree > 0")
    return degrees.select("u", whole_div(F.lit(30000).cast("bigint"), F.col("degree") * 6).alias("outflow"))


# --- joins ---------------------------------------------------------------------------------


@query("join_inner_equi", f"with e as ({PART_EDGES}) select vertex, degree, s_nationkey from {DEGREES} join supplier on vertex = s_suppkey")
def join_inner_equi(spark, sf):
    degrees = agg.degrees_union_sum(part_edges(spark, sf)).withColumnRenamed("u", "vertex")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vertex"), "s_nationkey")
    return joins.join_inner_equi(degrees, suppliers, "vertex")


@query("join_edges_outflow", f"""
with e as ({EVENT_EDGES})
select e.u, v, count(*) as copies, outflow from e join {OUTFLOW} o on e.u = o.u group by e.u, v, outflow
""")
def join_edges_outflow(spark, sf):
    edges = event_edges(spark, sf)
    return joins.join_edges_outflow(edges, _first_outflow(edges))


@query("join_links_ranks", f"""
with e as ({EVENT_EDGES})
select e.u, rank, v from (select distinct u, v from e) e join (select vertex, degree + 1000 as rank from {DEGREES}) on e.u = vertex
""")
def join_links_ranks(spark, sf):
    edges = event_edges(spark, sf)
    ranks = agg.degrees_union_sum(edges).select("u", (F.col("degree") + 1000).alias("rank"))
    joined = joins.join_links_ranks(agg.neighbour_list(edges), ranks)
    return joined.select("u", "rank", F.explode("neighbours").alias("v"))


@query("join_full_outer", f"""
with e as ({EVENT_EDGES})
select coalesce(a.u, b.v) as vertex, coalesce(n, 0) as degree
from (select u, count(*) as n from e group by u) a full join (select distinct v from e) b on a.u = b.v
""")
def join_full_outer(spark, sf):
    edges = event_edges(spark, sf)
    targets = agg.in_vertices(edges).withColumnRenamed("v", "u")
    return joins.join_full_outer(agg.out_degree(edges), targets, "u").select(
        F.col("u").alias("vertex"), F.coalesce("degree", F.lit(0)).alias("degree")
    )


@query("join_left_anti", f"with e as ({PART_EDGES}) select distinct u from e where u not in (select v from e)")
def join_left_anti(spark, sf):
    edges = part_edges(spark, sf)
    targets = agg.in_vertices(edges).withColumnRenamed("v", "u")
    return joins.join_left_anti(edges.select("u").distinct(), targets, "u")


@query("join_self_key_time", "select event_id as id, user_id as u, epoch_us(ts) as ts from events")
def join_self_key_time(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")
    )
    return joins.join_self_key_time(events)


def _numbered(spark, sf):
    return ordered.running_count(input_timeline(spark, sf), "word", ["timestamp", "offset"])


@query("join_lower_bound", f"""
with {TIMELINES} select word, "count", timestamp, "offset", coalesce(out_count, -1) as out_count, coalesce(out_time, -1) as out_time,
       coalesce(engine_time, -1) as engine_time from matched
""")
def join_lower_bound(spark, sf):
    matched = joins.join_lower_bound(_numbered(spark, sf), output_timeline(spark, sf), "word", "count", "timestamp")
    return matched.fillna(-1, ["out_count", "out_time", "engine_time"])


@query("lower_bound_window", f"""
with {TIMELINES} select word, "count", timestamp, coalesce(out_time, -1) as out_time from matched
""")
def lower_bound_window(spark, sf):
    tagged = joins.tag_bounds(_numbered(spark, sf), output_timeline(spark, sf), "word", "count", "timestamp")
    filled = joins.lower_bound_window(tagged, "word", "count", "timestamp")
    return filled.where("_side = 0").select("word", "count", "timestamp", F.coalesce("matched.time", F.lit(-1)).alias("out_time"))


@query("join_lookup_missing", """
select event_type as word, count(*) as inputs from events
where event_type not in (select event_type from events group by 1 having count(*) * 5 >= (select count(*) from events)) group by 1
""")
def join_lookup_missing(spark, sf):
    words = table(spark, sf, "events").select(F.col("event_type").alias("word"))
    total = words.agg(F.count(F.lit(1)).alias("n"))
    common = agg.wordcount(words).where(F.col("count") * 5 >= total.scalar())
    return joins.join_lookup_missing(words, common, "word")


CMP_2, LAST_2 = pagerank_ctes("e", "a", 2)
CMP_3, LAST_3 = pagerank_ctes("e", "b", 3)


@query("compare_sorted", f"""
with e as ({EVENT_EDGES}), {CMP_2}, {CMP_3},
x as (select rank, row_number() over (order by rank) as i from {LAST_2}),
y as (select rank, row_number() over (order by rank) as i from {LAST_3}),
xs as (select rank, count(*) as n from x group by rank), ys as (select rank, count(*) as n from y group by rank)
select count(*) filter (where x.rank = y.rank) as equal, count(*) as size_a, count(*) as size_b,
       (select coalesce(sum(least(xs.n, ys.n)), 0)::bigint from xs join ys on xs.rank = ys.rank) as common,
       count(*) filter (where x.rank = y.rank) / count(*) as equal_fraction
from x join y on x.i = y.i
""")
def compare_sorted(spark, sf):
    edges = event_edges(spark, sf)
    return joins.compare_sorted(graph.pagerank(edges, 2), graph.pagerank(edges, 3), "rank")


# --- aggregations --------------------------------------------------------------------------

WORDS = "select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents"


def _document_words(spark, sf):
    return table(spark, sf, "documents").select(F.explode(tokens("text")).alias("word"))


@query("wordcount", f"""select word, count(*) as "count" from ({WORDS}) where word <> '' group by word""")
def wordcount(spark, sf):
    return agg.wordcount(_document_words(spark, sf))


@query("wordcount_map_reduce", f"""select word, count(*) as "count" from ({WORDS}) where word <> '' group by word""")
def wordcount_map_reduce(spark, sf):
    return agg.wordcount_map_reduce(_document_words(spark, sf))


@query("out_degree", f"select u, count(*) as degree from ({PART_EDGES}) group by u")
def out_degree(spark, sf):
    return agg.out_degree(part_edges(spark, sf))


@query("in_vertices", f"select distinct v from ({PART_EDGES})")
def in_vertices(spark, sf):
    return agg.in_vertices(part_edges(spark, sf))


@query("degrees_union_sum", f"with e as ({PART_EDGES}) select vertex as u, degree from {DEGREES}")
def degrees_union_sum(spark, sf):
    return agg.degrees_union_sum(part_edges(spark, sf))


@query("inflow_sum", f"""
with e as ({EVENT_EDGES}) select v, sum(outflow)::bigint as inflow from e join {OUTFLOW} o on e.u = o.u group by v
""")
def inflow_sum(spark, sf):
    edges = event_edges(spark, sf)
    return agg.inflow_sum(joins.join_edges_outflow(edges, _first_outflow(edges)))


@query("neighbour_list", f"""
select u, v // 1024 as chunk, string_agg(v, ',' order by v) as neighbours, count(*) as degree_part
from (select distinct u, v from ({PART_EDGES})) group by all
""")
def neighbour_list(spark, sf):
    lists = agg.neighbour_list(part_edges(spark, sf))
    return lists.withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query("reduce_by_key_sum", "select l_suppkey as vertex, sum(l_partkey)::bigint as total from lineitem group by 1")
def reduce_by_key_sum(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("vertex"), "l_partkey")
    return agg.reduce_by_key_sum(rows, "vertex", "l_partkey")


@query("global_count", "select count(*) as cnt from lineitem")
def global_count(spark, sf):
    return agg.global_count(table(spark, sf, "lineitem"))


@query("conditional_count", "select count(*) filter (where l_returnflag = 'R' and l_discount > 0.05) as hits from lineitem")
def conditional_count(spark, sf):
    cond = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)
    return agg.conditional_count(table(spark, sf, "lineitem"), cond)


def _matched(spark, sf):
    return latency.match_latencies(input_timeline(spark, sf), output_timeline(spark, sf), ["offset"])


@query("latency_percentiles", f"""
with {TIMELINES}, s as ({sorted_values('matched')})
select p, latency as value from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100
""")
def latency_percentiles(spark, sf):
    return agg.latency_percentiles(_matched(spark, sf))


def _bucket_sql(by: str, source: str) -> str:
    return f"""
with {TIMELINES}, b as ({source}), s as ({sorted_values('b', by)})
select {by}, min(latency) as min, max(latency) filter (where pos = n // 20) as p05,
       max(latency) filter (where pos = n // 2) as med, max(latency) filter (where pos = (n * 19) // 20) as p95,
       max(latency) as max, max(n) as "count"
from s group by {by}
"""


@query("latency_by_timestamp", _bucket_sql("timestamp", f"select timestamp // {HOUR_MS} * {HOUR_MS} as timestamp, latency from matched"))
def latency_by_timestamp(spark, sf):
    hour = whole_div("timestamp", F.lit(HOUR_MS).cast("bigint")) * HOUR_MS
    return agg.latency_by_timestamp(_matched(spark, sf).withColumn("timestamp", hour))


@query("latency_by_engine_time", _bucket_sql("engine_time", "select engine_time, latency from matched where engine_time is not null"))
def latency_by_engine_time(spark, sf):
    return agg.latency_by_engine_time(_matched(spark, sf))


@query("lost_count", f"with {TIMELINES} select count(*) filter (where latency is null) as lost from matched")
def lost_count(spark, sf):
    return agg.lost_count(_matched(spark, sf))


@query("latency_profile", f"""
with {TIMELINES},
found as (select * from matched where latency is not null),
kept as (select * from found qualify row_number() over (order by timestamp, word, "offset") > 500),
s as ({sorted_values('kept')})
select p, latency as value from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100
union all select -1, count(*) filter (where latency is null) from matched
""")
def latency_profile(spark, sf):
    profile = latency.latency_profile(input_timeline(spark, sf), output_timeline(spark, sf), skip=500)
    return profile.percentiles


RUNS = """
select l_linenumber as workers, l_returnflag <> 'R' or l_discount < 0.1 as ok,
       case when l_tax < 0.08 then l_quantity end as seconds from lineitem
"""
REPORT = f"""
g as (select workers, median(seconds) as median_s, bool_and(ok and seconds is not null) as ok from ({RUNS}) group by workers),
r as (select workers, median_s, 1000000 / median_s as rows_per_second, ok from g)
"""


def _runs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("workers"),
        ((F.col("l_returnflag") != "R") | (F.col("l_discount") < 0.1)).alias("ok"),
        F.when(F.col("l_tax") < 0.08, F.col("l_quantity")).alias("seconds"),
    )


@query("throughput_report", f"""
with {REPORT}
select workers, median_s, rows_per_second, rows_per_second / (select min_by(rows_per_second, workers) from r) as speedup, ok from r
""")
def throughput_report(spark, sf):
    return agg.throughput_report(_runs(spark, sf), 1_000_000)


@query("speedup_over_base", f"""
with {REPORT} select workers, rows_per_second, rows_per_second / (select min_by(rows_per_second, workers) from r) as speedup from r
""")
def speedup_over_base(spark, sf):
    medians = ordered.exact_median(_runs(spark, sf), "seconds", ["workers"], "median_s")
    rates = medians.select("workers", (F.lit(1_000_000) / F.col("median_s")).alias("rows_per_second"))
    return agg.speedup_over_base(rates)


_WIDE = ", ".join(
    f"max(latency) filter (where p = {p}) as \"{'min' if p == 0 else 'median' if p == 50 else 'max' if p == 100 else f'p{p:02d}'}\""
    for p in agg.REPORT_PERCENTILES
)


@query("pivot_percentiles", f"""
with {TIMELINES}, s as ({sorted_values('matched', 'word')}),
r as (select word, p, latency from s join {PERCENTILE_ROWS} on pos = ((n - 1) * p) // 100),
l as (select word, count(*) filter (where latency is null) as lost from matched group by word)
select r.word, {_WIDE}, max(lost) as lost from r join l on r.word = l.word group by r.word
""")
def pivot_percentiles(spark, sf):
    matched = settle(_matched(spark, sf))
    lost = matched.groupBy("word").agg(F.count_if(F.col("latency").isNull()).alias("value"))
    rows = agg.latency_percentiles(matched, by=["word"])
    return agg.pivot_percentiles(rows.unionByName(lost.withColumn("p", F.lit(agg.LOST).cast("bigint"))), ["word"])


# --- order ---------------------------------------------------------------------------------


@query("running_count", """
select event_id, epoch_us(ts) as at, event_type as word,
       row_number() over (partition by event_type order by ts, event_id) as "count" from events
""")
def running_count(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("word")
    )
    return ordered.running_count(rows, "word", ["at", "event_id"])


@query("global_row_index", """
select event_id, row_number() over (order by event_type, ts, event_id) - 1 as row_index from events
""")
def global_row_index(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return ordered.global_row_index(rows, ["event_type", "ts", "event_id"]).select("event_id", "row_index")


@query("skip_prefix", """
select event_id, event_type from events qualify row_number() over (order by event_type, ts, event_id) > 500
""")
def skip_prefix(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return ordered.skip_prefix(rows, 500, ["event_type", "ts", "event_id"]).select("event_id", "event_type")


@query("sort_timeline", "select epoch_us(ts) as at, event_type as word, event_id from events order by 1, 2, 3")
def sort_timeline(spark, sf):
    rows = table(spark, sf, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("word"), "event_id"
    )
    return ordered.sort_timeline(rows, "at", "word", "event_id")


@query("head_n", f"select id, u, v from ({EVENT_EDGES}) where id < 400")
def head_n(spark, sf):
    return ordered.head_n(event_edges(spark, sf), 400)


TOP_CTES, TOP_LAST = pagerank_ctes("e", "r", 5)


@query("top_ranks", f"with e as ({PART_EDGES}), {TOP_CTES} select vertex, rank from {TOP_LAST} order by rank desc, vertex limit 10")
def top_ranks(spark, sf):
    return ordered.top_ranks(graph.pagerank(part_edges(spark, sf)), 10)


# --- sets ----------------------------------------------------------------------------------


@query("distinct_rows", f"select distinct u, v from ({PART_EDGES})")
def distinct_rows(spark, sf):
    return sets.distinct_rows(part_edges(spark, sf))


@query("union_all", f"with e as ({PART_EDGES}) select v as vertex, 1000 as flow from e union all select u, 0 from e")
def union_all(spark, sf):
    edges = part_edges(spark, sf)
    inflows = edges.select(F.col("v").alias("vertex"), F.lit(1000).alias("flow"))
    return sets.union_all(inflows, edges.select(F.col("u").alias("vertex"), F.lit(0).alias("flow")))


@query("except_distinct", f"with e as ({PART_EDGES}) select u from e except select v from e")
def except_distinct(spark, sf):
    edges = part_edges(spark, sf)
    return sets.except_distinct(edges.select("u"), edges.select(F.col("v").alias("u")))


# --- graph ranking -------------------------------------------------------------------------


@query("udtf_contribs", f"""
with e as ({EVENT_EDGES}), d as (select distinct u, v from e), n as (select u, count(*) as n from d group by u)
select d.v as vertex, 6000 // n.n as contribution from d join n on d.u = n.u
""")
def udtf_contribs(spark, sf):
    edges = event_edges(spark, sf)
    ranks = edges.select("u").distinct().withColumn("rank", F.lit(6000).cast("bigint"))
    return graph.udtf_contribs(agg.neighbour_list(edges), ranks)


@query("pagerank", f"with e as ({PART_EDGES}), {TOP_CTES} select vertex, rank from {TOP_LAST}")
def pagerank(spark, sf):
    return graph.pagerank(part_edges(spark, sf))


LINK_CTES, LINK_LAST = pagerank_ctes("e", "l", 5)


@query("pagerank_links", f"""
with e as (
  select md5(length(site) || ':' || site) as u, md5(length(link) || ':' || link) as v
  from (select regexp_extract(url, '://([^/?#]*)', 1) as site, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages)),
{LINK_CTES} select vertex, rank from {LINK_LAST}""")
def pagerank_links(spark, sf):
    """Vertices are texts, sites and what their pages link to, ranked by their pointers."""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")
    named = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("site"), links)
    return graph.pagerank(named.select(pointer_key("site").alias("u"), pointer_key("link").alias("v")))


def _neighbour_ctes(steps: int) -> tuple[str, str]:
    parts = [
        "d as materialized (select distinct u, v from e)",
        "k as materialized (select u, count(*) as n from d group by u)",
        "n_0 as (select u as vertex, 6000::bigint as rank from k)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"n_{i} as materialized (select vertex, ((sum(c) * 5) // 6 + 1000)::bigint as rank from ("
            f"select d.v as vertex, r.rank // k.n as c from d join k on d.u = k.u join n_{i - 1} r on r.vertex = d.u "
            f"union all select u, 0 from k) group by vertex)"
        )
    return ",\n".join(parts), f"n_{steps}"


LIST_CTES, LIST_LAST = _neighbour_ctes(5)


@query("pagerank_neighbour_list", f"with e as ({EVENT_EDGES}), {LIST_CTES} select vertex, rank from {LIST_LAST}")
def pagerank_neighbour_list(spark, sf):
    return graph.pagerank_neighbour_list(event_edges(spark, sf))


def _float_ctes(steps: int) -> tuple[str, str]:
    parts = [
        f"g as materialized {DEGREES}",
        "f_0 as (select vertex, degree, 1.0::double as rank from g)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"f_{i} as materialized (select g.vertex, g.degree, 1.0::double / 6 + (1 - 1.0::double / 6) * coalesce(x.s, 0) as rank from g left join ("
            f"select e.v as vertex, sum(r.rank / r.degree) as s from e join f_{i - 1} r on e.u = r.vertex group by e.v) x on g.vertex = x.vertex)"
        )
    return ",\n".join(parts), f"f_{steps}"


FLOAT_CTES, FLOAT_LAST = _float_ctes(5)


@query("pagerank_float", f"""
with e as ({EVENT_EDGES}), {FLOAT_CTES}
select vertex, round(rank * (select count(*) / sum(rank) from {FLOAT_LAST}), 6) as rank from {FLOAT_LAST}
""")
def pagerank_float(spark, sf):
    return graph.pagerank_float(event_edges(spark, sf)).select("vertex", F.round("rank", 6).alias("rank"))
