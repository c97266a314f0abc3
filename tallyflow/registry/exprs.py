"""Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import exprs
from tallyflow.registry.base import query, table


@query("project_rename", "select l_partkey as u, l_suppkey as v, l_orderkey as id from lineitem")
def project_rename(spark, sf):
    return exprs.project_rename(table(spark, sf, "lineitem"), {"l_partkey": "u", "l_suppkey": "v", "l_orderkey": "id"})


@query("literal_column", "select l_partkey as vertex, 6000 as rank from lineitem")
def literal_column(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vertex"))
    return exprs.literal_column(rows, "rank", 6000)


@query("int_arith", "select l_orderkey as id, l_partkey * 5 + 1000 as scaled from lineitem")
def int_arith(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), exprs.int_arith("l_partkey", 5, 1000).alias("scaled")
    )


@query("floor_div", """
select l_orderkey as id, l_partkey as a,
       cast(floor((l_partkey - 1000)::double / (l_linenumber + 1)) as bigint) as down,
       (l_partkey * 5) // (l_linenumber * 6) as share
from lineitem
""")
def floor_div(spark, sf):
    number = F.col("l_linenumber").cast("bigint")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_partkey").alias("a"),
        exprs.floor_div(F.col("l_partkey") - 1000, number + 1).alias("down"),
        exprs.whole_div(F.col("l_partkey") * 5, number * 6).alias("share"),
    )


@query("case_when", "select l_orderkey as id, case when l_linenumber = 1 then 0 else l_partkey end as flow from lineitem")
def case_when(spark, sf):
    first = F.col("l_linenumber") == 1
    flow = exprs.case_when(first, F.lit(0).cast("bigint"), F.col("l_partkey"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), flow.alias("flow"))


@query("coalesce_null", """
select p_partkey as vertex, coalesce(n, 0) as degree
from part left join (select l_partkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on p_partkey = l_partkey
""")
def coalesce_null(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey"))
    joined = table(spark, sf, "part").join(returned.agg(F.count(F.lit(1)).alias("n")), "p_partkey", "left")
    return joined.select(F.col("p_partkey").alias("vertex"), exprs.coalesce_null("n", 0).alias("degree"))


@query("is_null_filter", """
select distinct l_partkey as vertex from lineitem left join (select distinct l_suppkey from lineitem) t on l_partkey = t.l_suppkey
where t.l_suppkey is null
""")
def is_null_filter(spark, sf):
    lines = table(spark, sf, "lineitem")
    sources = lines.select(F.col("l_partkey").alias("vertex")).distinct()
    targets = lines.select(F.col("l_suppkey").alias("target")).distinct()
    joined = sources.join(targets, F.col("vertex") == F.col("target"), "left")
    return exprs.is_null_filter(joined, "target").select("vertex")


@query("json_extract", "select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), exprs.json_extract("props", "k BIGINT")["k"].alias("k")
    )


@query("json_build", """select '{"id":' || event_id || ',"word":"' || event_type || '"}' as value from events""")
def json_build(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("word"))
    return exprs.json_build(rows)


@query("concat_fields", "select event_type || ',' || event_id as value from events")
def concat_fields(spark, sf):
    return table(spark, sf, "events").select(exprs.concat_fields(["event_type", "event_id"]).alias("value"))


@query("cast_bytes", "select event_id as id, props as value from events")
def cast_bytes(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.encode("props", "utf-8").alias("value"))
    return raw.select("id", exprs.cast_bytes("value").alias("value"))


def _updates(spark, sf):
    """Topic payloads of the three update formats, headers and retractions among them."""
    kind = F.col("event_id") % 7
    word = F.concat(F.lit('"'), "event_type", F.lit('"'))
    number = F.col("event_id").cast("string")
    line = (
        F.when(kind == 0, F.concat(F.lit('"word","count","time","diff"\n'), F.concat_ws(",", word, number, number, F.lit("1"))))
        .when(kind == 1, F.concat_ws(",", word, number, number, F.lit("-1")))
        .when(kind == 2, F.concat_ws(",", "event_type", number, F.lit("-D")))
        .when(kind == 3, F.concat_ws(",", "event_type", number))
        .when(kind == 4, F.lit('"word","count"'))
        .when(kind == 5, F.lit("*FINISH*"))
        .otherwise(F.concat_ws(",", "event_type", number, number, F.lit("1")))
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), line.alias("value"))


@query("split_trim_unquote", """
select event_id as id,
  case event_id % 7 when 4 then 'word' when 5 then '*FINISH*' else event_type end as first_field,
  case event_id % 7 when 0 then 4 when 1 then 4 when 2 then 3 when 3 then 2 when 4 then 2 when 5 then 1 else 4 end as fields
from events
""")
def split_trim_unquote(spark, sf):
    fields = exprs.split_trim_unquote("value")
    return _updates(spark, sf).select("id", fields[0].alias("first_field"), F.size(fields).alias("fields"))


@query("filter_control_rows", "select event_id as id from events where event_id % 7 in (0, 3, 6)")
def filter_control_rows(spark, sf):
    return exprs.filter_control_rows(_updates(spark, sf)).select("id")


@query("row_parsers", """
select event_id as id, event_type as word, event_id as "count",
       case when event_id % 7 <> 3 then event_id else -1 end as engine_time
from events where event_id % 7 in (0, 3, 6)
""")
def row_parsers(spark, sf):
    kept = exprs.filter_control_rows(_updates(spark, sf))
    return kept.select("id", exprs.count_update("value").alias("r")).select("id", "r.*").fillna(-1, ["engine_time"])


@query("ts_from_id", """
select event_id as id, case when event_id <= (select count(*) // 2 from events) then 1 else event_id end as ts_ms from events
""")
def ts_from_id(spark, sf):
    events = table(spark, sf, "events")
    ts = exprs.ts_from_id("event_id", events.count() // 2)
    return events.select(F.col("event_id").alias("id"), F.unix_millis(ts).alias("ts_ms"))


@query("increment", "select event_id as id, user_id + 1 as number from events")
def increment(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("number"))
    return exprs.increment(rows, "number")


@query("pointer_key", "select page_id, md5(length(url) || ':' || url) as pointer from pages")
def pointer_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", exprs.pointer_key("url").alias("pointer"))
