import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from tallyflow.operators.aggregates import REPORT_PERCENTILES
from tallyflow.operators.joins import join_lookup_missing, join_lower_bound
from tallyflow.operators import ordered
from tallyflow.operators.ordered import running_count
from tallyflow.plans.latency import latency_profile, match_latencies, report_name
from tallyflow.registry.scans import RUN
from tests.models import match

IN = "timestamp BIGINT, word STRING, offset BIGINT"
OUT = "timestamp BIGINT, word STRING, count BIGINT, engine_time BIGINT"


@pytest.fixture(autouse=True, params=["windows", "slices"])
def either_way(request, monkeypatch):
    monkeypatch.setattr(ordered, "ONE_TASK_PER_KEY", request.param == "windows")


def timelines(seed):
    rng = random.Random(seed)
    words = ["hot"] * 6 + ["a", "b", "c", "once"]
    inputs = [(rng.randrange(200), rng.choice(words), i) for i in range(300)] + [(50, "never", 1000)]
    outputs, counts = [], Counter()
    for t in range(10, 200, 10):
        for _, word, _ in [i for i in inputs if t - 10 <= i[0] < t]:
            counts[word] += 1
        for word in {i[1] for i in inputs if t - 10 <= i[0] < t} - {"never"}:
            engine = t - 1 if rng.random() < 0.8 else None
            outputs.append((t + rng.randrange(20), word, counts[word], engine))
            if rng.random() < 0.2:  # the same update twice, with another engine time
                outputs.append((outputs[-1][0], word, counts[word], t))
    return inputs, outputs


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("drop", [False, True])
def test_match_against_sorted_lists(spark, seed, drop):
    inputs, outputs = timelines(seed)
    # copies of whole outputs are one update when the first is to be dropped
    outputs = list(dict.fromkeys(outputs))
    got = match_latencies(
        spark.createDataFrame(inputs, IN).repartition(3), spark.createDataFrame(outputs, OUT), ["offset"], drop
    ).collect()
    want = match(inputs, outputs, drop)
    assert len(got) == len(inputs)
    for r in got:
        expected = want[r["word"], r["offset"]]
        if expected is None:
            assert r["out_time"] is None and r["latency"] is None
        else:
            assert (r["out_time"], r["engine_time"]) == expected
            assert r["latency"] == expected[0] - r["timestamp"] and r["latency"] >= 0


def test_profile(spark):
    inputs, outputs = timelines(7)
    profile = latency_profile(spark.createDataFrame(inputs, IN), spark.createDataFrame(outputs, OUT), skip=20)
    want = match(inputs, outputs)
    found = [(t, w, o, want[w, o][0] - t) for t, w, o in sorted(inputs) if want[w, o] is not None]
    kept = sorted(x[3] for x in found[20:])
    rows = {r["p"]: r["value"] for r in profile.percentiles.collect()}
    assert rows.pop(-1) == sum(v is None for v in want.values())
    assert rows == {p: kept[(len(kept) - 1) * p // 100] for p in REPORT_PERCENTILES}
    assert sorted((r[0], r[1]) for r in profile.timeline.collect()) == sorted((x[0], x[3]) for x in found[20:])
    assert sum(r["count"] for r in profile.by_timestamp_prefix.collect()) == 20
    assert sum(r["count"] for r in profile.by_timestamp.collect()) == len(found) - 20
    with_engine = sum(v is not None and v[1] is not None for v in want.values())
    assert sum(r["count"] for r in profile.by_engine_time.collect()) == with_engine


def test_skip_beyond_the_end(spark):
    inputs, outputs = timelines(8)
    profile = latency_profile(spark.createDataFrame(inputs, IN), spark.createDataFrame(outputs, OUT), skip=10_000)
    assert [r["p"] for r in profile.percentiles.collect()] == [-1]


def test_missing_words(spark):
    inputs, outputs = timelines(1)
    rows = join_lookup_missing(spark.createDataFrame(inputs, IN), spark.createDataFrame(outputs, OUT), "word").collect()
    assert [tuple(r) for r in rows] == [("never", 1)]


def test_golden_daily_commits(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    day_us = 24 * 3600 * 1_000_000
    rows = events.select(at.alias("timestamp"), F.col("event_type").alias("word"), F.col("event_id").alias("offset"))
    inputs = running_count(rows, "word", ["timestamp", "offset"])
    days = rows.groupBy("word", F.floor(F.col("timestamp") / day_us).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    end = F.unix_micros(F.lit("2024-01-29").cast("timestamp")) / day_us
    outputs = days.where(F.col("day") < end).select(
        "word",
        F.sum("n").over(Window.partitionBy("word").orderBy("day")).alias("count"),
        (F.col("day") * day_us + 25 * 3600 * 1_000_000).alias("timestamp"),
    )
    row = join_lower_bound(inputs, outputs, "word", "count", "timestamp").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("out_time").isNull()).alias("lost"),
        F.sum(F.col("out_time") - F.col("timestamp")).alias("total"),
    )
    assert tuple(row.first()) == (10000, 674, 436095797112651)


def test_dashes_in_metadata_are_refused():
    assert report_name(RUN).count("-") == len(RUN) - 1
    with pytest.raises(ValueError):
        report_name({**RUN, "code_version": "a-b"})
