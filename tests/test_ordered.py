import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import aggregates as agg, joins, ordered


@pytest.fixture(autouse=True, params=["windows", "slices"])
def either_way(request, monkeypatch):
    """Every test runs with plain windows and with slices."""
    monkeypatch.setattr(ordered, "ONE_TASK_PER_KEY", request.param == "windows")


def skewed(seed, n=400):
    """Rows (key, at, x): one key holds more than a third of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice("abcdefgh")
        rows.append((key, rng.randrange(50), i, rng.randrange(10)))
    return rows


SCHEMA = "key STRING, at BIGINT, tie BIGINT, x BIGINT"


@pytest.mark.parametrize("seed", range(3))
def test_running_total_over_a_hot_key(spark, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = ordered.running_total(df, F.col("x"), ["at", "tie"], ["key"], running="upto", total="all")
    got = {(r["key"], r["tie"]): (r["upto"], r["all"]) for r in out.collect()}
    want, sums = {}, Counter()
    for key, at, tie, x in sorted(rows):
        sums[key] += x
        want[key, tie] = sums[key]
    assert got == {k: (v, sums[k[0]]) for k, v in want.items()}


def test_hot_key_lies_in_several_slices(spark):
    df = spark.createDataFrame(skewed(1), SCHEMA)
    sliced = ordered.into_slices(df, ["key", "at", "tie"])
    slices = sliced.where("key = 'hot'").select("_slice").distinct().count()
    assert slices > 1
    biggest = max(r["count"] for r in sliced.groupBy("_slice").count().collect())
    assert biggest < 400 * 0.45


def test_index_and_skip(spark):
    rows = skewed(2)
    df = spark.createDataFrame(rows, SCHEMA)
    order = ["at", "key", "tie"]
    got = {r["tie"]: r["row_index"] for r in ordered.global_row_index(df, order).collect()}
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0], r[2])))}
    assert got == want
    kept = {r["tie"] for r in ordered.skip_prefix(df, 100, order).collect()}
    first = {r["tie"] for r in ordered.skip_prefix(df, 100, order, complement=True).collect()}
    assert first == {t for t, i in want.items() if i < 100} and kept == set(want) - first
    assert ordered.skip_prefix(df, 10_000, order).count() == 0


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(50, 60)], "key STRING, tie BIGINT")
    got = ordered.running_count(df, "key", ["tie"]).groupBy("key").agg(F.max("count").alias("n")).collect()
    assert {r["key"]: r["n"] for r in got} == {None: 50, "a": 10}


@pytest.mark.parametrize("seed", range(3))
def test_next_value(spark, seed):
    rng = random.Random(seed)
    rows = [(k, a, t, x if rng.random() < 0.05 else None) for k, a, t, x in skewed(seed)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["tie"]: r["nxt"] for r in ordered.next_value(df, "x", ["at", "tie"], ["key"], "nxt").collect()}
    want, ahead = {}, {}
    for key, at, tie, x in sorted(rows, key=lambda r: r[:3], reverse=True):
        ahead[key] = x if x is not None else ahead.get(key)
        want[tie] = ahead[key]
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 200])
def test_percentiles_match_array_indexing(spark, n):
    rng = random.Random(n)
    values = sorted(rng.choice([5, rng.randrange(1000)]) for _ in range(n))
    df = spark.createDataFrame([(v,) for v in values], "latency BIGINT")
    got = {r["p"]: r["value"] for r in agg.latency_percentiles(df).collect()}
    assert got == {p: values[(n - 1) * p // 100] for p in agg.REPORT_PERCENTILES}
    deciles = {r["p"]: r["value"] for r in agg.latency_percentiles(df, agg.DECILES).collect()}
    assert deciles == {10 * i: values[(n - 1) * i // 10] for i in range(11)}


def test_bucket_stats(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, 3]), rng.randrange(100)) for _ in range(300)]
    got = {r["timestamp"]: r for r in agg.latency_by_timestamp(spark.createDataFrame(rows, "timestamp BIGINT, latency BIGINT")).collect()}
    groups = defaultdict(list)
    for t, v in rows:
        groups[t].append(v)
    for t, values in groups.items():
        values.sort()
        n = len(values)
        want = (values[0], values[n // 20], values[n // 2], values[n * 19 // 20], values[-1], n)
        assert tuple(got[t][c] for c in ("min", "p05", "med", "p95", "max", "count")) == want


def test_compare_sorted(spark):
    rng = random.Random(6)
    a = [rng.randrange(20) for _ in range(150)]
    b = [min(19, x + (rng.random() < 0.1)) for x in a]
    row = joins.compare_sorted(
        spark.createDataFrame([(x,) for x in a], "rank BIGINT"), spark.createDataFrame([(x,) for x in b], "rank BIGINT"), "rank"
    ).first()
    equal = sum(x == y for x, y in zip(sorted(a), sorted(b)))
    common = sum((Counter(a) & Counter(b)).values())
    assert (row["equal"], row["size_a"], row["common"]) == (equal, 150, common)
    assert row["equal_fraction"] == equal / 150


def test_throughput_report(spark):
    runs = [(1, 10.0, True), (1, 12.0, True), (1, 11.0, True), (2, 6.0, True), (2, None, True), (2, 5.0, True), (4, None, True)]
    df = spark.createDataFrame(runs, "workers INT, seconds DOUBLE, ok BOOLEAN")
    got = {r["workers"]: r for r in agg.throughput_report(df, 1100).collect()}
    assert (got[1]["median_s"], got[1]["rows_per_second"], got[1]["speedup"], got[1]["ok"]) == (11.0, 100.0, 1.0, True)
    assert (got[2]["median_s"], got[2]["speedup"], got[2]["ok"]) == (5.5, 2.0, False)
    assert got[4]["median_s"] is None and got[4]["ok"] is False


def test_neighbour_chunks_are_bounded(spark):
    edges = spark.createDataFrame([(1, v) for v in range(5000)] * 2 + [(2, 7)], "u BIGINT, v BIGINT")
    rows = agg.neighbour_list(edges).collect()
    assert max(len(r["neighbours"]) for r in rows) <= agg.CHUNK
    assert sorted(v for r in rows if r["u"] == 1 for v in r["neighbours"]) == list(range(5000))


def test_integrity_check_finds_faults(spark):
    good = [(i, f"item_{i}", 0.5, i % 2 == 0) for i in range(10)]
    schema = "k BIGINT, name STRING, value DOUBLE, flag BOOLEAN"

    def verdict(rows, n=10):
        return agg.integrity_check(spark.createDataFrame(rows, schema), n).first()["ok"]

    assert verdict(good)
    assert not verdict(good[:-1])
    assert not verdict(good + good[:1])
    assert not verdict(good[:-1] + good[:1])
    assert not verdict(good[:-1] + [(9, "item_x", 0.5, True)])
    assert not verdict(good[:-1] + [(9, "item_9", None, True)])
    changed = spark.createDataFrame([(*r, 1) for r in good[:-1]] + [(*good[-1], -1)], schema + ", diff SMALLINT")
    assert not agg.integrity_check(changed, 10).first()["ok"]
    assert verdict([], 0)
    large = [(i, f"item_{i}", 0.5, True) for i in range(2**62, 2**62 + 4)]
    row = agg.integrity_check(spark.createDataFrame(large, schema), 4).first()
    assert not row["ok"] and row["sum_k"] is None and row["max_k"] == 2**62 + 3
