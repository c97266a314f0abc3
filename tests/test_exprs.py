import pytest
from pyspark.sql import functions as F

from tallyflow.functions import exprs


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("total,start,step", [(20, 5, 3), (20, 1, 1), (20, 20, 4), (20, 100, 1), (17, 4, 5), (9, 8, 100)])
def test_batch_of_id_equals_the_marking_rule(spark, total, start, step):
    want, commit = {}, 0
    for i in range(total):
        want[i] = commit
        written = i + 1
        if written >= start and (written - start) % step == 0:
            commit += 1
    got = dict(values(spark, [(i,) for i in range(total)], "id BIGINT", "id", exprs.batch_of_id("id", start, step)))
    assert got == want


def test_floor_div_is_exact_and_rounds_down(spark):
    big = 2**62 + 1
    rows = [(-7, 2), (7, 2), (-8, 2), (0, 3), (big, 3)]
    got = values(spark, rows, "a BIGINT, b BIGINT", exprs.floor_div("a", "b"))
    assert [g[0] for g in got] == [a // b for a, b in rows]


def test_ts_from_id(spark):
    got = values(spark, [(0,), (3,), (4,)], "id BIGINT", F.unix_millis(exprs.ts_from_id("id", 3)))
    assert [g[0] for g in got] == [1, 1, 4]


def test_pointer_key_tells_values_apart(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("1:a", ""), ("1", ":a")]
    got = values(spark, rows, "x STRING, y STRING", exprs.pointer_key("x", "y"))
    assert len(set(got)) == len(rows)


def test_update_lines(spark):
    lines = [
        ('"word","count","time","diff"\n"cat",3,100,1', ("cat", 3, 100)),
        ("cat,3,100,-1", None),
        ("cat,3,-D", None),
        ("cat,3", ("cat", 3, None)),
        ("cat,3,100,1\n", ("cat", 3, 100)),
        ('"word","count"', None),
        ("*FINISH*", None),
        ("*COMMIT*", None),
    ]
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(lines)], "i INT, value STRING")
    kept = exprs.filter_control_rows(df).select("i", exprs.count_update("value").alias("r")).select("i", "r.*")
    got = {r[0]: tuple(r)[1:] for r in kept.collect()}
    assert got == {i: v[1] for i, v in enumerate(lines) if v[1] is not None}


def test_tokens(spark):
    got = values(spark, [("The cat, the CAT!  2x",), ("",), (None,)], "t STRING", exprs.tokens("t"))
    assert got == [(["the", "cat", "the", "cat", "x"],), ([],), (None,)]


def test_concat_fields_skips_nothing_but_nulls(spark):
    assert values(spark, [("a", 1), (None, 2)], "w STRING, n BIGINT", exprs.concat_fields(["w", "n"])) == [("a,1",), ("2",)]


def test_filename_meta(spark):
    name = "wordcount-1700.5-1-8-20-1000-200000-unaware-c1-e1-5000-0-0-10"
    paths = [f"file:/r/flink/{name}-latency.csv", f"file:/r/flink/{name}-latency.csv/part-00000-aa-bb.txt"]
    rows = exprs.filename_meta(spark.createDataFrame([(p,) for p in paths], "path STRING")).collect()
    for r in rows:
        assert (r["engine"], r["benchmark"], r["throughput"], r["engine_version"], r["recorded_dataset_size"]) == (
            "flink", "wordcount", "200000", "e1", "10"
        )
