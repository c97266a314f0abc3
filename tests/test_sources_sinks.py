import pytest
from pyspark.sql import functions as F

from tallyflow.operators.aggregates import peak_memory
from tallyflow.plans.bulk_copy import bulk_copy
from tallyflow.session import scratch_path
from tallyflow.sinks import files as file_sinks, tables, topics as sinks
from tallyflow.sources import files, generators, topics


def write(path, text):
    path.mkdir(exist_ok=True)
    (path / "part-0.txt").write_text(text)
    return str(path)


def test_jsonl_skips_control_words_only(spark, tmp_path):
    good = '{"id":0,"u":1,"v":2}\n*COMMIT*\n{"id":1,"u":3,"v":4}\n'
    rows = files.scan_jsonl_edges(spark, write(tmp_path / "a", good)).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 1, 2), (1, 3, 4)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.scan_jsonl_edges(spark, write(tmp_path / "b", good + "{broken\n")).collect()


def test_text_parse_gives_nulls(spark, tmp_path):
    path = write(tmp_path / "t", '{"id":0,"u":1,"v":2}\n*COMMIT*\n')
    rows = files.scan_text_parse_json(spark, path).collect()
    assert sorted(rows, key=str) == sorted([(0, 1, 2), (None, None, None)], key=str)


def test_tsv(spark, tmp_path):
    rows = files.scan_edge_tsv(spark, write(tmp_path / "a", "# from\tto\n1\t2\n3\t4\n")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2), (3, 4)]
    for bad in ("1\t2\t3\n", "1\n", "x\t2\n"):
        with pytest.raises(Exception):
            files.scan_edge_tsv(spark, write(tmp_path / f"b{len(bad)}", "1\t2\n" + bad)).select("u").collect()


def test_csv_shards_read_python_booleans(spark, tmp_path):
    path = write(tmp_path / "c", "k,name,value,flag\n0,item_0,0.25,True\n1,item_1,0.5,False\n")
    assert sorted(tuple(r) for r in files.scan_csv_sharded(spark, path).collect()) == [
        (0, "item_0", 0.25, True), (1, "item_1", 0.5, False)
    ]


def test_engine_log(spark, tmp_path):
    def gauges(heap, nonheap, managed):
        return (
            f"x jobmanager.Status.JVM.Memory.Heap.Used: {heap}\n"
            f"x jobmanager.Status.JVM.Memory.NonHeap.Used: {nonheap}\n"
            f"x a.taskmanager.b.Status.JVM.Memory.Heap.Used: 999999\n"
            f"x m.Status.Flink.Memory.Managed.Used: {managed}\n"
        )

    log = (
        "2024-01-01 10:00:00,123 INFO Received JobGraph submission\n"
        + gauges(1, 2, 3) + "Finished metrics report\n"
        + gauges(5, 1, 1) + gauges(10, 20, 30) + "Finished metrics report\n"
        + "Finished metrics report\n"
        + "2024-01-01 10:01:30,999 INFO Job reached terminal state FINISHED\n"
        + gauges(1000, 1000, 1000)  # never reported
    )
    path = write(tmp_path / "log", log)
    row = peak_memory(files.scan_engine_log(spark, path)).first()
    assert (row["peak_bytes"], row["duration_s"]) == (60, 90)
    # the same when the file is read in many splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        lines = files.scan_engine_log(spark, path)
        assert lines.rdd.getNumPartitions() > 2
        again = peak_memory(lines).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(again) == tuple(row)


def test_marks_number_the_commits_of_any_split(spark):
    edges = spark.createDataFrame([(i, i % 7, i % 5) for i in range(400)], "id BIGINT, u BIGINT, v BIGINT")
    for start, step in ((100, 30), (0, 1), (1000, 10)):
        path = scratch_path(spark, "marked")
        generators.gen_marked_edges(edges.repartition(3), start, step, path, 5)
        marks = spark.read.text(path).where("value = '*COMMIT*'").count()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
        try:
            rows = files.scan_marked_edges(spark, path).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        want = {(i, i % 7, i % 5, 0 if i < start else (i - start) // step + 1) for i in range(400)}
        # Without a first commit of its own, numbers begin at the first mark.
        low = min(c for *_, c in want)
        assert {tuple(r) for r in rows} == {(i, u, v, c - low) for i, u, v, c in want} and len(rows) == 400
        assert marks == len({c for *_, c in want}) - (start > 400)
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        spark.createDataFrame([("*COMMIT*",), ("{bad",)], "value STRING").write.text(path + "-bad")
        files.scan_marked_edges(spark, path + "-bad").collect()


def test_bulk_copy_tells_what_did_not_arrive(spark):
    source = scratch_path(spark, "shards")
    generators.gen_kv_rows(spark, 60, 3).write.option("header", True).csv(source)

    def copied(change):
        target = scratch_path(spark, "target")
        return bulk_copy(spark, source, lambda rows: change(rows).write.parquet(target), lambda: spark.read.parquet(target)).first()

    row = copied(lambda rows: rows)
    assert row["ok"] and (row["count"], row["sum_k"], row["sum_diff"]) == (60, 59 * 30, 60)
    assert not copied(lambda rows: rows.where("k <> 7"))["ok"]
    assert not copied(lambda rows: rows.where("k <> 59"))["ok"]  # what is left is dense, but not all
    assert not copied(lambda rows: rows.union(rows.where("k = 3")))["ok"]


def test_generators_are_stable(spark):
    a, b = generators.gen_words(spark, 500, dict_size=50), generators.gen_words(spark, 500, dict_size=50).repartition(7)
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    words = [r[0] for r in a.collect()]
    assert all(len(w) == 7 and w.isalpha() and w.islower() for w in words)
    assert 40 <= len(set(words)) <= 50
    rows = generators.gen_kv_rows(spark, 100, 8)
    assert rows.rdd.getNumPartitions() == 8
    got = rows.collect()
    assert [r["k"] for r in got] == list(range(100)) and all(r["name"] == f"item_{r['k']}" for r in got)
    assert all(0 <= r["value"] < 1 for r in got) and {r["flag"] for r in got} == {True, False}


def test_changelog_nets_to_the_new_table(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word STRING, count BIGINT")
    new = spark.createDataFrame([("a", 1), ("b", 5), ("d", 1)], "word STRING, count BIGINT")
    rows = sinks.changelog_retractions(old, new, ["word"]).collect()
    assert sorted(tuple(r) for r in rows) == [("b", 2, -1), ("b", 5, 1), ("c", 3, -1), ("d", 1, 1)]
    keyless = "word STRING, count BIGINT"
    nulls = spark.createDataFrame([(None, 1), ("a", None)], keyless), spark.createDataFrame([(None, 1), ("a", 2)], keyless)
    rows = sinks.changelog_retractions(*nulls, ["word"]).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == [("a", 2, 1), ("a", None, -1)]
    lines = sinks.sink_changelog_dsv(old, new, ["word"], 9).collect()
    assert sorted(r["value"] for r in lines) == ["b,2,9,-1", "b,5,9,1", "c,3,9,-1", "d,1,9,1"]


def test_upserts(spark):
    path = scratch_path(spark, "upserts")

    def batch(*rows):
        return spark.createDataFrame(rows, "word STRING, count BIGINT")

    sinks.sink_upsert_keyed(batch(("a", 1), ("b", 1)), path, ["word"], 0)
    sinks.sink_upsert_keyed(batch(("a", 2)), path, ["word"], 1)
    sinks.sink_upsert_keyed(batch(("a", 2)), path, ["word"], 1)  # repeated after a failure
    sinks.sink_upsert_keyed(batch(("c", 7)), path, ["word"], 2)
    want = [("a", 2), ("b", 1), ("c", 7)]
    log = spark.read.parquet(path)
    assert sorted(tuple(r) for r in sinks.read_upserted(log, ["word"]).collect()) == want


def test_jdbc_options():
    pg = tables.jdbc_options("jdbc:postgresql://h/db", "t", writers=8)
    assert pg["driver"] == "org.postgresql.Driver" and pg["batchsize"] == "10000" and pg["numPartitions"] == "8"
    assert tables.jdbc_options("jdbc:sqlite:/x.db", "t", writers=1)["numPartitions"] == "1"
    assert tables.jdbc_options("jdbc:clickhouse://h/db", "t", tables.CLICKHOUSE_BATCH_ROWS)["batchsize"] == "100000"


def test_topic_options():
    opts = topics.kafka_options("h:1", "test_0", "earliest", "latest")
    assert opts == {"kafka.bootstrap.servers": "h:1", "subscribe": "test_0", "startingOffsets": "earliest", "endingOffsets": "latest"}
    assert topics.pulsar_options("u", "t", subscription="s") == {"service.url": "u", "topic": "t", "predefinedSubscription": "s"}
    assert topics.pulsar_options("u", "t", start_from="beginning")["startingOffsets"] == "earliest"


def test_json_round_trip_and_null_sink(spark):
    rows = generators.gen_kv_rows(spark, 50, 4)
    back = sinks.topic_rows(rows).select(F.from_json("value", files.KV_SCHEMA).alias("r")).select("r.*")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert file_sinks.sink_null(rows) == {"rows": 50}
