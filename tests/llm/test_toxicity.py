import time
from collections import Counter

from pyspark.sql import functions as F

from tallyflow.llm import toxicity as t
from tallyflow.llm.queries import op2_toxicity

DOCS = "doc_id long, text string, y int, score string"
LABELS = "doc_id long, toxic int, quality int"


def model(words):
    c = Counter()
    for w in words:
        m = t.EDGE * 2 + w + t.EDGE
        c.update(m[i : i + 3] for i in range(len(m) - 2))
    return t.Restorer({g: 50 * n for g, n in c.items()})


def test_restores_leetspeak_repetition_and_spacing():
    r = model(["idiot", "moron", "stupid", "scum", "loser", "the", "and", "house", "table", "pathetic", "letter"])
    for seen, meant in {
        "1d10t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "l0$er": "loser", "i d i o t": "idiot", "m.o.r.o.n": "moron",
        "i-d-i-o-t": "idiot", "idiooooot": "idiot", "stuuuupid": "stupid", "p@th3tic": "pathetic", "id*iot": "idiot",
    }.items():
        assert meant in r.words(f"you {seen} there"), (seen, r.words(f"you {seen} there"))
    assert r.words("plain letters left alone, aa bb. 17.57.238.115 555-9629") == {"plain", "letters", "left", "alone"}
    assert len(r.words("a1" * 5000)) > 0


def test_runs_hold_digits_and_several_words():
    known = ["idiot", "moron", "stupid", "scum", "loser", "the", "and", "house", "table", "pathetic", "letter", "a", "you", "are"]
    r = model(known)
    for seen, meant in {
        "a m o r o n": {"moron"}, "m 0 r 0 n": {"moron"}, "s t u p 1 d": {"stupid"}, "$ t u p i d": {"stupid"}, "i d i o t m o r o n": {"idiot", "moron"},
        "i d i o t  s c u m": {"idiot", "scum"}, "y o u a r e a l 0 s e r": {"you", "are", "loser"}, "m0r0n_1d10t": {"moron", "idiot"},
        "t h e h o u s e a n d t h e t a b l e a n d t h e m o r o n": {"house", "table", "moron"},
        "-".join("the house and the table and the letter and the house and a m0r0n".split()): {"moron"},
    }.items():
        assert meant <= r.words(f"x. {seen} ,there"), (seen, r.words(f"x. {seen} ,there"))
    assert r.words("1 2 3 4 5 6") == set()
    long = " ".join("thehouse" * 500 + "moron" + "thetable" * 500)
    assert {"house", "moron", "table"} <= set(r.of_spaced(long))


def test_long_tokens_are_read_in_linear_time():
    began = time.monotonic()
    for token in ("ab" * 500_000 + "_", "1" * 1_000_000, "a" + "." * 1_000_000, "!," * 500_000, "a" * 1_000_000 + "_"):
        list(t.SUSPICIOUS.finditer(token))
    assert time.monotonic() - began < 20


def corpus(spark):
    clean = [f"the house and table number{i} letter word{i % 7} again" for i in range(120)]
    toxic = [f"the moron and table thing{i} letter word{i % 7} again" for i in range(60)]
    rows = [(i, x, 1, "s") for i, x in enumerate(clean + toxic)]
    rows += [(1000, "the m0r0n and table", 1, "s"), (1001, "m o r o n here", 1, "s"), (1002, None, 1, "s"), (1003, "", 1, "s"), (None, "moron", 1, "s"), (5, "moron", 1, "s"), (1004, "word " * 100_000, 1, "s")]
    labels = [(i, int(i >= 120), 1) for i in range(180)] + [(7, 0, 1), (None, 1, 1), (8, None, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_scores_restored_words_and_keeps_odd_rows(spark):
    docs, labels = corpus(spark)
    got = t.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.score >= t.THRESHOLD) for r in got}
    assert {(1000, True), (1001, True), (1002, False), (1003, False), (None, True), (5, True), (5, False), (1004, False)} <= by
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= t.THRESHOLD) for r in got)
    kept = t.without_toxic(docs.where("doc_id >= 1000 or doc_id is null"), labels)
    assert kept.columns == docs.columns


def test_trigrams_beyond_those_of_all_tasks_count_the_same(spark, monkeypatch):
    """Rare ones tell l from i in 1oser; also letters beyond 16 bits, many parts, rows that repeat and a column named as the helper."""
    docs, labels = corpus(spark)
    docs = docs.withColumn("text", F.expr("replace(replace(text, 'moron', 'loser'), 'm0r0n', '1oser')"))
    wide = [(2000 + i, f"\U00010400\U00010401{i % 3}\U00010402 1oser$ and 1 o s e r{i % 5}", 1, "s") for i in range(20)]
    docs = docs.unionByName(spark.createDataFrame([*wide, *wide[:3]], DOCS)).withColumn("Part_of_texts", F.lit(1)).repartition(3)
    row = lambda frame: sorted(map(repr, frame.collect()))
    scores, kept = row(t.toxicity(docs, labels)), row(t.without_toxic(docs, labels))
    assert t.toxicity(docs, labels).where("doc_id = 1000").first().predicted == 1
    monkeypatch.setattr(t, "MOST_GRAMS", 6)
    monkeypatch.setattr(t, "PART", 300)
    assert row(t.toxicity(docs, labels)) == scores and row(t.without_toxic(docs, labels)) == kept
    every = t.grams_for_tasks(docs).others
    assert every.where("length(gram) = 3").count() > 6 and every.count() == every.select("gram").distinct().count()
    parts = t.in_parts(docs.select("text"), "part", 300)
    assert parts.select("part").distinct().count() > 20 and parts.drop("part").count() == docs.count()


def test_empty_tables(spark):
    docs, labels = corpus(spark)
    assert t.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in t.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op2_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    hits = sum(rows[r.doc_id].predicted for r in labels if r.toxic)
    assert hits >= 0.7 * sum(r.toxic for r in labels) > 0
    assert sum(rows[r.doc_id].predicted for r in labels if not r.toxic) <= 0.15 * len(labels)
