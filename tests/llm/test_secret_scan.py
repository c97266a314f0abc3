import re

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import secret_scan as s
from tallyflow.llm.queries import op1_secret_scan

DOCS = "doc_id long, text string, source string, findings int, score string"
TRUE = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')


def known(text):
    return {(m.start(), len(m.group())) for m in TRUE.finditer(text or "")}


def test_finds_the_secrets_of_the_documents_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in op1_secret_scan(spark, sf).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.n_chars))
    want = {i: k for i, t in texts.items() if (k := known(t))}
    assert len(want) > 5
    exact = {i: t for i, t in texts.items() if i in want}
    first = {i: {min((t.find(t[a : a + n]), n) for _ in (0,)) for a, n in want[i]} for i, t in exact.items()}
    assert all(first[i] <= got.get(i, set()) for i in first)
    assert not [(i, texts[i][a : a + n]) for i in got for a, n in got[i] - first.get(i, set()) if re.fullmatch("[A-Za-z]+", texts[i][a : a + n])]


def documents(spark):
    key = "AKIA" + "Z9Y8X7W6V5U4T3S2"
    rows = [(i, f"the thereofthereofthere and ofthethereandthere word{i} of the password=a1b2c3d4e5f6a7b8{i:02d} and of", "src", 1, "s") for i in range(40)]
    rows += [(100, None, "src", 1, "s"), (101, "", None, 1, "s"), (None, f"{key} and {key}, (again) $1", "src", 1, "s"),
             (7, "plain", "src", 1, "s"), (102, "the of " * 30_000 + key, "a/test/b", 1, "s"), (103, "clean thereofthereofthere", "src", 1, "s")]
    return spark.createDataFrame(rows, DOCS), key


def test_redaction_keeps_all_else(spark):
    docs, key = documents(spark)
    got = s.redacted(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r.doc_id: r.text for r in got.where("doc_id is null or doc_id >= 100").collect()}
    assert by == {100: None, 101: "", None: "[SECRET] and [SECRET], (again) $1", 102: "the of " * 30_000 + "[SECRET]", 103: "clean thereofthereofthere"}
    assert got.where("text like '%a1b2c3%'").count() == 0


def test_no_python_in_the_plan(spark, capsys):
    docs, _ = documents(spark)
    s.secrets(docs).explain()
    assert not re.search("Python|Pandas|Arrow|MapIn", capsys.readouterr().out)


def test_the_expression_is_the_forest(spark):
    docs, _ = documents(spark)
    dictionary = s.dictionary_of(docs)
    labelled = s.labelled_by_form(docs, dictionary)
    model = s.train(labelled)
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=list(s.FEATURES), outputCol="v").transform(labelled.withColumn("x", F.struct(*s.FEATURES)))
    for r in x.select("v", s.forest_score(model, F.col("x")).alias("score")).collect():
        assert r.score == pytest.approx(sum(t.predict(r.v) for t in model.trees) / len(model.trees))


def test_empty_and_unlabelled(spark):
    docs, key = documents(spark)
    assert s.secrets(docs.limit(0)).count() == 0
    none = s.labelled_by_form(docs.limit(0), [])
    assert s.secrets(docs.where("doc_id is null"), none).count() == 1


def test_every_place_has_a_span_of_its_own(spark):
    docs, key = documents(spark)
    sevens = "0a1b2c3d4e5f6a7b70"
    many = " é😀 ".join(f"{'=' * (i % 3)}Abcdefghijklmnop{i:04d}" for i in range(700))
    late = f"line the {sevens} of log and then password={sevens} and"
    more = spark.createDataFrame([(200, late, "src", 1, "s"), (201, f"{key},{key} {key}", "src", 1, "s"), (202, many, "src", 1, "s")], DOCS)
    docs = docs.union(more)
    got = {}
    for r in s.secret_spans(docs).where("doc_id in (200, 201)").collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.n_chars))
    n = len(sevens)
    assert got == {200: {(late.find(sevens), n), (late.rfind(sevens), n)}, 201: {(0, 20), (21, 20), (42, 20)}}
    assert {r.text for r in s.redacted(docs).where("doc_id = 200").collect()} == {late.replace(sevens, "[SECRET]")}
    all_of = s.secret_spans(more, s.labelled_by_form(docs.limit(0), []))
    places = {(r.doc_id, r.start, r.n_chars) for r in all_of.collect()}
    assert places == {(r.doc_id, m.start(), len(m.group())) for r in more.collect() for m in re.finditer(s.SHAPE, r.text)} and len(places) == 705


def test_every_place_in_the_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text like '%token = \"%'")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {(i, m.start()) for i, t in texts for m in re.finditer('(?<=token = ")[0-9a-f]{40}', t)}
    labelled = s.labelled_by_form(docs, [])
    assert want <= {(r.doc_id, r.start) for r in s.secret_spans(docs, labelled).collect()}
    assert len(want) > len({(i, t[a : a + 40]) for i, a in want for j, t in texts if i == j})
