import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyflow.llm import decontaminate, toxicity
from tests.llm.test_decontaminate import least, words
from tests.llm.test_jaccard import brute
from tests.llm.test_secret_scan import TRUE
from tests.llm.test_tokens import tiktoken_encoding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_is_what_plain_code_gives(spark, sf):
    """Only the learned toxicity score is taken from the operator."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    kept = {r.doc_id: rows[r.doc_id] for r in scores if not r.predicted}
    kept = {i: kept[i] for i, _, component in brute(sorted(kept.items())) if component == i}
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if all(least(w, words(t)) > len(w) // 5 for w in items)}
    enc = tiktoken_encoding()
    want = {i: enc.encode_ordinary(TRUE.sub("[SECRET]", t)) for i, t in kept.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want) and 0 < len(want) < len(rows)
    assert all(got[i].n_tokens == len(got[i].ids) for i in got)
    assert all(list(got[i].ids) == want[i] for i in want)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, sf, k):
    name, function = corpus_pipeline.STAGES[k]
    odd = [(None, None, None, None, None), (-1, "", "en", None, 0), (-2, "plain words of no group at all here", None, "s", 1), (None, "x" * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    out = function(spark, docs, sf)
    assert out.count() == 4
    assert out.columns == (COLUMNS if k < 4 else ["doc_id", "n_tokens", "ids"])
    assert function(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_own_columns_of_clashing_names_stay(spark, sf, k):
    own = [(1, "password = \"0a1b2c3d4e5f6a7b70\" in a text", "a", 7, "r1"), (2, "plain words of no group at all here", None, 8, "r2"), (None, None, "c", None, None)]
    docs = spark.createDataFrame(own, "doc_id long, text string, source string, findings int, ROW_OF_STAGE string")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf)
    assert out.columns == docs.columns
    values = lambda df: sorted((tuple(r) for r in df.drop("text").collect()), key=repr)
    assert values(out) == values(docs)


@pytest.mark.parametrize("shared", [None, 7])
def test_rows_are_told_apart_without_ids(spark, sf, shared):
    """A bad and a clean row of the same id, or of none, have each their own fate."""
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    kept = lambda function, texts: sorted(
        (r.text for r in function(spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(texts)], docs)).collect()), key=str
    )
    clean = "plain words of no group at all here"
    labels = spark.createDataFrame([(i, int(i < 140)) for i in range(100, 200)], "doc_id long, toxic int")
    taught = [(i, f"the {'moron' if i < 140 else 'house'} thing{i} number{i}") for i in range(100, 200)]
    rest = kept(lambda d: toxicity.without_toxic(d, labels), [*taught, (shared, clean), (shared, "what a moron"), (shared, None)])
    assert {clean, None} <= set(rest) and "what a moron" not in rest
    item = spark.createDataFrame([(5, "a b c d e f g h")], "item_id long, text string")
    texts = [(shared, clean), (shared, "x a b c d e f g h y"), (shared, None)]
    assert kept(lambda d: decontaminate.without_items(d, item), texts) == [None, clean]
    one = " ".join(f"w{k}" for k in range(40))
    texts = [(shared, one), (shared, one), (shared, one + " more"), (shared, clean), (shared, None), (shared, ""), (shared, "")]
    assert len(kept(lambda d: corpus_pipeline.drop_near_duplicates(spark, d, sf), texts)) == 5
    texts = [(None, one), (9, one + " more"), (3, one + " end"), (3, one + " end")]
    assert kept(lambda d: corpus_pipeline.drop_near_duplicates(spark, d, sf), texts) == [one + " end"]


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" not in entry.oracle_sql()
