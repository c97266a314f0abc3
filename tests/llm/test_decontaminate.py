import random

import numpy as np
import pytest

from tallyflow.llm import decontaminate as d
from tallyflow.llm.queries import op3_decontaminate

DOCS = "doc_id long, text string, item_id int, words string"
ITEMS = "item_id long, text string, doc_id int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def least(item, text):
    """The smallest distance from an item to any passage of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def words(t):
    return d.WORD.findall((t or "").lower())


def run(spark, docs, items):
    df = spark.createDataFrame([(*r, 1, "w") for r in docs], DOCS)
    return d.contaminated(df, spark.createDataFrame([(*r, 1) for r in items], ITEMS)).collect()


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[at : at + (kind != 0)] = [f"new{rng.randrange(999)}"] if kind < 2 else []
    return w


def test_best_prefix():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64) for _ in range(2))
        want = min(distance(a.tolist(), b[:n].tolist()) for n in range(len(b) + 1))
        d_, n = d.best_prefix(a, b, 20)
        assert d_ == want == distance(a.tolist(), b[:n].tolist())
        assert d.best_prefix(a, b, 2)[0] == min(3, want)


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(10, 50)))) for i in range(40)]
    docs = []
    for n in range(160):
        filler = rng.choices(vocabulary, k=rng.randrange(0, 80))
        item = words(rng.choice(items)[1])
        passage = edited(rng, item, rng.randrange(0, len(item) // 5 + 3)) if n % 4 else []
        docs.append((n, ". ".join(filler[:30] + passage + filler[30:]).title()))
    got = {(r.doc_id, r.item_id): r for r in run(spark, docs, items)}
    want = {}
    for i, t in docs:
        for k, item in items:
            w = words(item)
            best = least(w, words(t))
            if best <= len(w) // 5:
                want[i, k] = best
    assert set(got) <= set(want)
    assert len(got) >= 0.98 * len(want) and len(want) > 80
    texts = dict(docs)
    for (i, k), r in got.items():
        passage = words(texts[i])[r.first_word : r.first_word + r.n_words]
        assert distance(words(dict(items)[k]), passage) == r.edit_distance >= want[i, k]
    assert all(key in got and got[key].edit_distance == 0 for key, best in want.items() if best == 0)


def test_best_within():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(2))
        want = least(a.tolist(), b.tolist())
        got, at, n = d.best_within(a, b, 20)
        assert got == want == distance(a.tolist(), b[at : at + n].tolist())
        assert d.best_within(a, b, 2)[0] == min(3, want)


@pytest.mark.parametrize("kind", ["insertions", "deletions", "replacements"])
@pytest.mark.parametrize("length", [40, 150, 300, 500])
def test_recall_by_length_and_kind_of_edit(length, kind):
    rng = random.Random(f"{length} {kind}")
    items = [[f"w{rng.randrange(5000)}" for _ in range(length)] for _ in range(50)]
    known = d.Benchmark(list(range(len(items))), items, d.repetitions())
    texts = []
    for item in items:
        w = list(item)
        for at in sorted(rng.sample(range(length), length // 5), reverse=True):
            w[at : at + (kind != "insertions")] = [] if kind == "deletions" else [f"x{rng.randrange(999)}"]
        texts.append([f"w{rng.randrange(5000)}" for _ in range(60)] + w + [f"w{rng.randrange(5000)}" for _ in range(60)])
    got = known.search([known.read(" ".join(t)) for t in texts])
    # Exactly as many edits as are allowed, so each text holds its item.
    assert sum((k, k) in got for k in range(len(items))) >= 0.98 * len(items)
    for (t, i), (far, first, n) in list(got.items())[:5]:
        assert distance(items[i], texts[t][first : first + n]) == far <= length // 5


def test_nulls_and_short_and_repeated(spark):
    items = [(1, "solo"), (2, "two words"), (3, None), (4, ""), (5, "a b c d e f g h"), (5, "other text of the same id"), (None, "null item id here ok")]
    docs = [(1, None), (2, ""), (3, "Solo"), (4, "here two WORDS"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "x a b c d x f g h y"),
            (6, "null item id here ok"), (7, "w " * 300_000 + "a b c d e f g h"), (8, "!!")]
    got = sorted(((r.doc_id, r.item_id, r.edit_distance) for r in run(spark, docs, items)), key=repr)
    want = [(3, 1, 0), (4, 2, 0), (5, 5, 0), (5, 5, 0), (6, None, 0), (7, 5, 0), (None, 5, 1)]
    assert got == sorted(want, key=repr)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_without_items_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 7, "x"), (2, "clean", 8, "y"), (None, "clean too", 9, "z")], DOCS)
    items = spark.createDataFrame([(5, "a b c d e f g h", 1)], ITEMS)
    assert sorted((tuple(r) for r in d.without_items(docs, items).collect()), key=repr) == [(2, "clean", 8, "y"), (None, "clean too", 9, "z")]


def test_given_documents(spark, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op3_decontaminate(spark, sf).collect()}
    exact = {(i, k) for i, t in docs.items() for k, item in items.items() if " ".join(words(item)) in " ".join(words(t))}
    assert exact and exact <= got
    for i, k in got - exact:
        assert least(words(items[k]), words(docs[i])) <= len(words(items[k])) // 5
