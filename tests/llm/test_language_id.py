from collections import Counter

import numpy as np
import pytest

from tallyflow.llm import language_id as li
from tallyflow.llm.queries import op12_language_id
from tallyflow.llm.text import mixed

ROWS = "doc_id long, text string, lang string, n int, score string"


def plain_grams(text):
    """n-grams of a text by loops, as buckets."""
    row = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or row[-1]:
            row.append(code)
    if row[-1]:
        row.append(0)
    out = Counter()
    for n in range(1, li.LONGEST + 1):
        for i in range(len(row) - n + 1):
            gram = row[i : i + n]
            if gram != [0]:
                h = np.array([gram[0] + 1], np.uint64)
                for c in gram[1:]:
                    h = np.array([c + 1], np.uint64) + mixed(h)
                out[int(mixed(h)[0] % np.uint64(li.BUCKETS))] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 18])
def test_grams_against_plain_code(monkeypatch, chunk):
    monkeypatch.setattr(li, "CHUNK", chunk)
    with np.errstate(over="ignore"):
        for text in ("", "a", "--", "Ab, cd!", "  x  1 2 yz  ", "straße Ünï 漢字 x" * 3, "a\ud800b", "a" * 20):
            want, got = plain_grams(text), li.counts_of(text)
            assert (got is None) == (not any(c.isalpha() for c in text))
            if got is not None:
                assert {k: int(got[k]) for k in np.flatnonzero(got)} == want


def test_document_frequencies_and_weights(spark):
    texts = ["ab ab", "ab", "xyz", "--", "", None, "ab"]
    seen = li.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = Counter(b for t in texts for b in plain_grams(t or ""))
    assert {k: int(seen[k]) for k in np.flatnonzero(seen[:-1])} == want and seen[-1] == 4
    used, weight = li.weighted(li.counts_of("ab ab"), np.ones(li.BUCKETS))
    assert abs(np.linalg.norm(weight) - 1) < 1e-6 and weight.max() / weight.min() == pytest.approx(1 + np.log(2))


def test_clusters_find_apart_groups():
    rng = np.random.default_rng(0)
    middles = np.linalg.qr(rng.normal(size=(20, 20)))[0][:4]
    x = np.concatenate([m + 0.05 * rng.normal(size=(30, 20)) for m in middles]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ((li.clusters(x) @ middles.T).max(axis=0) > 0.95).all()
    assert len(li.clusters(x[:1])) == 1


def test_odd_rows_rejection_and_clashing_columns(spark):
    xx, yy = "the cat sat on the mat with a hat ", "zorq vlik pshu qwok xilp zzut "
    rows = [(k, xx * (1 + k % 3) + "abcdefgh"[k % 8], "xx", 1, "s") for k in range(60)]
    rows += [(100 + k, yy * (1 + k % 3) + "klmnopqr"[k % 8], "yy", 1, "s") for k in range(60)]
    rows += [(None, None, None, None, None), (300, "", "xx", 1, "s"), (301, "12 34 !", "yy", 1, "s"), (302, xx * 20_000, None, 1, "s"), (302, yy, None, 1, "s"), (303, "漢字漢字", None, 1, "s")]
    got = li.languages(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    for r in got:
        if r.doc_id is None or r.doc_id in (300, 301):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id < 200:
            assert r.lang_pred == ("xx" if r.doc_id < 100 else "yy") and 0.8 < r.score <= 1
    assert sorted(r.lang_pred for r in got if r.doc_id == 302) == ["xx", "yy"]
    assert [(r.lang_pred in ("xx", "yy"), r.rejected) for r in got if r.doc_id == 303] == [(True, True)]


def test_nothing_to_learn(spark):
    assert li.languages(spark.createDataFrame([], ROWS)).count() == 0
    rows = [(1, "words", None, 1, "s"), (2, None, "xx", 1, "s"), (3, "...", "xx", 1, "s")]
    assert {r.lang_pred for r in li.languages(spark.createDataFrame(rows, ROWS)).collect()} == {"und"}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op12_language_id(spark, sf).collect()]
    assert len(rows) == len(known)
    told = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(told) > 250
    assert sum(r.lang_pred == known[r.doc_id] for r in told) >= 0.97 * len(told)
    assert sum(r.rejected for r in told) <= 0.05 * len(told)
