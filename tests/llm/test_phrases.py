import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyflow.llm import phrases as ph

ROWS = "doc_id long, text string, lang string, n int, score string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, top):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for w in pieces_of(text):
            words[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in some.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items())
            if not inside:
                score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, words[lang], -s))
    return sorted(out)


def texts_of(seed, docs, words):
    rng = random.Random(seed)
    some = [*(f"w{k}" for k in range(words)), "É", "漢字", "A-b", "x\x00y", "日" * 40]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice([rng.choice(some[:6]), rng.choice(some), "Of The Best Kind", "the", "the the"]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]))
        out.append(("".join(parts), rng.choice(["en", "fr", None, "und"])))
    return out


@pytest.mark.parametrize("budget,held,least,top", [(1_000_000, 1 << 21, 3, 50), (5, 40, 4, 10_000), (40, 200, 2, 20)])
def test_against_brute_force(spark, monkeypatch, budget, held, least, top):
    rows = texts_of(budget, 120, 12)
    monkeypatch.setattr(ph, "BUDGET", budget)
    monkeypatch.setattr(ph, "HELD", held)
    docs = spark.createDataFrame([(1, t, lang, 1, "x", "y") for t, lang in rows], ROWS).repartition(5)
    got = ph.collocations(docs, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def words_of(texts, chunk, monkeypatch):
    monkeypatch.setattr(ph, "CHUNK", chunk)
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    out = []
    for w, _ in ph._words(iter([batch.slice(1)])):
        pairs = set(list(w.grams([], 2))[1][0].tolist())
        for k in range(len(w.hash)):
            out.append((w.hash[k], w.data[w.begin[k] : w.end[k]].tobytes().decode().translate(LOWER), k in pairs))
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 16, 64, 1 << 19])
def test_words_at_every_cut(monkeypatch, chunk):
    rng = random.Random(chunk)
    texts = ["skipped", "", "one", " two", "three ", "a", "b", "", ".", "Long" * 60, "x" * 100 + " y", "B a", "a b.c  d\te\n\x0bf", "é" * 50]
    texts += ["".join(rng.choice("ab .\t") for _ in range(rng.randrange(90))) for _ in range(40)]
    got = words_of(texts, chunk, monkeypatch)
    want = [(w, k + 1 < len(p)) for t in texts[1:] for p in pieces_of(t) for k, w in enumerate(p)]
    assert [(w, on) for _, w, on in got] == want
    by_word = {}
    for h, w, _ in got:
        by_word.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)
    assert {w: h for h, w, _ in got} == {w: h for h, w, _ in words_of(texts, 1 << 19, monkeypatch)} if chunk != 1 << 19 else True


def test_groups_keep_to_the_budget():
    counts = {k: (k * 37) % 50 + 1 for k in range(200)}
    placed = ph.packed(counts, 50, 7)
    assert placed.keys() == counts.keys() and min(placed.values()) == 7
    sums = Counter()
    for c, g in placed.items():
        sums[g] += counts[c]
    assert max(sums.values()) <= 50 and len(sums) <= 2 * sum(counts.values()) / 50 + 1


def test_prefixes_are_extended_and_kept_together(spark):
    rows = np.array([(1, k % 40 + 2, k % 7, 0, 0) for k in range(400)] + [(5, 0, 0, 0, 0)] * 4, np.uint64)
    batch = ph._blocks(rows, np.full(len(rows), 3), np.zeros(len(rows), np.int64), ["x"], 1)
    blocks = spark.createDataFrame([tuple(r.values()) for r in batch.to_pylist()], ph.BLOCK_SQL)
    placed, groups = ph.partitioned(blocks, 30)
    where, seen = {}, 0
    for r in placed.collect():
        words, n = np.frombuffer(r.rows, np.uint64).reshape(-1, 5), np.frombuffer(r.n, np.int64)
        assert len(words) == r["size"] == len(n) and set(n) == {3} and r.group < groups and r.lang == "x"
        seen += len(words)
        for w in words.tolist():
            assert r.depth == (2 if w[0] == 1 else 1)
            where.setdefault(tuple(w[: r.depth]), set()).add(r.group)
    assert seen == 404 and all(len(g) == 1 for g in where.values()) and len(where) == 41


def test_products_beyond_64_bits(spark):
    # A score whose products pass 64 bits, by the same expression: 1000 a n / (l r).
    row = spark.sql("select cast(9e14 as decimal(16,0)) a, cast(9000000000000001 as decimal(16,0)) n, cast(9e14 as decimal(16,0)) l, cast(900000000000000 as decimal(16,0)) r")
    assert row.selectExpr("(cast(1000 as decimal(4,0)) * a * n) div (l * r) as s").first().s == 1000 * 9 * 10**14 * 9000000000000001 // (9 * 10**14) ** 2


def test_empty_null_and_long(spark):
    empty = spark.createDataFrame([], ROWS)
    assert ph.collocations(empty, 2, 5).count() == 0
    rows = [(1, None, None, 1, "x", "y"), (2, "", "en", 1, "x", "y"), (3, " .,\n", "en", 1, "x", "y"), (4, "so it goes " * 60_000, "en", 1, "x", "y"), (4, "z" * 3_000_000, None, 1, "x", "y")]
    got = ph.collocations(spark.createDataFrame(rows, ROWS), 100, 5).collect()
    assert {r.n for r in got} == {180_000}
    best = {tuple(r.phrase.split()): r.a for r in got}
    # Of five words each, the three turns of the text; the first begins once more often than the last.
    assert best == {("so", "it", "goes", "so", "it"): 59_999, ("it", "goes", "so", "it", "goes"): 59_999, ("goes", "so", "it", "goes", "so"): 59_998, ("so", "it", "goes"): 60_000}
