import random

import numpy as np
import pytest

from tallyflow.llm import jaccard
from tallyflow.llm.text import WORDS, LOWER_ASCII

SCHEMA = "doc_id long, text string, fp binary, n int, tokens string"


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER_ASCII))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, b"x", 1, "t") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=repr)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"] if rng.random() < 0.7 else []
    return w


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = [(None, "A b C"), (1, "a B c"), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "one two three four five six seven eight nine"),
            (7, "one two three four five six seven eight nine ten"), (8, "one two three four five six seven eight"), (9, "É b"), (10, "é b"), (11, "one")]
    n = 20
    for length in (5, 6, 7, 8, 9, 10, 12, 20, 30, 60, 200, 900):
        base = [f"w{rng.randrange(40 if length < 30 else 10**5)}" for _ in range(length)]
        for edits in (0, 0, 1, 1, 2, 3, max(1, length // 40), max(1, length // 25)):
            rows.append((n, " ".join(edited(rng, base, edits))))
            n += 1
    for _ in range(25):  # little of their own beside a passage that many share
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 12, 40]))]
        rows.append((n, " ".join(passage + own)))
        n += 1
    rows += [(30, rows[40][1]), (31, "x" * 200_000), (30, rows[41][1])]
    return rows


@pytest.mark.parametrize("bounds", [(64, 4096), (3, 8), (1, 2)])
def test_no_link_is_lost(spark, monkeypatch, bounds):
    monkeypatch.setattr(jaccard, "CLASS_BOUNDS", bounds)
    rows = corpus(sum(bounds))
    assert run(spark, rows) == brute(rows)


def test_small_vocabularies(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(4, 12)))) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("bounds", [(64, 4096), (2, 5), (1, 1)])
def test_linked_sets_share_a_signature(monkeypatch, bounds):
    monkeypatch.setattr(jaccard, "CLASS_BOUNDS", bounds)
    rng = np.random.default_rng(sum(bounds))
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        universe = rng.integers(1, 1 << 60, 3 * n + 5).astype(np.uint64)
        df = {int(t): int(rng.integers(2, 9)) for t in universe}
        x = np.unique(universe[rng.permutation(len(universe))[:n]])
        out = int(rng.integers(0, n // 5 + 1))
        y = np.unique(np.concatenate([x[out:], universe[rng.permutation(len(universe))[: int(rng.integers(0, n // 5 + 2))]]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or not both:
            continue
        own = {int(t) for t in np.setxor1d(x, y) if rng.random() < 0.5}
        s = []
        for z in (x, y):
            shared = np.array([t for t in z if int(t) not in own], np.uint64)
            s.append(set(jaccard.signatures(len(z), shared, np.array([df[int(t)] for t in shared])).tolist()))
        assert s[0] & s[1]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(0, 300))).astype(np.uint64) for _ in range(2))
        bits = np.unpackbits((jaccard.sketch_of(x) ^ jaccard.sketch_of(y)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(x, y))


def test_linked_sets_share_a_long_combination():
    rng = np.random.default_rng(12)
    linked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 150))
        universe = rng.integers(1, 1 << 60, 3 * n + 5).astype(np.uint64)
        x = np.unique(universe[rng.permutation(len(universe))[:n]])
        out = int(rng.integers(0, n // 5 + 1))
        y = np.unique(np.concatenate([x[out:], universe[rng.permutation(len(universe))[: int(rng.integers(0, n // 5 + 2))]]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or not both:
            continue
        linked += 1
        own = {int(t) for t in np.setxor1d(x, y) if rng.random() < 0.5}
        (home_x, above_x), (home_y, above_y) = (
            [set(c.tolist()) for c in jaccard.long_combinations(len(z), np.array([t for t in z if int(t) not in own], np.uint64))] for z in (x, y)
        )
        assert home_x & home_y or home_x & above_y or above_x & home_y
    assert linked > 1000


def test_bands_of_sizes():
    for n in range(1, 3000):
        b = jaccard.band_of(n)
        assert 5**b <= n * 4**b and n * 4 ** (b + 1) < 5 ** (b + 1)
        assert jaccard.band_of(5 * n // 4) in (b, b + 1)


def test_frequencies_in_two_bytes_keep_order_and_class():
    df = np.unique(np.concatenate([np.arange(1, 10_000), np.geomspace(10_000, 1e12, 5_000).astype(np.int64)]))
    short = jaccard.rounded(df).astype(np.int64)
    assert (np.diff(short) >= 0).all() and (short[df <= jaccard.EXACT_DF] == df[df <= jaccard.EXACT_DF]).all()
    assert (jaccard.class_of_frequency(short) == jaccard.class_of_frequency(df)).all()


def test_first_of_each_fingerprint():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 3, (500, 3)).astype("<u4")
    seen: set = set()
    expected = [tuple(f) not in seen and not seen.add(tuple(f)) for f in fps.tolist()]
    assert jaccard.first_of_each(fps).tolist() == expected
    assert jaccard.first_of_each(fps[:0]).tolist() == []


def test_sets_with_more_tokens_in_a_bucket_than_one_byte_counts(spark):
    words = [f"w{i}" for i in range(40_000)]
    near, far = words[:], words[:]
    near[::500] = [f"x{i}" for i in range(80)]
    far[::20] = [f"y{i}" for i in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "short " * 3), (5, " ".join(words))]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    assert {r.doc_id: r.n_shingles for r in out} == {1: 39_996, 2: 39_996, 3: 39_996, 4: 1, 5: 39_996}
