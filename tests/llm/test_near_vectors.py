import numpy as np
import pytest

from tallyflow.llm import near_vectors as nv
from tallyflow.llm.components import components
from tallyflow.llm.queries import op9_near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, values string, n int"


def brute(rows, t=0.9):
    """(id, n_links, component, kept) of each row, all pairs compared."""
    unit = []
    for _, v, *_ in rows:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.abs(v).max() if ok else None)
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t - 1e-12] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=repr)


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in nv.near_vectors(df, **k).collect()), key=repr)


def test_given_embeddings(spark, sf):
    got = sorted((tuple(r) for r in op9_near_vectors(spark, sf).collect()), key=repr)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows)



def test_nulls_lengths_copies_and_scale(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(int(i), v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + int(i), (v * 5 + rng.normal(size=8) * 0.3).tolist()) for i, v in enumerate(base)]
    rows += [(3, base[3].tolist()), (None, base[4].tolist()), (None, [9.0, 9.0, 1.0]), (50, [9.0, 9.0, 1.0]), (51, [1e-200, 0.0, -0.0]), (52, [1e200, 0.0, 0.0])]
    rows += [(60, None), (61, []), (62, [0.0] * 8), (63, [None] + [1.0] * 7), (64, [float("nan")] + [1.0] * 7), (65, [float("inf")] + [1.0] * 7), (66, [5.0]), (67, [2.0]), (68, [-2.0])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert nv.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("tile", [7, 1024])
def test_dense_group_and_many_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(nv, "TILE", tile)
    rng = np.random.default_rng(5)
    center = rng.normal(size=32)
    rows = [(i, (center + rng.normal(size=32) * 0.2).tolist()) for i in range(60)] + [(i, rng.normal(size=32).tolist()) for i in range(60, 90)]
    assert run(spark, rows) == brute(rows)


def test_leading_dimensions_lose_nothing():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(200, 48)) * np.linspace(3, 0.1, 48)
    b = np.concatenate([a[:50] + rng.normal(size=(50, 48)) * 0.1, rng.normal(size=(100, 48))])
    a, b = nv._unit(a), nv._unit(b)
    axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    got = set(zip(*(x.tolist() for x in nv.linked_in_tiles(a, b, axes, 0.8)), strict=True))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.8)), strict=True)) and got


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3), (130, 100), (5, 4)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
