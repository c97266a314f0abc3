import numpy as np

from tallyflow.llm import quality as q
from tallyflow.llm.queries import op6_quality

DOCS = "doc_id long, text string, y int, x string"
LABELS = "doc_id long, quality int, toxic int"


def test_vectors_are_sums_of_the_neighbours():
    texts = ["a b c d e", "b a b", "", "x", "a!! b", "y"]
    places, signs = q.index_vectors()
    want = np.zeros((q.BUCKETS, q.DIM))
    joined = []
    for t in texts:
        ids = q.buckets_of(t)
        joined += [ids, np.array([-1])]
        for i, x in enumerate(ids):
            for j in range(max(0, i - q.REACH), min(len(ids), i + q.REACH + 1)):
                if j != i:
                    for e in range(q.ENTRIES):
                        want[x, places[ids[j], e]] += signs[ids[j], e]
    got = q.company(np.concatenate(joined), places, signs).reshape(q.BUCKETS, q.DIM)
    assert np.allclose(got, want) and want.any()


def test_network_is_calibrated_and_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-3 * (x[:, 0] * x[:, 1])))
    y = (rng.random(3000) < p).astype(int)
    got = q.Network(x[:2000], y[:2000]).probabilities(x[2000:])
    assert np.abs(got - p[2000:]).mean() < 0.15
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        inside = (got >= lo) & (got < hi)
        assert abs(y[2000:][inside].mean() - got[inside].mean()) < 0.12


def test_odd_rows_and_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, None, 1, "a"), (2, "", 1, "a"), (None, "some words", 1, "a"), (3, "w " * 200_000, 1, "a"), (3, "again", 1, "a")], DOCS)
    for labels, want in (([(1, 1, 0), (2, 1, 0)], 1.0), ([], 0.5), ([(None, 1, 1), (4, None, 1)], 0.5)):
        got = q.quality(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 5 and {r.score for r in got} <= {want, 0.5} and all(r.predicted == 1 for r in got)
    assert q.quality(docs.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op6_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = sum((rows[r.doc_id].score >= 0.5) == bool(r.quality) for r in labels)
    assert right >= 0.93 * len(labels) and len(labels) > 40
