"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Every bucket of words has a fixed sparse random index vector. The vector of a bucket is the sum of the index
vectors of the words that stand beside its words, over all documents, so words of like company have like
vectors. A document is the mean of its words' vectors; a network with one hidden layer, in numpy, tells good from
poor documents, and a temperature fitted on labelled documents apart from those it was trained on makes its
outputs probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyflow.llm.common import fold, stage, text_or_empty
from tallyflow.llm.text import mixed, sampled_labels, word_hashes
from tallyflow.session import shuffle_width

#: Labelled documents that the network is trained on, at most.
LABELLED = 12_000
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0
#: Buckets of words, numbers of a vector, entries of an index vector that are not zero, words to each side.
BUCKETS, DIM, ENTRIES, REACH = 1 << 14, 64, 2, 2
POOLED = 2 * DIM + 3
#: Words of texts that are looked at together.
CHUNK = 1 << 20
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4

#: Words, and runs of signs; both tell good prose from junk.
TOKENS = re.compile(r"\w+|[^\w\s]+")


def buckets_of(text: str) -> np.ndarray:
    return (word_hashes(TOKENS.findall(text)) % np.uint64(BUCKETS)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector; they follow from the bucket's number."""
    with np.errstate(over="ignore"):
        h = mixed(np.arange(BUCKETS * ENTRIES, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, ENTRIES)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def company(ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each bucket the sum of the index vectors of its words' neighbours, in a row; -1 parts the texts of ``ids``."""
    total = np.zeros(BUCKETS * DIM)
    for step in range(1, REACH + 1):
        a, b = ids[:-step], ids[step:]
        ok = (a >= 0) & (b >= 0)
        for between in range(1, step):
            ok &= ids[between : len(ids) - step + between] >= 0
        a, b = a[ok], b[ok]
        for x, y in ((a, b), (b, a)):
            for e in range(ENTRIES):
                total += np.bincount(x * DIM + places[y, e], signs[y, e], BUCKETS * DIM)
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from the neighbours of every word of ``docs`` (``text``).

    A task adds up its own table of ``BUCKETS * DIM`` numbers and Spark adds the tables, whose size is fixed.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIM)

        def learn(ids: np.ndarray) -> None:
            np.add(total, company(ids, places, signs), out=total)

        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = buckets_of(text)
                held += [ids, np.array([-1])]
                n += len(ids)
                if n > CHUNK:
                    learn(np.concatenate(held))
                    held, n = [], 0
        if held:
            learn(np.concatenate(held))
        table = total.reshape(BUCKETS, DIM)
        used = np.flatnonzero(np.abs(table).sum(axis=1))
        for at in range(0, len(used), 2048):
            part = used[at : at + 2048]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([x.astype("<f4").tobytes() for x in table[part]], pa.binary())], names=["bucket", "part"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[bucket] = sums.get(bucket, 0) + np.frombuffer(part, "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["bucket", "total"])


    parts = docs.select(text_or_empty("text").alias("text")).mapInArrow(add, "bucket int, part binary")
    merged = parts.repartition(shuffle_width(docs.sparkSession), "bucket").mapInArrow(merge, "bucket int, total binary")
    vectors = np.zeros((BUCKETS, DIM))
    for row in merged.collect():  # BUCKETS rows at most
        vectors[row.bucket] = np.frombuffer(row.total)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's words, and how its words repeat; zeros without words."""
    ids = buckets_of(text)
    if not len(ids):
        return np.zeros(POOLED, np.float32)
    counts = np.bincount(ids, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    weight = (counts[used] / len(ids)).astype(np.float32)
    mean = weight @ vectors[used]
    again = (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0.0
    repeats = np.array([again, np.sqrt((weight**2).sum()), np.log1p(len(ids))], np.float32)
    return np.concatenate([mean, np.sqrt(np.maximum(weight @ vectors[used] ** 2 - mean**2, 0)), repeats])


class Network:
    """One hidden layer of rectified units and one output, trained by Adam; deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        order = rng.permutation(len(x))
        apart, train = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-4
        self.p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        z, target = (x[train] - self.mean) / self.scale, y[train].astype(float)
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(len(train)), max(1, len(train) // BATCH)):
                a, t = z[batch], target[batch]
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - t) / len(batch)
                back = np.outer(d, self.p[2]) * (h > 0)
                grads = [a.T @ back + DECAY * self.p[0], back.sum(axis=0), h.T @ d + DECAY * self.p[2], np.array([d.sum()])]
                step += 1
                for q, g, mi, vi in zip(self.p, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    q -= RATE * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(apart):
            logits, truth = self.logits(x[apart]), y[apart]
            losses = {t: np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean() for t in np.geomspace(0.25, 8, 41)}
            self.temperature = min(losses, key=losses.get)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0)
        return h @ self.p[2] + self.p[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _pooling(vectors):
    """The vectors of texts, as a function over batches that keeps the other columns."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(t, vectors.value).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(x, pa.binary())], names=[*kept, "x"])

    return pool


def quality(docs: DataFrame, labels: DataFrame, most_labelled: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``).

    Labels (``doc_id``, ``quality``) are learned from rows outside the held-out fold only, at most
    ``most_labelled``; word vectors are counted over all texts. A null or empty text is scored as a text without words.
    With labels of one kind, or none, every score is the share of 1 among them (one half without any). Repeated rows and
    null ids come out as they are; extra columns are left behind.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    labelled = stage(sampled_labels(labels, "quality", MODULUS, HELD_OUT, most_labelled), "labelled")
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(labelled), "doc_id").select("y", "text")
    trained = rows.mapInArrow(_pooling(vectors), "y int, x binary").groupBy("x", "y").count().collect()  # copies count once
    trained.sort(key=lambda r: (bytes(r.x), r.y))
    y = np.array([r.y for r in trained])
    if len(set(y.tolist())) == 2 and len(y) >= 10:
        network = context.broadcast(Network(np.array([np.frombuffer(r.x, "<f4") for r in trained], np.float64), y))
    else:
        network = context.broadcast(float(y.mean()) if len(y) else 0.5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = network.value
        for batch in batches:
            x = np.array([pooled(t, vectors.value) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, POOLED)
            scores = np.full(len(x), model) if isinstance(model, float) else model.probabilities(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    whole = docs.select("doc_id", (fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), text_or_empty("text").alias("text"))
    done = whole.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return done.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
