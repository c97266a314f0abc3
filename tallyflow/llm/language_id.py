"""Language identification: nearest of several clustered centroids per language, over TF-IDF vectors of letter n-grams.

A text is its letters, folded to lower case, with one gap between runs of them; its n-grams are the one to three
neighbours in that row, counted in ``BUCKETS`` buckets by hash. A vector holds ``(1 + log tf) * idf``, normalised to length
one, where the document frequencies are counted over *all* documents that may be learned from. Each language gets
``CLUSTERS`` centroids: spherical k-means over at most ``SAMPLE`` distinct documents of the language finds them, and a
pass over all documents of the language settles them: every document joins its nearest centroid, the mean of those is
the centroid, and the spread of their distances says how far a text of that language may be from it. A text is of the
language of the nearest centroid by cosine; one farther from it than the spread allows is marked ``rejected``.

A task's memory holds tables of fixed size: buckets times centroids, of at most ``LANGUAGES`` languages.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyflow.llm.common import fold
from tallyflow.llm.text import mixed
from tallyflow.session import shuffle_width

MODULUS, HELD_OUT = 3, 1
UNKNOWN = "und"
BUCKETS, LONGEST = 1 << 14, 3
#: Centroids of a language, distinct documents of it that k-means looks at, its rounds.
CLUSTERS, SAMPLE, ROUNDS = 4, 400, 10
#: The most frequent languages are learned, this many at most.
LANGUAGES = 256
#: Standard deviations above the mean distance from which a text is rejected.
FAR = 4.0
#: Letters that are looked at together; tables of sums that a task holds before it passes them on.
CHUNK, TABLES = 1 << 18, 64


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its own number if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def _folded(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Letters of a text with 0 for each gap, in parts, and how many of a part's letters were in the one before."""
    last = np.zeros(0, np.uint32)
    for at in range(0, len(text), CHUNK):
        codes = _letters()[np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        # The text begins and ends with a gap.
        codes = np.concatenate([last if at else [0], codes, [0] * (at + CHUNK >= len(text))]).astype(np.uint64)
        gap_again = np.zeros(len(codes), bool)
        gap_again[1:] = (codes[1:] == 0) & (codes[:-1] == 0)
        codes = codes[~gap_again]
        yield codes, len(last)
        last = codes[1 - LONGEST :]


def counts_of(text: str | None) -> np.ndarray | None:
    """How often each bucket of n-grams occurs in a text; None without a letter. A gap alone is no n-gram."""
    total, letters = np.zeros(BUCKETS, np.int64), False
    with np.errstate(over="ignore"):
        for codes, known in _folded(text or ""):
            letters = letters or bool(codes.any())
            codes = codes + np.uint64(1)  # mixed(0) is 0, and a gap must not be like nothing
            h, places = codes, []
            for n in range(LONGEST):
                if n:
                    h = codes[n:] + mixed(h[:-1])  # h ends with the letter at n and later
                # A gram that ends among letters of the part before is counted there.
                new = h[max(known - n, 0) :]
                places.append(new[new != 1] if n == 0 else new)
            total += np.bincount((mixed(np.concatenate(places)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return total if letters else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, a vector of length one."""
    used = np.flatnonzero(counts)
    weight = (1 + np.log(counts[used])) * idf[used]
    return used, (weight / np.linalg.norm(weight)).astype(np.float32)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the tables (``table``, doubles) of each key, which is a row a task at most; any number of rows is merged one by one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, part in zip(rows, batch.column("table").to_pylist(), strict=True):
                sums[key] = sums.get(key, 0) + np.frombuffer(part)
        for key, total in sums.items():
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | {"table": total.tobytes()}], schema=schema)

    kinds = dict(parts.dtypes)
    schema = pa.schema([(k, pa.string() if kinds[k] == "string" else pa.int32()) for k in keys] + [("table", pa.binary())])
    dealt = parts.repartition(shuffle_width(parts.sparkSession), *keys)
    return dealt.mapInArrow(merge, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", table binary")


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """For each bucket the number of texts that have it, and at the end the number of texts with a letter."""
    step = BUCKETS // 64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + step)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = counts_of(text)
                if counts is not None:
                    total[:BUCKETS] += counts > 0
                    total[BUCKETS] += 1
        tables = [total[at : at + step].tobytes() for at in range(0, BUCKETS + step, step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tables)), pa.int32()), pa.array(tables, pa.binary())], names=["part", "table"])

    total = np.zeros(BUCKETS + step)
    for r in _added(texts.select("text").mapInArrow(add, "part int, table binary"), ["part"]).collect():
        total[r.part * step : (r.part + 1) * step] = np.frombuffer(r.table)
    return total[: BUCKETS + 1]


def clusters(x: np.ndarray) -> np.ndarray:
    """Spherical k-means over the rows of ``x``: centroids of length one, at most ``CLUSTERS``; seeds lie far apart."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(CLUSTERS, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        c = np.array([x[at == k].sum(axis=0) for k in range(len(c)) if (at == k).any()])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c.astype(np.float32)


def seeds_of(texts: DataFrame, idf: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """``lang, centroids`` by k-means over at most ``SAMPLE`` distinct texts of each of the learned languages."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("used", pa.binary()), ("weight", pa.binary())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of the sample, so bounded
        for batch in batches:
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                counts = None if (lang, h) in seen else counts_of(text)
                seen.add((lang, h))
                if counts is not None:
                    used, weight = weighted(counts, idf)
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "h": h, "used": used.astype(np.int32).tobytes(), "weight": weight.tobytes()}], schema=schema)

    def cluster(rows: pa.Table) -> pa.Table:
        x = np.zeros((rows.num_rows, BUCKETS), np.float32)
        order = np.argsort(rows.column("h").to_numpy())
        for k, at in enumerate(order.tolist()):
            x[k, np.frombuffer(rows.column("used")[at].as_py(), np.int32)] = np.frombuffer(rows.column("weight")[at].as_py(), np.float32)
        found = [c.tobytes() for c in clusters(x)]
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(found)), "c": pa.array(found, pa.binary())})

    hashed = texts.withColumn("h", F.xxhash64("text"))
    distinct = hashed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    known = distinct.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    first = Window.partitionBy("lang").orderBy("h")
    sample = distinct.join(F.broadcast(known), "lang").withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE)
    # At most LANGUAGES * SAMPLE rows of a name and a number.
    chosen = hashed.join(F.broadcast(sample.select("lang", "h")), ["lang", "h"]).select("lang", "h", "text")
    told = chosen.mapInArrow(vectors, "lang string, h long, used binary, weight binary").groupBy("lang", "h")
    rows = told.agg(F.first("used").alias("used"), F.first("weight").alias("weight")).groupBy("lang").applyInArrow(cluster, "lang string, c binary")
    found: dict[str, list[np.ndarray]] = {}
    for r in rows.collect():  # LANGUAGES * CLUSTERS rows at most
        found.setdefault(r.lang, []).append(np.frombuffer(r.c, np.float32))
    return [(lang, np.array(found[lang])) for lang in sorted(found)]


class Centroids:
    """Centroids as columns, the language of each, and the least cosine that its texts reach."""

    def __init__(self, langs: list[str], columns: np.ndarray, least: np.ndarray, idf: np.ndarray) -> None:
        self.langs, self.columns, self.least, self.idf = langs, np.ascontiguousarray(columns, np.float32), least, idf

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is too far from it; of equal ones the first language."""
        counts = counts_of(text)
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, True
        used, weight = weighted(counts, self.idf)
        cosines = weight @ self.columns[used]
        at = int(cosines.argmax())
        return self.langs[at], min(max(float(cosines[at]), 0.0), 1.0), bool(cosines[at] < self.least[at])


def learned(texts: DataFrame) -> Centroids:
    """Centroids from ``lang, text``: a part of the texts seeds them, all texts settle them."""
    seen = document_frequencies(texts)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    seeds = seeds_of(texts, idf)
    context = texts.sparkSession.sparkContext
    of_lang, idf_everywhere = context.broadcast(dict(seeds)), context.broadcast(idf)
    step = BUCKETS // 16
    schema = pa.schema([("lang", pa.string()), ("cluster", pa.int32()), ("part", pa.int32()), ("table", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, k), total in held.items():
                tables = [total[at : at + step].tobytes() for at in range(0, len(total), step)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(tables)), pa.array([k] * len(tables), pa.int32()), pa.array(range(len(tables)), pa.int32()), pa.array(tables, pa.binary())],
                    schema=schema,
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seed = of_lang.value.get(lang)
                counts = counts_of(text) if seed is not None else None
                if counts is None:
                    continue
                used, weight = weighted(counts, idf_everywhere.value)
                cosines = seed[:, used] @ weight
                k = int(cosines.argmax())
                if (lang, k) not in held:
                    if len(held) == TABLES:
                        yield from flush()
                    held[lang, k] = np.zeros(BUCKETS + 3)
                total = held[lang, k]
                total[used] += weight
                total[BUCKETS:] += [1, cosines[k], cosines[k] ** 2]
        yield from flush()

    totals: dict[tuple[str, int], list[bytes]] = {}
    parts = texts.select("lang", "text").mapInArrow(add, "lang string, cluster int, part int, table binary")
    for r in _added(parts, ["lang", "cluster", "part"]).toLocalIterator():  # 17 parts of each centroid
        totals.setdefault((r.lang, r.cluster), [b""] * 17)[r.part] = bytes(r.table)
    names, columns, least = [], [], []
    for (lang, _), tables in sorted(totals.items()):
        total = np.frombuffer(b"".join(tables))
        n, s, squares = total[BUCKETS:]
        names.append(lang)
        columns.append(total[:BUCKETS] / np.linalg.norm(total[:BUCKETS]))
        least.append(s / n - FAR * math.sqrt(max(squares / n - (s / n) ** 2, 0.0)))
    return Centroids(names, np.array(columns).reshape(-1, BUCKETS).T, np.array(least), idf)


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Learned from text and language of the rows outside the held-out fold that have both. ``lang_pred`` is a learned
    language, also where the text is rejected for its distance, and ``und`` (score 0, rejected) for a null text, one
    without a letter, or where nothing could be learned. ``score`` is the cosine with the nearest centroid. Of equally
    near centroids the first language counts. Repeated rows and null ids are rows like others; a null id is in fold 0;
    extra columns are left behind; an empty table gives an empty result.
    """
    known = docs.where((fold("doc_id", MODULUS) != HELD_OUT) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(learned(known.select("lang", "text")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.nearest(t) for t in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select("doc_id", (fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")
