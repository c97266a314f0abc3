"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item.

Texts are sequences of lower-case words. Around every position at which a document might hold an item, windows
of the item's size are embedded by CGK: a walk through the window that repeats each word or moves on by a random
bit that depends on the word and the step, the same for all. Two sequences at a small edit distance fall into
step again after an edit, so they end up at a small Hamming distance. Bit-sampling LSH then takes a few positions
of the embedding as key; walks and samples are repeated until an item at the largest distance allowed is found
with probability ``recall`` or more. What shares a key with an item is verified by its exact edit distance.

Walks drift apart as the root of their length while one-sided edits add up with it, so long items are cut into parts of
``PART`` to less than twice as many words and windows are as long as those. Of a passage that holds an item, some
part has no larger share of edits than the whole; where a window shares a key with it, the whole item is verified around it.

Before that, windows that cannot match are left out without loss: an edit destroys at most two of an item's
pairs of neighbouring words, so a window needs the other pairs from the benchmark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyflow.llm.common import text_or_empty
from tallyflow.llm.text import mixed, word_hashes

WORD = re.compile(r"\w+")
#: Edits allowed, as a percentage of an item's words; items of fewer than 5 words match exactly.
EDIT_PERCENT = 20
#: Positions in a key, and how much larger than its share of edits a window's share of steps out of step may be.
POSITIONS, THROWN = 3, 3.0
RECALL = 0.999
#: Texts and windows that are looked at together.
TEXTS, WINDOWS = 10_000, 20_000
#: Bytes of all items' words that are handed to the tasks; a larger benchmark is taken in parts.
MOST_BYTES = 16 << 20
#: Words of the shortest part of an item that is cut.
PART = 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mixed_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def pairs_of(words: np.ndarray) -> np.ndarray:
    return mixed_pairs(words[:-1], words[1:])


def allowed(n: int) -> int:
    return n * EDIT_PERCENT // 100


def repetitions(recall: float = RECALL) -> int:
    """Keys until a pair at the largest distance shares one with probability ``recall``."""
    differ = min(0.9, THROWN * EDIT_PERCENT / 100)
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** POSITIONS))


def best_prefix(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int]:
    """The smallest edit distance between ``a`` and a beginning of ``b``, and how long that is (of equals, the one
    nearest to ``a`` in length); ``most + 1`` if it is larger."""
    steps = np.arange(len(b) + 1)
    row = steps
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        # The smallest over insertions: a running minimum of what each cell costs less its place.
        row = np.minimum.accumulate(np.concatenate(([i], best)) - steps) + steps
        if row.min() > most:
            return most + 1, 0
    n = int(np.lexsort((np.abs(steps - len(a)), row))[0])
    return int(min(row[n], most + 1)), n


def best_within(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int]:
    """The smallest edit distance between ``a`` and any part of ``b``, where that begins and how long it is; ``most + 1``
    if it is larger."""
    row = np.zeros(len(b) + 1, np.int64)
    steps = np.arange(len(b) + 1)
    for x in a:
        best = np.concatenate(([row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (b != x))))
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > most:
            return most + 1, 0, 0
    end = int(row.argmin())
    d, n = best_prefix(a[::-1], b[:end][::-1], int(row[end]))
    return d, end - n, n


def cuts(n: int) -> list[tuple[int, int]]:
    """Where the parts of an item of n words begin and end."""
    parts = max(1, n // PART)
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


def sampled_steps(length: int) -> int:
    """Steps of a walk that keys sample: those that walks seldom have left."""
    return max(1, 2 * length - length // 4)


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings of windows of one length, a row each; 0 once a walk is past the end."""
    n, length = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    at, first = np.zeros(n, np.int64), np.arange(n) * (length + 1)
    out = np.empty((sampled_steps(length), n), np.uint64)
    for step in range(len(out)):
        if step % 64 == 0:  # a random bit for each word and each of the next steps
            with np.errstate(over="ignore"):
                bits = mixed(padded + np.uint64((walk << 32) + step + 1)).ravel()
        place = first + at
        out[step] = padded.ravel()[place]
        at += (bits[place] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64)
        np.minimum(at, length, out=at)
    return out.T


def keys_of(windows: np.ndarray, repeats: int) -> np.ndarray:
    """An LSH key of each window for each repetition; four samples are taken of a walk."""
    n, length = windows.shape
    out = np.empty((n, repeats), np.uint64)
    for r in range(repeats):
        if r % 4 == 0:
            embedded = embed(windows, r // 4)
        picks = np.random.default_rng((length, r)).choice(embedded.shape[1], min(POSITIONS, length), replace=False)
        with np.errstate(over="ignore"):
            key = np.full(n, r + 1, np.uint64)
            for p in np.sort(picks):
                key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + embedded[:, p])
        out[:, r] = key
    return out


class Benchmark:
    """Items (``ids``, and ``texts`` as lists of words) ready for tasks."""

    def __init__(self, ids: list[int], texts: list[list[str]], repeats: int) -> None:
        words = [word_hashes(t) for t in texts]
        self.ids, self.words, self.repeats = ids, words, repeats
        self.vocabulary = {w: int(h) for t, hashes in zip(texts, words, strict=True) for w, h in zip(t, hashes, strict=True)}
        #: Item, place in it and words of each part.
        self.parts = [(i, first, w[first:end]) for i, w in enumerate(words) if len(w) for first, end in cuts(len(w))]
        pieces = [p for _, _, p in self.parts]
        self.lengths = sorted({len(w) for w in pieces})
        self.single = np.unique(np.concatenate([w for w in pieces if len(w) == 1] or [np.empty(0, np.uint64)]))
        # A table by hash tells of each pair of words in parts of which lengths it occurs, a bit for each
        # length modulo 64; what else falls on an entry only lets more windows through.
        pairs = [(pairs_of(w), np.uint64(len(w) % 64)) for w in pieces if len(w) > 1]
        self.table = np.zeros(1 << max(10, (32 * sum(len(p) for p, _ in pairs)).bit_length()), np.uint64)
        for p, bit in pairs:
            np.bitwise_or.at(self.table, self._slot(p), np.uint64(1) << bit)
        self.repeated = {n: max(len(p) - len(np.unique(p)) for p in (pairs_of(w) for w in pieces if len(w) == n)) for n in self.lengths if n > 1}
        #: For each length the sorted keys of parts, of all repetitions, and whose they are.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in self.lengths:
            here = np.array([k for k, w in enumerate(pieces) if len(w) == length], np.int32)
            keys = np.concatenate([keys_of(np.array([pieces[k] for k in here[at : at + WINDOWS]], np.uint64), repeats) for at in range(0, len(here), WINDOWS)])
            order = np.argsort(keys, axis=None, kind="stable")
            self.tables[length] = keys.ravel()[order], here[order // repeats]

    def read(self, text: str) -> np.ndarray:
        """The words of a text; 0 for those that no item has."""
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs & np.uint64(len(self.table) - 1)).astype(np.int64)

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length of items, where windows start that have as many pairs as a match must have."""
        if len(self.single):
            yield 1, np.flatnonzero(np.isin(words, self.single))
        if len(words) < 2:
            return
        both = np.flatnonzero((words[:-1] != 0) & (words[1:] != 0))
        pairs = mixed_pairs(words[both], words[both + 1])
        masks = self.table[self._slot(pairs)]
        hit = np.flatnonzero(masks)
        if not len(hit):
            return
        at, bits, pairs = both[hit], masks[hit], pairs[hit]
        counts = (bits[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0)
        for length in self.lengths:
            least = length - 1 - 2 * allowed(length)
            if length == 1 or counts[length % 64] < least:
                continue
            own = bits >> np.uint64(length % 64) & np.uint64(1) == 1
            known = at[own]
            if not (known[least - 1 :] - known[: len(known) - least + 1] <= length - 2).any():
                continue
            first = np.arange(max(1, len(words) - length + allowed(length) + 1))
            low, high = np.searchsorted(known, first), np.searchsorted(known, first + length - 1)
            enough = np.flatnonzero(high - low >= least)
            # A word list that repeats one known pair has only one of the item's.
            there, distinct = pairs[own], least - self.repeated[length]
            yield length, np.array([first[k] for k in enough.tolist() if len(set(there[low[k] : high[k]].tolist())) >= distinct], np.int64)

    def search(self, texts: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """For each text and item that match: the least distance, its place, and how many words there are."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: dict[tuple[int, int], list[int]] = {}
        wanted: dict[int, list[tuple[int, np.ndarray]]] = {}
        for t, words in enumerate(texts):
            for length, starts in self.windows(words):
                wanted.setdefault(length, []).append((t, starts))
        for length, places in wanted.items():
            owner = np.concatenate([np.full(len(starts), t) for t, starts in places])
            starts = np.concatenate([starts for _, starts in places])
            for at in range(0, len(starts), WINDOWS):
                self._match(texts, length, owner[at : at + WINDOWS].tolist(), starts[at : at + WINDOWS].tolist(), best, tried)
        return best

    def _match(self, texts: list[np.ndarray], length: int, owner: list[int], starts: list[int], best: dict, tried: dict) -> None:
        windows = np.zeros((len(owner), length), np.uint64)
        for row, (t, start) in enumerate(zip(owner, starts, strict=True)):
            part = texts[t][start : start + length]
            windows[row, : len(part)] = part
        known, whose = self.tables[length]
        keys = keys_of(windows, self.repeats).ravel()
        low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
        votes: Counter[tuple[int, int]] = Counter()
        for at in np.flatnonzero(high > low).tolist():
            votes.update((at // self.repeats, k) for k in whose[low[at] : high[at]].tolist())
        # The window that lies best shares most keys, and once it is verified the others end early.
        for (row, k), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            i, first, _ = self.parts[k]
            t, start, n = owner[row], starts[row], len(self.words[i])
            most = best[t, i][0] - 1 if (t, i) in best else allowed(n)
            if most < 0:
                continue
            if n == length:
                # A match may be shorter or longer than the item by as many words as it has edits.
                d, words = best_prefix(self.words[i], texts[t][start : start + length + most], most)
                if d <= most:
                    best[t, i] = d, start, words
                continue
            # The item begins where its part does less what stands before, give or take its edits and the window's place;
            # what was looked at for a window not further off than its edits holds that already.
            begin, reach = start - first, allowed(n)
            if any(abs(begin - other) <= reach for other in tried.setdefault((t, i), [])):
                continue
            tried[t, i].append(begin)
            left = max(0, begin - 2 * reach - length)
            d, at, words = best_within(self.words[i], texts[t][left : max(left, begin + n + 3 * reach + length)], most)
            if d <= most:
                best[t, i] = d, left + at, words


def contaminated(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id, item_id, edit_distance, first_word, n_words``: each row of ``docs`` (``doc_id``, ``text``) with each
    ``benchmark`` item (``item_id``, ``text``) it holds, at its best place.

    A passage holds an item of n words if its words are within ``n * EDIT_PERCENT div 100`` insertions, deletions
    and replacements of the item's. Null and empty texts hold nothing, null and empty items are in nothing.
    Repeated documents come out as often; equal ids of items count once for each text. Tasks get the items
    in parts of bounded size; extra columns are left behind; an empty table on either side gives an empty result.
    """
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    out = None
    for begin in searchers(benchmark, recall):

        def scan(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            known = begin()
            for batch in _slices(batches):
                ids = batch.column("doc_id").to_pylist()
                found = known.search([known.read(t) for t in batch.column("text").to_pylist()])
                rows = [
                    {"doc_id": ids[t], "item_id": known.ids[i], "edit_distance": d, "first_word": first, "n_words": n}
                    for (t, i), (d, first, n) in found.items()
                ]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edit_distance", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int32())]))

        part = text.mapInArrow(scan, "doc_id long, item_id long, edit_distance int, first_word long, n_words int")
        out = part if out is None else out.union(part)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS))


def searchers(benchmark: DataFrame, recall: float = RECALL) -> list[Callable[[], Benchmark]]:
    """What tasks call for the items that they search for, one for each part of bounded size."""
    repeats = repetitions(recall)
    usable = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_or_empty("text").alias("text")).distinct()
    size = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // MOST_BYTES))
    out = []
    for p in range(parts):
        items = [(r.item_id, words_of(r.text)) for r in usable.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).toLocalIterator()]
        items = [(i, w) for i, w in items if len(w)]
        shared = benchmark.sparkSession.sparkContext.broadcast(([i for i, _ in items], [w for _, w in items]))
        out.append(lambda shared=shared: Benchmark(*shared.value, repeats))
    return out


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns (of types that Arrow has), less the rows whose text holds an item.

    Each row is judged by its own text, whatever its id and whichever other rows have that id.
    """
    for begin in searchers(benchmark):

        def keep(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            known = begin()
            for batch in _slices(batches):
                held = {t for t, _ in known.search([known.read(t or "") for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([t not in held for t in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
