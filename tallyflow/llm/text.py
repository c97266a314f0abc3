"""Words of texts as numbers, and sampling of labelled rows."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyflow.llm.common import fold

#: A-Z only, as against lower(), which also turns other letters.
LOWER_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Words a worker remembers; the table is emptied when full.
REMEMBERED = 500_000


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number depends on all of its bits (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_labels(labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """``doc_id, y``: at most ``most`` labelled ids outside the held-out fold, those with the smallest hashes.

    An id with several labels counts as 1 if any of them is; null ids and null labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", modulus) != held_out))
    one = known.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
