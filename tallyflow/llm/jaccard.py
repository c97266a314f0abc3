"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct word 5-grams. Documents with the same set of tokens are
one class, known by a 96-bit fingerprint of the set.

1. Frequencies. Tasks send each token to the bucket of its hash, packed into one row for each bucket and batch.
   A bucket counts in how many classes a token occurs. Only tokens of two classes or more can be shared, so
   only those go back, with the class and the frequency; classes with too few of them link with nothing.
2. Prefixes. A class with n tokens can miss at most ``n - ceil(0.8 n)`` of them in a set that links with it. Its tokens
   are put in one global order, rare ones first, and a prefix is extended until so many misses still leave a
   signature: rare tokens are signatures by themselves, tokens of frequency class k only as combinations of k
   from the same of ``G`` groups by hash (so that their number grows with the set, not with a power of it), of
   which a group with m tokens in the prefix loses all only if it misses ``m - k + 1``. Two sets that link have a
   signature in common. ``G`` follows from a set's size; a set is signed for every ``G`` that one it may link with
   can have. Sets of up to ``TINY`` tokens also use the combinations of all and of all but one of their tokens.
3. Pairs. First each signature's most central class is paired with the others that have it, which is linear in their
   number, and verified pairs are joined into components. Where a signature has classes of several components, those
   classes are signed again by longer combinations, of all tokens of a part of a set, as many parts as make sure
   that two sets that link have one in common. Under these, the classes outside a signature's largest component are
   paired with those of other components; sketches of the sets, which go with the signatures, give a lower bound of
   how much two sets differ, and pairs that exceed what is allowed are not made.
4. Pairs are verified by the tokens that are not in one class only: the intersection holds no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyflow.llm.common import stage, text_or_empty
from tallyflow.llm.components import components
from tallyflow.llm.text import HASHES, LOWER_ASCII, WORDS, mixed, word_hashes
from tallyflow.session import shuffle_width

NGRAM, PERCENT = 5, 80
#: Most classes in which a token of frequency class 1 and 2 occurs; beyond, tokens are of class 3.
CLASS_BOUNDS = (64, 4096)
#: Sets so small that no prefix is certain to hold a combination.
TINY = 6
#: 64-bit words of a sketch.
SKETCH = 8
#: Tokens of a set for each group of its frequent tokens.
GROUP = 12
#: Tokens of a batch that are sent to the buckets together.
BATCH_TOKENS = 1_000_000
#: What is sent to a bucket besides its number: a share of the documents, and of the classes the tokens that fall in it.
#: A class's size goes to the first of its buckets only, which ``sized`` marks; counts from ``MANY`` on are in ``many``.
PACKED = ("ids", "null_ids", "doc_sizes", "doc_fps", "fps", "sized", "sizes", "counts", "many", "low", "high")
MANY = 255
#: Bytes of a fingerprint.
FP = 12
#: Frequencies are exact up to this one; beyond, to a sixty-fourth of a power of two.
EXACT_DF = 4096
#: What a bucket sends to the place where the tokens of a class are put together.
RETURNED = ("fps", "sizes", "held", "low", "high", "df")
COUNTED = ["doc_id", "n", "fp", "target", "bucket", *RETURNED]

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def tokens_of(text: str) -> np.ndarray:
    """Sorted distinct token hashes: of the 5-grams, or of the whole sequence where it is shorter."""
    words = WORDS.findall(text.translate(LOWER_ASCII))
    h = word_hashes(words)
    if len(h) >= NGRAM:
        n = len(h) - NGRAM + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(n, np.uint64)
            for i in range(NGRAM):
                sums += h[i : i + n] * _MULTIPLIERS[i]
            return np.unique(mixed(sums))
    if len(h):
        with np.errstate(over="ignore"):
            # The length keeps a short sequence from meeting a 5-gram or one of another length.
            return np.unique(mixed(np.array([sum(int(x) * int(m) for x, m in zip(mixed(h), _MULTIPLIERS, strict=False)) + len(h) & (1 << 64) - 1], np.uint64)))
    return np.empty(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> bytes:
    """96 bits of a set."""
    with np.errstate(over="ignore"):
        halves = (mixed(tokens).sum(dtype=np.uint64), mixed(tokens ^ _MULTIPLIERS[0]).sum(dtype=np.uint64))
    return np.array(halves, "<u8").tobytes()[:FP]


def needed(n: int) -> int:
    """One more than a set of n tokens can miss."""
    return n - -(-PERCENT * n // 100) + 1


def class_of_frequency(df: np.ndarray) -> np.ndarray:
    return 1 + sum((df > bound).astype(np.int64) for bound in CLASS_BOUNDS)


def rounded(df: np.ndarray) -> np.ndarray:
    """Frequencies in two bytes, in the same order and on the same side of each class bound."""
    beyond = EXACT_DF + np.ceil(64 * np.log2(np.maximum(df, EXACT_DF) / EXACT_DF)).astype(np.int64)
    return np.where(df > EXACT_DF, np.minimum(np.maximum(beyond, EXACT_DF + 1), 0xFFFF), df).astype("<u2")


def first_of_each(fps: np.ndarray) -> np.ndarray:
    """Whether a fingerprint (three numbers) is the first of its kind."""
    order = np.lexsort(fps.T)
    new = np.ones(len(fps), bool)
    new[1:] = (fps[order[1:]] != fps[order[:-1]]).any(axis=1)
    chosen = np.zeros(len(fps), bool)
    chosen[order[new]] = True
    return chosen


def groups_for(n: int) -> int:
    """A power of two of about a twelfth of the set."""
    return 1 << max(0, (n // GROUP).bit_length() - 1)


def signatures(n: int, tokens: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Signatures of a class: ``tokens`` are those in two classes or more, with their frequencies."""
    need = needed(n) - (n - len(tokens))  # a token that no other class has is missed for certain
    if need <= 0:
        return np.empty(0, np.uint64)
    order = np.lexsort((tokens, df))
    tokens, kinds = tokens[order], class_of_frequency(df[order])
    out = []
    for groups in {groups_for(-(-PERCENT * n // 100)), groups_for(n), groups_for(100 * n // PERCENT)}:
        with np.errstate(over="ignore"):
            salted = mixed(tokens * _MULTIPLIERS[1] + np.uint64(groups))
        # Rare tokens are groups of their own.
        group = np.where(kinds == 1, -1 - np.arange(len(tokens)), (salted % np.uint64(groups)).astype(np.int64) * 4 + kinds)
        by_group = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[by_group], prepend=group[by_group[0]] - 1))
        rank = np.empty(len(tokens), np.int64)
        rank[by_group] = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens)))) + 1
        kept = np.cumsum(rank >= kinds)
        end = min(len(tokens), int(np.searchsorted(kept, need)) + 1)
        out.append(tokens[:end][kinds[:end] == 1])
        members: dict[int, list[int]] = {}
        for i in np.flatnonzero(kinds[:end] > 1).tolist():
            members.setdefault(int(group[i]), []).append(i)
        for k in (2, 3):
            picks = [c for g, m in members.items() if g % 4 == k for c in combinations(m, k)]
            if picks:
                at = np.array(picks, np.int64)
                with np.errstate(over="ignore"):
                    out.append(mixed(sum(salted[at[:, c]] for c in range(k)) + np.uint64(k)))
    if n <= TINY and len(tokens) >= n - 1:
        with np.errstate(over="ignore"):
            each = mixed(tokens + np.uint64(77))
            whole = each.sum(dtype=np.uint64)
            subsets = whole - each if len(tokens) == n else each[:0]
            out.append(mixed(np.append(subsets, whole)))
    return np.unique(np.concatenate(out))


def counted(docs: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts.

    With ``target`` null: ``doc_id, n, fp`` of each document; fp is null without words. Else what a ``bucket`` has for the
    classes of a ``target``: how many tokens that other classes have too, these and their frequencies; ``sizes`` has the
    number of all tokens of a class in the first of its buckets, else 0.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        doc_sizes: list[int] = []
        doc_fps: list[bytes] = []
        fps: list[bytes] = []
        sets: list[np.ndarray] = []
        known: set[bytes] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(t) for t in sets], np.int64)
            tokens = np.concatenate([*sets, np.empty(0, np.uint64)])
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
            bucket = tokens % np.uint64(width)
            home = np.minimum.reduceat(bucket, np.cumsum(lengths) - lengths) if len(sets) else bucket
            order = np.argsort(bucket, kind="stable")
            tokens, owner, ends = tokens[order], owner[order], np.searchsorted(bucket[order], np.arange(width + 1))
            del bucket, order
            for b in range(width):
                t, o = tokens[ends[b] : ends[b + 1]], owner[ends[b] : ends[b + 1]]
                mine = slice(b * len(ids) // width, (b + 1) * len(ids) // width)
                if len(t) or ids[mine]:
                    here, counts = np.unique(o, return_counts=True)
                    rest, sized = t // np.uint64(width), home[here] == b
                    packed = (
                        np.array([i or 0 for i in ids[mine]], "<i8"), np.array([i is None for i in ids[mine]], "u1"), np.array(doc_sizes[mine], "<u4"),
                        b"".join(doc_fps[mine]), b"".join(fps[i] for i in here), np.packbits(sized), lengths[here][sized].astype("<u4"), np.minimum(counts, MANY).astype("u1"), counts[counts >= MANY].astype("<u4"),
                        (rest & np.uint64(0xFFFFFFFF)).astype("<u4"), (rest >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2"),
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in packed)], names=["bucket", *PACKED]
                    )
            for x in (ids, doc_sizes, doc_fps, fps, sets, known):
                x.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                tokens = tokens_of(text.as_py())
                fp = fingerprint(tokens) if len(tokens) else bytes(FP)
                ids.append(doc_id), doc_sizes.append(len(tokens)), doc_fps.append(fp)
                held += 4
                if len(tokens) and fp not in known:  # a copy within the batch adds nothing
                    known.add(fp)
                    fps.append(fp), sets.append(tokens)
                    held += len(tokens)
                if held > BATCH_TOKENS:
                    yield from flush()
                    held = 0
        yield from flush()
        HASHES.clear()  # the worker lives on

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        for bucket in sorted({r["bucket"] for r in rows}):
            mine = [r for r in rows if r["bucket"] == bucket]
            join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in mine), kind)  # noqa: B023, E731
            none, n = join("null_ids", "u1").astype(bool), join("doc_sizes", "<u4").astype(np.int64)
            doc_fps = join("doc_fps", "u1").reshape(-1, FP)
            for at in range(0, len(n), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(join("ids", "<i8")[part], pa.int64(), mask=none[part]), pa.array(n[part]),
                     pa.array([f.tobytes() if k else None for f, k in zip(doc_fps[part], n[part], strict=True)], pa.binary()),
                     *(pa.nulls(len(n[part]), kind) for kind in (pa.int32(), pa.int32(), *[pa.binary()] * len(RETURNED)))],
                    names=COUNTED,
                )
            counts = join("counts", "u1").astype(np.int64)
            counts[counts == MANY] = join("many", "<u4")
            sized = np.concatenate([np.unpackbits(np.frombuffer(r["sized"], "u1"), count=len(r["counts"])) for r in mine]).astype(bool)
            sizes = np.zeros(len(counts), np.int64)
            sizes[sized] = join("sizes", "<u4")
            raw = np.frombuffer(b"".join(r["fps"] for r in mine), "<u4").reshape(-1, FP // 4)
            tokens = join("low", "<u4").astype(np.uint64) | join("high", "<u2").astype(np.uint64) << np.uint64(32)
            chosen = first_of_each(raw)  # copies from other batches add nothing
            owner = np.repeat(np.arange(len(counts)), counts)
            keep = chosen[owner]
            tokens, owner = tokens[keep], owner[keep]
            _, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
            df = df[inverse]
            keep = df > 1
            tokens, owner, df = tokens[keep], owner[keep], rounded(df[keep])
            held = np.bincount(owner, minlength=len(counts))
            told = chosen & (sized | (held > 0))
            target = np.where(told, raw[:, 0] % np.uint32(width), width)
            order = np.argsort(target, kind="stable")
            ends = np.searchsorted(target[order], np.arange(width + 1))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            of_token = np.argsort(place[owner], kind="stable")
            tokens, df, token_ends = tokens[of_token], df[of_token], np.append(0, np.cumsum(held[order]))
            for t in np.unique(target[told]).tolist():
                mine_of, these = order[ends[t] : ends[t + 1]], slice(token_ends[ends[t]], token_ends[ends[t + 1]])
                packed = (
                    raw[mine_of], sizes[mine_of].astype("<u4"), held[mine_of].astype("<u4"),
                    (tokens[these] & np.uint64(0xFFFFFFFF)).astype("<u4"), (tokens[these] >> np.uint64(32)).astype("<u2"), df[these],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([t], pa.int32()), pa.array([bucket], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in packed)],
                    names=COUNTED,
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    sent = texts.mapInArrow(send, "bucket int, " + ", ".join(f"{c} binary" for c in PACKED))
    return sent.repartition(width, "bucket").mapInArrow(
        count, "doc_id long, n long, fp binary, target int, bucket int, " + ", ".join(f"{c} binary" for c in RETURNED)
    )


def shared_tokens(parts: DataFrame, width: int) -> DataFrame:
    """``fp, n, tokens, df``: each class that may link, its tokens that other classes have too (packed), put together."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        for target in sorted({r["target"] for r in rows}):
            mine = [r for r in rows if r["target"] == target]
            join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in mine), kind)  # noqa: B023, E731
            fps, sizes, held = join("fps", "<u4").reshape(-1, FP // 4), join("sizes", "<u4").astype(np.int64), join("held", "<u4").astype(np.int64)
            bucket = np.repeat(np.array([r["bucket"] for r in mine], np.uint64), [len(r["df"]) // 2 for r in mine])
            tokens = (join("low", "<u4").astype(np.uint64) | join("high", "<u2").astype(np.uint64) << np.uint64(32)) * np.uint64(width) + bucket
            order = np.lexsort(fps.T)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            of_token = np.argsort(np.repeat(place, held), kind="stable")
            tokens, df = tokens[of_token].astype("<u8"), join("df", "<u2")[of_token]
            fps, sizes, held = fps[order], sizes[order], held[order]
            first = np.ones(len(fps), bool)
            first[1:] = (fps[1:] != fps[:-1]).any(axis=1)
            starts = np.flatnonzero(first)
            n, shared = np.maximum.reduceat(sizes, starts), np.add.reduceat(held, starts)
            ends = np.cumsum(shared)
            # A class with more tokens of its own than it can miss links with nothing.
            able = np.flatnonzero(100 * shared >= PERCENT * n)
            for at in range(0, len(able), 500):
                part = able[at : at + 500]
                slices = [slice(e - k, e) for e, k in zip(ends[part].tolist(), shared[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.tobytes() for f in fps[starts[part]]], pa.binary()), pa.array(n[part]), *(pa.array([x[i].tobytes() for i in slices], pa.binary()) for x in (tokens, df))],
                    names=["fp", "n", "tokens", "df"],
                )

    sent = parts.select("target", "bucket", *RETURNED).repartition(width, "target")
    return sent.mapInArrow(gather, "fp binary, n long, tokens binary, df binary")


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """For each of ``64 * SKETCH`` bits whether an odd number of tokens falls on it, as signed numbers.

    Two sets differ in at least as many tokens as their sketches do in bits.
    """
    with np.errstate(over="ignore"):
        at = (mixed(tokens + np.uint64(5)) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def with_signatures(sets: DataFrame) -> DataFrame:
    """``sig, fp, n, own``: ``own`` counts the tokens that no other class has."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500))
        for batch in parts:
            sigs, fps, ns, owns = [np.empty(0, np.uint64)], [], [], []
            for r in batch.to_pylist():
                tokens, df = (np.frombuffer(r[c], kind) for c, kind in (("tokens", "<u8"), ("df", "<u2")))
                s = signatures(r["n"], tokens.astype(np.uint64), df.astype(np.int64))
                sigs.append(s), fps.extend([r["fp"]] * len(s)), ns.extend([r["n"]] * len(s)), owns.extend([r["n"] - len(tokens)] * len(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(owns, pa.int64())],
                names=["sig", "fp", "n", "own"],
            )

    return sets.mapInArrow(sign, "sig long, fp binary, n long, own long")


def band_of(n: int) -> int:
    """Sizes between two powers of 1.25 are a band, so that sets that link are of the same or of neighbouring ones."""
    return next(b for b in range(int(np.log(n) / np.log(1.25)) - 1, 1 << 10) if 5 ** (b + 1) > n * 4 ** (b + 1)) if n > 1 else 0


def long_combinations(n: int, tokens: np.ndarray) -> list[np.ndarray]:
    """Signatures that two sets of ``n`` which link share for certain, each of all tokens of a part of a set.

    With the larger set in a band, the two differ in at most ``d`` tokens, a ninth of their sizes together. Dealt
    to more than d parts by hash, some part is the same in both. A set is signed for its own band and the next one
    (a list for each), which needs no pairs of sets that are both signed for the next one. It
    leaves out the parts with the fewest tokens, as many as it can: of the parts that are sure to be the same,
    half of those to spare, and one for each token that no other class has, as those are in no part.
    """
    out = []
    for band in (band_of(n), band_of(n) + 1):
        largest = (5 ** (band + 1) - 1) // 4 ** (band + 1)
        d = -(-2 * largest * (100 - PERCENT) // (100 + PERCENT))
        with np.errstate(over="ignore"):
            part = (mixed(tokens + np.uint64(11 + band)) % np.uint64(d + 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sums = np.append(np.uint64(0), np.cumsum(mixed(tokens[order] + np.uint64(13)), dtype=np.uint64))
            held = np.bincount(part, minlength=d + 1)
            ends = np.cumsum(held)
            combined = mixed(mixed(sums[ends] - sums[ends - held] + np.uint64(band)) + np.arange(d + 1, dtype=np.uint64))
        spare = (d * (100 + PERCENT) - 2 * n * (100 - PERCENT)) // (2 * (100 + PERCENT)) + n - len(tokens)
        out.append(np.unique(combined[np.argsort(held, kind="stable")[max(0, spare) :]]))
    return out


def with_long_combinations(classes: DataFrame) -> DataFrame:
    """``sig, fp, root, n, own, home, sketch`` of classes (``fp, n, root, tokens``); ``home``: signed for its own band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500))
        for batch in parts:
            sigs, home, times, own, sketches = [np.empty(0, np.uint64)], [np.empty(0, bool)], [], [], []
            for r in batch.select(["n", "tokens"]).to_pylist():
                tokens = np.frombuffer(r["tokens"], "<u8").astype(np.uint64)
                here, above = long_combinations(r["n"], tokens)
                sigs += here, above
                home += np.ones(len(here), bool), np.zeros(len(above), bool)
                times.append(len(here) + len(above)), own.append(r["n"] - len(tokens)), sketches.append(sketch_of(tokens))
            of = np.repeat(np.arange(len(times)), times)
            drawn = np.array(sketches, np.int64).reshape(-1, SKETCH)[of]
            classes_of = batch.select(["fp", "root", "n"]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs).view(np.int64)), *classes_of.columns, pa.array(np.array(own, np.int64)[of]), pa.array(np.concatenate(home)),
                 pa.StructArray.from_arrays([pa.array(c) for c in drawn.T.copy()], [f"s{i}" for i in range(SKETCH)])],
                names=["sig", "fp", "root", "n", "own", "home", "sketch"],
            )

    parity = ", ".join(f"s{i}: long" for i in range(SKETCH))
    return classes.select("fp", "root", "n", "tokens").mapInArrow(sign, f"sig long, fp binary, root binary, n long, own long, home boolean, sketch struct<{parity}>")


#: Two classes share no more tokens than either shares with any, so only such pairs can link.
FITS = f"100 * least(n_a - own_a, n_b - own_b) >= {PERCENT} * (n_a + n_b - least(n_a - own_a, n_b - own_b))"


#: What two classes differ in, at least: their own tokens and the bits in which the sketches of the others differ.
DIFFER = "own_a + own_b + " + " + ".join(f"bit_count(sketch_a.s{i} ^ sketch_b.s{i})" for i in range(SKETCH))


def sets_sizes(posts: DataFrame) -> DataFrame:
    """``fp, n, own`` of the classes that share a signature."""
    return posts.select("fp", "n", "own").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs of classes (``a``, ``b``), those that link. Only the sets of classes in pairs are moved."""
    pairs = stage(pairs, "pairs")
    named = stage(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "paired")
    sets = sets.join(named, "fp", "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.select(["n_a", "n_b", "t_a", "t_b"]).to_pylist():
                x, y = (np.frombuffer(r[c], "<u8") for c in ("t_a", "t_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (r["n_a"] + r["n_b"] - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s, k: s.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}"))
    return pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b").mapInArrow(verify, "a binary, b binary")


def _unsettled(posts: DataFrame) -> DataFrame:
    """``sig, fp, root`` under signatures that classes of several components have."""
    several = posts.groupBy("sig").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("sig")
    return posts.join(several, "sig")


def _with_major(posts: DataFrame) -> DataFrame:
    """``posts`` under signatures that classes of several components have, with ``major``, the component of most of them."""
    counts = posts.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("classes"))
    major = counts.groupBy("sig").agg(F.max(F.struct("classes", "root"))["root"].alias("major"), F.count(F.lit(1)).alias("roots"))
    return posts.join(major.where("roots > 1").select("sig", "major"), "sig")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of anything but space and control white space, A-Z in lower case. The set of a text are its distinct
    5-word shingles; with fewer words, the whole sequence; without words, or null, it is empty and links with nothing.
    Documents link when 100 times the intersection is at least 80 times the union; ``component_id`` is the smallest
    doc_id reachable over links (null ids do not count; a row with a null id has one all the same where others
    of its component do). Repeated rows come out as often. Extra columns are left behind, an empty table gives
    an empty result.
    """
    width = shuffle_width(docs.sparkSession)
    parts = stage(counted(docs, width), "counted")
    rows = parts.where("target is null").select("doc_id", F.col("n").alias("n_shingles"), "fp")
    sets = stage(shared_tokens(parts.where("target is not null"), width), "shared-tokens")
    sigs = stage(with_signatures(sets), "signed")
    # Of near copies, the one with the fewest tokens of its own is the likeliest to link with all others.
    central = F.min(F.struct("own", "fp"))["fp"].alias("a")
    several = sigs.groupBy("sig").agg(central, F.count(F.lit(1)).alias("classes")).where("classes > 1").select("sig", "a")
    posts = stage(sigs.join(several, "sig"), "signatures")
    sizes = sets_sizes(posts).withColumnsRenamed({"fp": "a", "n": "n_a", "own": "own_a"})
    stars = stage(posts.where("a <> fp").select("a", F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("own_b")).distinct(), "stars")
    links = stage(verified(stars.join(sizes, "a").where(FITS).select("a", "b"), sets), "links")
    root = components(links)
    # What is left: classes of different components that share a signature and were not compared. Most classes of a group
    # have too many tokens of their own to link with any size of set that has the signature.
    reach = Window.partitionBy("sig")
    partner = F.greatest(F.least(F.col("n") - F.col("own"), F.max("n").over(reach)), F.min("n").over(reach))
    both = F.least(F.col("n") - F.col("own"), partner)
    able = posts.select("sig", "fp", (100 * both >= PERCENT * (F.col("n") + partner - both)).alias("able")).where("able")
    placed = able.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", F.coalesce("root", "fp").alias("root"))
    # Classes of such a signature get longer combinations; only under those are components compared.
    unsettled = stage(_unsettled(placed).select("fp", "root").distinct(), "unsettled")
    left = stage(unsettled.join(sets, "fp").select("fp", "root", "n", "tokens"), "unsettled-tokens")
    longer = stage(_with_major(with_long_combinations(left)), "longer")
    side = lambda k: longer.select("sig", "major", *[F.col(c).alias(f"{c}_{k}") for c in ("fp", "root", "n", "own", "home", "sketch")])
    met = (
        side("a").where("root_a <> major").join(side("b").drop("major"), "sig")
        .where("(root_b = major or root_a < root_b) and (home_a or home_b)").where(FITS).where(f"{100 + PERCENT} * ({DIFFER}) <= {100 - PERCENT} * (n_a + n_b)")
        .select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct()
    )
    crossed = met.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    more = stage(verified(crossed, sets), "links")
    root = components(links.union(more))
    ids = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    placed = ids.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    by_root = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = placed.join(by_root, "root").select("fp", "component_id")
    return rows.join(of_class, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
