"""Phrase collocations by vertical partitioning of depth-truncated suffix trees over words.

Every word of a piece of text begins a suffix of at most ``DEPTH`` words. A first pass over the texts counts words and
pairs of neighbours in 2 ** 32 buckets, a second one longer runs of pairs whose buckets hold ``least`` occurrences; a
suffix ends before its first beginning whose bucket holds fewer, as no phrase around it can be frequent. What is left is
told by prefixes: prefixes of one word fall in classes, classes that hold more suffixes than the memory budget are
extended by the next word, again and again, and classes are packed into groups of about one budget. A task passes on
the suffixes of a class as one block. The blocks of a group meet in one task, which sorts the suffixes and builds their
subtree from the outside in: equal suffixes are a leaf with a total, and the count of an inner node, a phrase, is the sum
of its leaves. Nodes above an extended prefix have leaves in several groups; their partial sums are added up afterwards.

Words are known by 64-bit hashes of their bytes and their language, so phrases of different languages never meet.
Bytes are read straight from the batch: all separators are ASCII, so that UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallyflow.llm.common import stage, text_or_empty
from tallyflow.llm.text import mixed
from tallyflow.session import shuffle_width

DEPTH, LEAST, TOP = 5, 100, 2000
#: Words of the runs that the first pass counts.
PAIRS = 2
UNKNOWN = "und"

#: Suffixes (distinct ones of a task of the pass before) that a group holds, about; classes of prefixes of one length.
BUDGET, CLASSES = 1_000_000, 1 << 10
#: Ranges of buckets, each counted by itself; bits of the table of frequent buckets, whose size is fixed.
RANGES, BITS = 256, 1 << 26
#: Bytes of text, and words or suffixes, that a task looks at together or holds before it passes them on.
CHUNK, HELD = 1 << 19, 1 << 19

#: For each byte 0 in a word, 1 for blanks between words, 2 between pieces; A-Z as a-z.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Random numbers of bytes, and the powers that tell their places in a word.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(CHUNK + 1, _FACTOR, np.uint64)) * np.uint64(pow(_FACTOR, -1, 1 << 64))
_INVERSE = np.cumprod(np.full(CHUNK + 1, pow(_FACTOR, -1, 1 << 64), np.uint64)) * np.uint64(_FACTOR)
#: Suffixes of a class and a language: so many rows of words (0 after the last one), packed, and how often each occurs.
BLOCK = pa.schema([("class", pa.int32()), ("lang", pa.string()), ("size", pa.int64()), ("rows", pa.binary()), ("n", pa.binary())])
BLOCK_SQL = "class int, lang string, size long, rows binary, n binary"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last one ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _cuts(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of at most ``CHUNK`` bytes that end after a separator; a longer word is a part by itself."""
    while end - begin > CHUNK:
        seps = np.flatnonzero(_KIND[data[begin : begin + CHUNK]])
        if len(seps):
            cut = begin + int(seps[-1]) + 1
        else:
            cut = begin + CHUNK
            while cut < end and not _KIND[data[cut]]:
                later = np.flatnonzero(_KIND[data[cut : min(cut + CHUNK, end)]])
                cut = cut + int(later[0]) if len(later) else min(cut + CHUNK, end)
        yield begin, cut
        begin = cut
    if begin < end:
        yield begin, end


def _word_hash(data: np.ndarray) -> np.uint64:
    """The hash of one word of any length."""
    total = np.uint64(0)
    for at in reversed(range(0, len(data), CHUNK)):
        part = _BYTE[_LOWER[data[at : at + CHUNK]]]
        total = (part * _POWERS[: len(part)]).sum(dtype=np.uint64) + total * _POWERS[CHUNK]
    return total


class Words:
    """The words of some texts: hash, number of the piece, where the word begins and ends in ``data``, number of the text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> None:
        self.data = data
        held, pieces = [], 0
        for begin, end in _cuts(data, int(at[0]), int(at[-1])):
            kind = _KIND[data[begin:end]]
            letter = kind == 0
            # Where texts begin inside the part; a text ends a word and a piece.
            edges = at[np.searchsorted(at, begin, "right") : np.searchsorted(at, end, "left")] - begin
            starts, stops = letter.copy(), letter.copy()
            starts[1:] &= ~letter[:-1]
            stops[:-1] &= ~letter[1:]
            starts[edges] |= letter[edges]
            stops[edges - 1] |= letter[edges - 1]
            s, e = np.flatnonzero(starts), np.flatnonzero(stops) + 1
            piece = pieces + np.cumsum(kind == 2)
            pieces = int(piece[-1])
            if len(kind) > CHUNK:  # a single long word, or several where texts end in it
                h = np.array([_word_hash(data[begin + i : begin + j]) for i, j in zip(s, e, strict=True)], np.uint64)
            else:
                sums = np.zeros(len(kind) + 1, np.uint64)
                np.cumsum(_BYTE[_LOWER[data[begin:end]]] * _POWERS[: len(kind)], out=sums[1:])
                h = (sums[e] - sums[s]) * _INVERSE[s]
            doc = np.searchsorted(at, begin + s, "right") - 1
            # Neither number ever falls, so that their sum is the same only where both are.
            held.append((mixed(h ^ seeds[doc]) | np.uint64(1), piece[s] + doc, begin + s, begin + e, doc))
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4]
        self.hash, self.piece, self.begin, self.end, self.doc = columns

    def grams(self, tables: list[np.ndarray], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... ``longest`` words: where a run of so many begins, and its hash.

        With the first of ``tables`` runs with a pair that is not frequent are left out, with the second one longer runs
        that begin with a run that is not, and words of no frequent pair.
        """
        at, g, on = np.arange(len(self.hash)), self.hash, None
        for k in range(1, longest + 1):
            if k > 1:
                go = at + k - 1 < len(self.hash)
                go[go] = self.piece[at[go] + k - 1] == self.piece[at[go]]
                if on is not None:
                    go[go] = on[at[go] + k - 2]  # the pair that ends the run
                at, g = at[go], g[go]
                g = mixed(g + mixed(self.hash[at + k - 1])) | np.uint64(1)
            table = tables[0] if tables and k == PAIRS or len(tables) == 1 and k < PAIRS else tables[1] if len(tables) > 1 else None
            if table is not None:
                often = _frequent(g, table)
                at, g = at[often], g[often]
                if k == PAIRS:
                    on = np.zeros(len(self.hash), bool)
                    on[at] = True
            yield at, g


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of runs of whole texts (``lang``, ``text``), and the language of each text."""
    with np.errstate(over="ignore"):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            told = {lang: np.uint64(xxhash.xxh3_64_intdigest(lang)) for lang in set(langs)}
            seeds = np.array([told[lang] for lang in langs], np.uint64)
            data, at = _bytes_of(batch.column("text"))
            first = 0
            while first < len(langs):
                last = max(int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1, first + 1)
                yield Words(data, at[first : last + 1], seeds[first:last]), langs[first:last]
                first = last


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def counted_buckets(texts: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Per task: rows of ``lang, n`` (words) and rows of ``part, buckets``, counts of the buckets of runs of words.

    Without ``tables`` runs of one and two words are counted, with the first table the longer ones that it leaves over and the
    words of frequent pairs. A bucket takes 32 bits: 24 tell it within its range of buckets, 8 its count, of which 255 stands for more.
    """
    broadcast = texts.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("buckets", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = broadcast.value
        words: dict[str, int] = {}
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            buckets, n = np.unique(np.concatenate(held), return_counts=True)
            packed = (buckets & np.uint32(0xFFFFFF)) << np.uint32(8) | np.minimum(n, 255).astype(np.uint32)
            ends = np.searchsorted(buckets >> np.uint32(24), np.arange(RANGES + 1))
            for part in range(RANGES):
                if ends[part] < ends[part + 1]:
                    yield pa.RecordBatch.from_pylist([{"part": part, "buckets": packed[ends[part] : ends[part + 1]].tobytes()}], schema=schema)
            held.clear()

        for w, langs in _words(batches):
            for doc, n in enumerate(np.bincount(w.doc, minlength=len(langs)).tolist()):
                words[langs[doc]] = words.get(langs[doc], 0) + n
            grams = list(w.grams(tables, DEPTH if tables else PAIRS))
            if tables:
                # Words of frequent pairs: each as often as it is in one.
                at = grams[PAIRS - 1][0]
                grams[:PAIRS] = [(at, w.hash[at]), (at, w.hash[at + 1])]
            held += [bucket_of(g) for _, g in grams]
            size += sum(len(g) for _, g in grams)
            if size > 8 * HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()
        yield pa.RecordBatch.from_pylist([{"lang": lang, "n": n} for lang, n in words.items()], schema=schema)

    return texts.mapInArrow(count, "lang string, n long, part int, buckets binary")


def frequent_buckets(counted: DataFrame, least: int) -> np.ndarray:
    """A table of ``BITS`` bits (as bytes): whether a bucket, without its last six bits, may hold ``least`` occurrences."""
    fold = (1 << 32) // BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range, so that one range is counted at a time."""
        total, current = np.zeros(1 << 24, np.uint8), None

        def bits() -> pa.RecordBatch:
            found = np.packbits((total >= least).reshape(-1, fold).any(axis=1)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([found], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, packed in zip(batch.column("part"), batch.column("buckets"), strict=True):
                if part.as_py() != current:
                    if current is not None:
                        yield bits()
                    total[:], current = 0, part.as_py()
                told = np.frombuffer(packed.as_buffer(), np.uint32)
                at, n = told >> np.uint32(8), (told & np.uint32(255)).astype(np.uint16)
                total[at] = np.minimum(total[at] + n, 255).astype(np.uint8)
        if current is not None:
            yield bits()

    told = counted.where("part is not null").select("part", "buckets")
    dealt = told.repartition(min(RANGES, shuffle_width(counted.sparkSession)), "part").sortWithinPartitions("part")
    out = np.zeros(BITS // 8, np.uint8)
    for r in dealt.mapInArrow(add, "part int, bits binary").collect():  # BITS / 8 bytes
        out[r.part * (BITS // 8 // RANGES) : (r.part + 1) * (BITS // 8 // RANGES)] = np.frombuffer(r.bits, np.uint8)
    return out


def _frequent(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = bucket_of(h) // np.uint32((1 << 32) // BITS)
    return (table[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & np.uint8(1) > 0


def _distinct(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows that stand for all equal ones, and the sums of ``n`` over these.

    Rows are sorted by a hash but compared by themselves, so that a hash can only leave equal rows apart.
    """
    key = rows[:, 0].copy()
    for column in rows.T[1:]:
        key = mixed(key) + column
    order = np.argsort(key)
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _classes(rows: np.ndarray, depth: int) -> np.ndarray:
    """The class of each suffix by its first ``depth`` words."""
    key = np.zeros(len(rows), np.uint64)
    for column in rows.T[:depth]:
        key = mixed(key + column)
    return (key % np.uint64(CLASSES)).astype(np.int32)


def _blocks(rows: np.ndarray, n: np.ndarray, lang: np.ndarray, names: list[str], depth: int) -> pa.RecordBatch:
    """Suffixes as blocks, ``lang`` telling the place of each one's language in ``names``."""
    with np.errstate(over="ignore"):
        of = _classes(rows, depth)
    order = np.lexsort([*rows.T[::-1], lang, of])
    rows, n, lang, of = rows[order], n[order], lang[order], of[order]
    new = np.ones(len(rows), bool)
    new[1:] = (of[1:] != of[:-1]) | (lang[1:] != lang[:-1])
    at = np.flatnonzero(new)
    ends = [*at[1:].tolist(), len(rows)]
    spans = [slice(i, j) for i, j in zip(at.tolist(), ends, strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array(of[at]), pa.array([names[c] for c in lang[at].tolist()], pa.string()), pa.array([x.stop - x.start for x in spans], pa.int64()),
         pa.array([rows[x].tobytes() for x in spans], pa.binary()), pa.array([n[x].tobytes() for x in spans], pa.binary())],
        schema=BLOCK,
    )


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(batch.column("rows")[i].as_buffer(), np.uint64).reshape(-1, DEPTH)
    return rows, np.frombuffer(batch.column("n")[i].as_buffer(), np.int64)


def suffixes(texts: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Blocks of suffixes by their first word, and rows of ``keys, words``, the words of phrases.

    A task adds up equal suffixes as it goes and passes them on when it holds ``HELD`` different ones.
    """
    broadcast = texts.sparkSession.sparkContext.broadcast(tables)
    schema = pa.schema([*BLOCK, ("keys", pa.list_(pa.binary())), ("words", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = broadcast.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        codes: dict[str, int] = {}
        spelled: dict[int, str] = {}
        size = 0

        def add_up() -> int:
            rows, n, lang = (np.concatenate(c) for c in zip(*held, strict=True))
            at, n = _distinct(rows, n)
            held[:] = [(rows[at], n, lang[at])]
            return len(at)

        def flush() -> Iterator[pa.RecordBatch]:
            for rows, n, lang in held:
                blocks = _blocks(rows, n, lang, list(codes), 1)
                nothing = [pa.nulls(blocks.num_rows, schema.field(k).type) for k in ("keys", "words")]
                yield pa.RecordBatch.from_arrays([*blocks.columns, *nothing], schema=schema)
            held.clear()
            if spelled:
                words = {"keys": [np.uint64(h).byteswap().tobytes() for h in spelled], "words": list(spelled.values())}
                yield pa.RecordBatch.from_pylist([words], schema=schema)
                spelled.clear()

        for w, langs in _words(batches):
            where, in_phrase = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), bool)
            for k, (at, _) in enumerate(w.grams(tables, DEPTH)):
                if k == 0:
                    first = at
                    rows = np.zeros((len(first), DEPTH), np.uint64)
                    where[first] = np.arange(len(first))
                rows[where[at], k] = w.hash[at + k]
                if k == 1:
                    in_phrase[at] = in_phrase[at + 1] = True
            told = np.array([codes.setdefault(lang, len(codes)) for lang in langs], np.int64)
            held.append((rows, np.ones(len(rows), np.int64), told[w.doc[first]]))
            hashes, one = np.unique(w.hash[in_phrase], return_index=True)
            for h, i in zip(hashes.tolist(), np.flatnonzero(in_phrase)[one].tolist(), strict=True):
                if h not in spelled:
                    spelled[h] = _LOWER[w.data[w.begin[i] : w.end[i]]].tobytes().decode()
            size += len(first)
            if size > HELD and (add_up() > HELD // 2 or len(spelled) > HELD // 8):
                yield from flush()
            if size > HELD:
                size = sum(len(n) for _, n, _ in held)
        if held:
            add_up()
            yield from flush()

    return texts.mapInArrow(cut, BLOCK_SQL + ", keys array<binary>, words array<string>")


def packed(counts: dict[int, int], budget: int, first: int) -> dict[int, int]:
    """Groups of classes, numbered from ``first``: the largest classes first, a group of about ``budget``."""
    out, group, room = {}, first - 1, 0
    for name, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        if n > room:
            group, room = group + 1, budget
        out[name], room = group, room - n
    return out


def partitioned(blocks: DataFrame, budget: int) -> tuple[DataFrame, int]:
    """``blocks`` with their ``group`` and the length (``depth``) of the prefix that put them there; the number of groups.

    Classes of prefixes of one word that hold more than ``budget`` suffixes are cut into classes by a word more, and so on to
    whole suffixes. The table of each length has ``CLASSES`` rows at most.
    """
    spark = blocks.sparkSession
    done, groups = [], 0
    for depth in range(1, DEPTH + 1):
        counts = {r["class"]: r["n"] for r in blocks.groupBy("class").agg(F.sum("size").alias("n")).collect()}
        kept = {c: n for c, n in counts.items() if n <= budget or depth == DEPTH}
        placed = packed(kept, budget, groups)
        groups = max([groups, *(g + 1 for g in placed.values())])
        told = spark.createDataFrame([(c, placed.get(c)) for c in counts], "class int, group int")
        at = blocks.join(F.broadcast(told), "class").withColumn("depth", F.lit(depth))
        done.append(at.where("group is not null"))
        if len(kept) == len(counts):
            break

        def cut(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, lang in enumerate(batch.column("lang").to_pylist()):
                    rows, n = _unpacked(batch, i)
                    yield _blocks(rows, n, np.zeros(len(rows), np.int64), [lang], depth + 1)

        blocks = stage(at.where("group is null").select(*BLOCK.names).mapInArrow(cut, BLOCK_SQL), "blocks")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, groups


def _keys(rows: np.ndarray) -> list[bytes]:
    data = np.ascontiguousarray(rows).view(np.uint64).byteswap().tobytes()
    step = 8 * rows.shape[1]
    return [data[at : at + step] for at in range(0, len(data), step)]


NODES = pa.schema([("key", pa.binary()), ("k", pa.int32()), ("f", pa.int64()), ("lang", pa.string()), ("whole", pa.bool_())])


def subtree(rows: np.ndarray, n: np.ndarray, lang: np.ndarray, names: list[str], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the nodes over sorted suffixes, length by length.

    A node at or below the group's prefix of ``depth`` words is whole and goes if it is rare; one above is a part of it.
    """
    for k in range(1, DEPTH + 1):
        reach = np.flatnonzero(rows[:, k - 1])
        if not len(reach):
            break
        nodes = rows[reach, :k]
        new = np.ones(len(reach), bool)
        new[1:] = (nodes[1:] != nodes[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        f = np.add.reduceat(n[reach], at)
        keep = (f >= least) | (k < depth)
        if keep.any():
            told = pa.array([names[c] for c in lang[reach][at][keep].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys(nodes[at][keep]), pa.binary()), pa.array([k] * len(told), pa.int32()), pa.array(f[keep]), told, pa.array([k >= depth] * len(told))],
                schema=NODES,
            )


def subtrees(groups: DataFrame, least: int) -> DataFrame:
    """The nodes of every group; the blocks of a group come one after the other."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        codes: dict[str, int] = {}
        at, size = (None, 0), 0

        def add_up() -> tuple[np.ndarray, ...]:
            rows, n, lang = (np.concatenate(c) for c in zip(*held, strict=True))
            with np.errstate(over="ignore"):
                one, n = _distinct(rows, n)
            held[:] = [(rows[one], n, lang[one])]
            return held[0]

        def grown() -> Iterator[pa.RecordBatch]:
            if held:
                rows, n, lang = add_up()
                order = np.lexsort(rows.T[::-1])
                yield from subtree(rows[order], n[order], lang[order], list(codes), at[1], least)
                held.clear()

        for batch in batches:
            places = zip(batch.column("group").to_pylist(), batch.column("depth").to_pylist(), batch.column("lang").to_pylist(), strict=True)
            for i, (group, depth, lang) in enumerate(places):
                if group != at[0]:
                    yield from grown()
                    at, size = (group, depth), 0
                rows, n = _unpacked(batch, i)
                held.append((rows, n, np.full(len(rows), codes.setdefault(lang, len(codes)))))
                size += len(rows)
                if size > 2 * BUDGET:  # copies of suffixes from many tasks
                    size = len(add_up()[1])
        yield from grown()

    return groups.mapInArrow(build, "key binary, k int, f long, lang string, whole boolean")


def phrase_counts(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``lang, text``: phrases ``key, k, f, lang`` of up to ``DEPTH`` words with ``f >= least``; words ``key, word``; ``lang, n``.

    Single words are there if they may be in a phrase. ``key`` holds eight bytes a word.
    """
    spark = texts.sparkSession
    counted = stage(counted_buckets(texts, []), "buckets")
    words = counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    short = frequent_buckets(counted, least)
    longer = frequent_buckets(counted_buckets(texts, [short]), least)
    cut = stage(suffixes(texts, [short, longer]), "suffixes")
    blocks = cut.where("words is null").select(*BLOCK.names)
    spelled = cut.where("words is not null").select(F.explode(F.arrays_zip("keys", "words")).alias("w"))
    spelled = spelled.groupBy(F.col("w.keys").alias("key")).agg(F.min("w.words").alias("word"))
    width = shuffle_width(spark)
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    rows, groups = partitioned(blocks, max(1, min(BUDGET, -(-total // width))))
    dealt = rows.repartition(max(width, groups), "group").sortWithinPartitions("group")
    nodes = stage(subtrees(dealt, least), "nodes")
    above = nodes.where("not whole").groupBy("key", "k", "lang").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return stage(nodes.where("whole").select("key", "k", "f", "lang").unionByName(above), "phrases"), spelled, words


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language of ``docs`` (``lang``, ``text``).

    Texts are taken with A-Z lower-cased, in pieces between any of ``.,;:!?`` and line ends, in words between spaces and
    tabs. A phrase of two to five words with ``a >= least`` occurrences scores ``1000 a n / (l r)``, floored, at its weakest
    cut into a first part (``l`` occurrences) and the rest (``r``), of equally weak ones the first; ``n`` counts the words of the language. A
    phrase that only occurs within a longer one goes. A null language counts as ``und``, null and empty texts have no
    words. Repeated rows count as often as they occur, ties go to the more frequent, then the smaller phrase in order of
    bytes; extra columns are left behind; an empty table gives an empty result. Texts and words may be of any length.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), text_or_empty("text").alias("text"))
    phrases, spelled, words = phrase_counts(texts, least)
    long = phrases.where("k >= 2").select("key", "k", "lang", F.col("f").alias("a"))
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = F.array(
        F.struct(F.lit(True).alias("is_first"), F.expr("substring(key, 1, 8 * cut)").alias("part")),
        F.struct(F.lit(False).alias("is_first"), F.expr("substring(key, 8 * cut + 1)").alias("part")),
    )
    parts = cuts.select("*", F.inline(sides)).join(phrases.select(F.col("key").alias("part"), F.col("f").alias("part_f")), "part")
    parts = stage(parts, "parts")
    # Whoever is as frequent as a phrase around it is as frequent as one that has just one word more.
    next_to = F.when(F.col("is_first"), F.col("cut") == F.col("k") - 1).otherwise(F.col("cut") == 1)
    within = parts.where(next_to & (F.col("part_f") <= F.col("a"))).select(F.col("part").alias("key")).distinct()
    told = parts.groupBy("key", "k", "lang", "a", "cut").agg(
        F.max(F.when(F.col("is_first"), F.col("part_f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("part_f"))).alias("r")
    )
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    whole = told.join(words, "lang").withColumns({c: exact(c) for c in ("a", "l", "r", "n")})
    scored = whole.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * a * n) div (l * r)"))
    weakest = scored.groupBy("key", "k", "lang", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    left = weakest.join(within, "key", "left_anti").select("key", "k", "lang", "a", "n", "at.l", "at.r", "at.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ranks leave out no tie; tasks leave out what cannot be among the first before rows of a language meet.
    few = stage(left.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top), "best")
    letters = few.select("lang", "key", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    spelt = letters.withColumn("word_key", F.expr("substring(key, 8 * i + 1, 8)")).join(spelled.withColumnRenamed("key", "word_key"), "word_key")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda w: w["word"]), " ")
    named = few.join(spelt.groupBy("key").agg(phrase.alias("phrase")), "key")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", *[F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")])
