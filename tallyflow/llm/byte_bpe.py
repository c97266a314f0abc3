"""Byte-level BPE by overlapping chunks, and back.

A text of more than ``CHUNK`` characters is cut into chunks that overlap; tasks pre-tokenise the chunks in
parallel, whichever document they are from. In the overlap of two chunks the pre-tokens of the left one are
right (it has followed them from a right start), those of the right one may begin out of step. The first
boundary that both have is where they resynchronise, since what follows a boundary depends on nothing before
it; the pieces between such boundaries are encoded in parallel. Where an overlap holds no common boundary,
say in a run of letters longer than it, the rest of the document is one piece, so that the ids are always
those of the whole text. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyflow.llm.common import stage, text_or_empty
from tallyflow.session import shuffle_width

#: Characters of a chunk, and by how many it reaches into the next one.
CHUNK, OVERLAP = 32_768, 512
#: What a match's end may depend on behind it: a character, or the rest of a contraction.
SEEN = 4
END = 1 << 62

_BPE: dict[tuple[str, str], Bpe] = {}


class Bpe:
    """Ranks and pattern of a vocabulary, one for each worker process."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Bpe:
        key = ranks_path, pattern
        if key not in _BPE:
            _BPE[key] = cls(ranks_path, pattern)
        return _BPE[key]


def edges_of(bpe: Bpe, text: str, start: int, last: bool, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk's pre-tokens in its first and in its last overlap, from the start of the document.

    The last match, and any that ends ``SEEN`` characters from the end, may change with the text that follows.
    """
    ends = [m.end() for m in bpe.pattern.finditer(text)]
    if not last:
        ends = [e for e in ends[:-1] if e <= len(text) - SEEN]
    left = [start + e for e in ends if e <= overlap] if start else []
    right = [] if last else [start + e for e in ends if e >= len(text) - overlap]
    return left, right


def spans_of(edges: list[tuple[list[int], list[int]]], chunk: int) -> list[tuple[int, int, int]]:
    """For the chunks of a document in order: piece, and from where to where the chunk belongs to it."""
    cuts = [0]
    for (_, right), (left, _) in zip(edges, edges[1:], strict=False):
        both = set(left).intersection(right) if cuts[-1] >= 0 else ()
        cuts.append(min(both, default=-1))
    pieces, spans = 0, []
    for i, cut in enumerate(cuts):
        pieces = i if cut >= 0 else pieces
        after = cuts[i + 1] if i + 1 < len(cuts) else END
        spans.append((pieces, cut if cut >= 0 else i * chunk, after if after >= 0 else (i + 1) * chunk))
    return spans


def chunks_of(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``row, number, start, last, text`` of texts with more than ``chunk`` characters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = -(-len(text) // chunk)
                for i in range(n):
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "number": i, "start": i * chunk, "last": i == n - 1, "text": text[i * chunk : (i + 1) * chunk + (overlap if i < n - 1 else 0)]}],
                        pa.schema([("row", pa.int64()), ("number", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]),
                    )

    return rows.select("row", "text").mapInArrow(cut, "row long, number int, start long, last boolean, text string")


def encode_texts(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` (``doc_id``, ``text``; null text: empty) to ``doc_id, n_tokens, ids_text, decoded``.

    ``ids_text`` has the ids in decimals with a space between, ``decoded`` the bytes that they stand for.
    Every row comes out once, repeated ids and null ids too; extra columns are left behind.
    """
    # The scan numbers rows the same way however often it runs; only long texts are looked up by it, and
    # those are staged under their number first.
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    short = rows.where(F.length("text") <= chunk)
    width = shuffle_width(docs.sparkSession)
    long_rows = stage(rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    pieces_schema = "row long, number int, n_tokens long, ids_text string, decoded binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                counts, texts, decoded = [], [], []
                for text in batch.column("text").to_pylist():
                    ids = bpe.encoding.encode_ordinary(text)
                    counts.append(len(ids))
                    texts.append(" ".join([bpe.names[i] for i in ids]))
                    decoded.append(bpe.encoding.decode_bytes(ids))
                kept = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in kept), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(decoded, pa.binary())],
                    names=[*kept, "n_tokens", "ids_text", "decoded"],
                )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(ranks, pattern)
        for batch in batches:
            x = batch.to_pydict()
            found = [edges_of(bpe, t, s, e, overlap) for t, s, e in zip(x["text"], x["start"], x["last"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("number"), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([b for _, b in found], pa.list_(pa.int64()))],
                names=["row", "number", "left", "right"],
            )

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, edges in zip(batch.column("row").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                edges.sort(key=lambda e: e["number"])
                spans = spans_of([(e["left"], e["right"]) for e in edges], chunk)
                out = [{"row": row, "number": i, "piece": p, "lo": lo, "hi": hi} for i, (p, lo, hi) in enumerate(spans)]
                yield pa.RecordBatch.from_pylist(
                    out, pa.schema([("row", pa.int64()), ("number", pa.int32()), ("piece", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
                )

    chunks = stage(chunks_of(long_rows, chunk, overlap).repartition(width), "chunks")
    edges = chunks.mapInArrow(pretokenise, "row long, number int, left array<long>, right array<long>")
    cuts = (
        edges.groupBy("row").agg(F.collect_list(F.struct("number", "left", "right")).alias("edges"))
        .mapInArrow(stitch, "row long, number int, piece int, lo long, hi long")
    )
    text = F.col("text").substr((F.col("lo") - F.col("start") + 1).cast("int"), F.least(F.col("hi") - F.col("lo"), F.lit(chunk + overlap)).cast("int"))
    parts = chunks.join(cuts, ["row", "number"]).select("row", "piece", "number", text.alias("text"))
    # Chunks without a common boundary are one piece.
    pieces = parts.groupBy("row", "piece").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "text"))), lambda p: p["text"]), "").alias("text")
    )
    encoded = pieces.select("row", F.col("piece").alias("number"), "text").mapInArrow(encode, pieces_schema)
    whole = encoded.groupBy("row").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("number", "ids_text", "decoded"))).alias("p")
    ).select(
        "row", "n_tokens",
        F.array_join(F.filter(F.transform("p", lambda p: p["ids_text"]), lambda t: t != ""), " ").alias("ids_text"),
        F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["decoded"])), "")).alias("decoded"),
    )
    kind = dict(docs.dtypes)["doc_id"]
    out = short.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_text string, decoded binary")
    return out.union(long_rows.select("doc_id", "row").join(whole, "row").select("doc_id", "n_tokens", "ids_text", "decoded"))
