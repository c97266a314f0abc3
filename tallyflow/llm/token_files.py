"""Token-id output: flat files of unsigned integers with 64-bit document offsets, read by memory map.

Documents are range-partitioned by id. Each partition encodes its documents and writes three flat files in
little-endian order: ``ids`` (16 bits each where the vocabulary allows it, else 32), ``offsets`` (64 bits, one
more than documents) and ``docs`` (64 bits, document ids). Partition bases come from prefix sums over one
manifest row per partition, so that offsets can count from the start of the whole output although no partition
knows the others while it writes. A file gets its name only when it is complete, and a repeated task writes
the same bytes under the same name, so lost executors and repeated attempts do no harm.

A text is encoded by the tokenizers library. As a space before a non-space always begins a new pre-token of
the byte-level pattern, the pieces between such spaces are encoded on their own, each distinct one once while
it stays in a bounded table; a text with other runs of white space is encoded whole. A piece of Latin letters
is one pre-token, so the library's BPE model is asked for it without the rest of its chain.
"""

from __future__ import annotations

import os
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyflow.llm.common import stage, text_or_empty
from tallyflow.session import scratch_path, shuffle_width

#: Pieces a worker remembers; the table is emptied when full.
REMEMBERED = 1_000_000
#: Below it, what Python calls a letter is one for the pattern, whatever the versions of Unicode.
LATIN_END = "\u0250"
MANIFEST = "part int, n_docs long, n_nulls long, n_tokens long, stem string"


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies show a byte by its Latin-1 character where that prints, else by the next from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARACTERS = _byte_characters()
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Texts to packed ids, for one vocabulary file."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # Pieces are encoded without regard to added tokens; a text that holds the string of one goes whole to ``plain``.
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line_feed = self._packed(["\n"])[0]
        self.seen: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """One for each worker process."""
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = cls(vocabulary)
        return _ENCODERS[vocabulary]

    def _packed(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in done]

    def _word(self, word: str, space: str) -> bytes:
        """Latin letters with or without a space before: one pre-token, in the characters that stand for its bytes."""
        shown = space + word if word.isascii() else space + word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _line(self, text: str, space: str) -> bytes | None:
        """A word and the points or commas behind it; None if the text is anything else."""
        word = text.rstrip(".,")
        if not word.isalpha() or max(word) >= LATIN_END:
            return None
        if word == text:
            return self._word(word, space)
        end = text[len(word) :]
        if end not in self.ends:
            self.ends[end] = self._packed([end])[0]
        known = self.seen.get(word) if space else None
        return (known or self._word(word, space)) + self.ends[end]

    def _piece(self, piece: str, space: str) -> bytes | None:
        """A piece whose lines are words; a line feed before a letter is a pre-token of its own."""
        first, *more = [piece] if piece.isalpha() else piece.split("\n")
        out = [self._line(first, space)]
        for line in more:
            out += [self.line_feed, self._line(line, "")]
        return None if None in out else b"".join(out)

    def _learn(self, pieces: set[str]) -> bool:
        """Encode pieces that a space was cut from; False if one of them hangs together with the next space."""
        rest, space, seen = [], BYTE_CHARACTERS[32], self.seen
        tokenize, code = self.model.tokenize, self.code
        for piece in pieces:
            if piece.isascii() and piece.isalpha():  # most of them: the short way
                seen[piece] = array(code, [t.id for t in tokenize(space + piece)]).tobytes()
            elif not piece or piece[0].isspace():
                return False
            elif (packed := self._piece(piece, space)) is not None:
                seen[piece] = packed
            else:
                rest.append(piece)
        if rest:
            seen.update(zip(rest, self._packed([" " + p for p in rest]), strict=True))
        return True

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        # All pieces but the first one begin with the space that was cut out; the key leaves it out.
        first, *rest = text.split(" ")
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.ends.clear()
        seen = self.seen
        new = {p for p in rest if p not in seen}
        if new and not self._learn(new):
            return self._packed([text])[0]
        head = b""
        if first:
            head = self._piece(first, "") or self._packed([first])[0]
        return head + b"".join(map(seen.__getitem__, rest))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class _Part:
    """The three files of a partition; they appear under their names once closed."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.stem = f"{root}/{name}"
        self.attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
        self.files = {k: self.fs.open_output_stream(f"{self.attempt}.{k}") for k in ("ids", "offsets", "docs")}

    def close(self) -> None:
        for kind, file in self.files.items():
            file.close()
            self.fs.move(f"{self.attempt}.{kind}", f"{self.stem}.{kind}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encode ``doc_id, text`` into files below ``folder`` (shared by all executors); returns the manifest.

    Ascending doc_id, null ids first; equal ids by a hash of the text, then the text. Ids are those of the library as it comes:
    the string of an added token (``<|endoftext|>``) in a text is that token. A null text is an empty one, which still gets its
    ``end_id``. Repeated rows are written as often as they occur. The manifest is staged: one row for each
    partition with documents, with ``base_docs`` and ``base_tokens``, the sums over the partitions before.
    """
    width = partitions or shuffle_width(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        end = np.array([end_id], encoder.dtype).tobytes()
        number = TaskContext.get().partitionId()
        part, n_docs, n_nulls, n_tokens = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = _Part(folder, f"part-{number:07d}")
                part.files["offsets"].write(np.array([0], "<u8").tobytes())
            packed = [encoder.encode(t) + end for t in batch.column(1).to_pylist()]
            part.files["ids"].write(b"".join(packed))
            ends = np.cumsum([len(p) // encoder.dtype.itemsize for p in packed]) + n_tokens
            part.files["offsets"].write(ends.astype("<u8").tobytes())
            part.files["docs"].write(batch.column(0).fill_null(0).to_numpy().astype("<i8").tobytes())
            n_docs, n_nulls, n_tokens = n_docs + len(packed), n_nulls + batch.column(0).null_count, int(ends[-1])
        if part is not None:
            part.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": number, "n_docs": n_docs, "n_nulls": n_nulls, "n_tokens": n_tokens, "stem": part.stem}],
                pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_nulls", pa.int64()), ("n_tokens", pa.int64()), ("stem", pa.string())]),
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(width, *order).sortWithinPartitions(*order, "text")
    manifest = stage(placed.mapInArrow(write, MANIFEST), "token-manifest")
    # One row for each partition is all that meets here.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select(
        "*",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("base_docs"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base_tokens"),
    )


def _mapped(files: fs.FileSystem, path: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is mounted, else read."""
    if not files.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(manifest: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Back from the files: ``doc_id, start, n_tokens, ids`` (ids packed as little-endian 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(folder)
        dtype = Encoder.of(vocabulary).dtype
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(files, f"{row['stem']}.ids", dtype)
                offsets = _mapped(files, f"{row['stem']}.offsets", np.dtype("<u8")).astype(np.int64)
                docs = _mapped(files, f"{row['stem']}.docs", np.dtype("<i8"))
                n = row["n_docs"]
                for at in range(0, n, 500):
                    to = min(n, at + 500)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(docs[at:to]), mask=np.arange(at, to) < row["n_nulls"]),
                            pa.array(offsets[at:to] + row["base_tokens"]),
                            pa.array(np.diff(offsets[at : to + 1])),
                            pa.array([ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(at, to)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    spread = manifest.repartition(shuffle_width(manifest.sparkSession), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "tokens")
