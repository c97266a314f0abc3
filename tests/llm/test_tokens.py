import base64
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyflow.llm import byte_bpe, token_files
from tallyflow.llm.queries import op5_token_files, op7_byte_bpe

TEXTS = [
    None, "", " ", "  two  spaces ", "tab\tand\nline \n end", "it's we've 'tis 'R", "x" * 3000, "é ñ ß çç 12 1½ ²", "a" + " " * 900 + "b",
    "<|endoftext|> plain", "日本語 テキスト " * 60, "\x1c\x85  odd space", "don't " * 400, "." * 700 + "ab " * 300, "🙂🙂 ok " * 90,
    "word " * 500 + "y" * 400 + " tail" * 200, "don't " * 400,
]
SCHEMA = "doc_id long, text string, start string, ids string, row int"


def rows():
    return [(None if i == 3 else 7 if i in (5, 6) else i, t, "s", "i", 1) for i, t in enumerate(TEXTS)]


def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (200, 40), (32768, 512)])
def test_chunked_ids_are_those_of_the_whole_text(spark, chunk, overlap):
    enc = tiktoken_encoding()
    docs = spark.createDataFrame(rows(), SCHEMA)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, chunk, overlap).collect()
    want = []
    for doc_id, text, *_ in rows():
        ids = enc.encode_ordinary(text or "")
        want.append((doc_id, len(ids), " ".join(map(str, ids)), (text or "").encode()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in got), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN).count() == 0
    folder = token_files.token_folder(docs)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, folder, vocabulary, 2)
    assert token_files.read_token_files(manifest, folder, vocabulary).count() == 0


def test_files_hold_the_ids_in_order(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    folder = token_files.token_folder(docs)
    manifest = token_files.write_token_files(docs, folder, vocabulary, 2, partitions=4)
    got = sorted(token_files.read_token_files(manifest, folder, vocabulary).collect(), key=lambda r: r.start)
    t = whole_tokenizer()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows()), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        texts = [text or "" for doc_id, text, *_ in rows() if doc_id == r.doc_id]
        assert ids in [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    names = os.listdir(folder.removeprefix("file://"))
    assert all(n.startswith("part-") for n in names if not n.endswith(".crc"))


def test_pieces_between_spaces_are_independent():
    e = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    t = whole_tokenizer()
    end = "<|endoftext|>"
    special = [end, f"{end} a b", f"a b{end}c d", f"a b {end}", f"{end}{end}", "<|endoftext| >", "<|end oftext|>"]
    assert t.encode(end, add_special_tokens=False).ids == [50256]
    for text in [x or "" for x in TEXTS] + special + ["a\n b", "a\n\n b c", "x  y", "' s 's n 't"]:
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def test_every_character_between_letters():
    e, t = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")), whole_tokenizer()
    bpe = byte_bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for base in range(0, 0x3000, 64):
        text = " ".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(base, base + 64))
        whole = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == whole
        pieces = [i for m in bpe.pattern.finditer(text) for i in bpe.encoding.encode_ordinary(m.group())]
        assert pieces == bpe.encoding.encode_ordinary(text), hex(base)


def test_queries_on_the_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t, enc, at = whole_tokenizer(), tiktoken_encoding(), 0
    five = {r.doc_id: r for r in op5_token_files(spark, sf).collect()}
    seven = {r.doc_id: r for r in op7_byte_bpe(spark, sf).collect()}
    assert set(five) == set(seven) == set(texts)
    for doc_id in sorted(texts):
        ids = t.encode(texts[doc_id], add_special_tokens=False).ids + [2]
        r = five[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        plain, r = enc.encode_ordinary(texts[doc_id]), seven[doc_id]
        assert r.n_tokens == len(plain)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, plain)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[doc_id].encode()).hexdigest()
