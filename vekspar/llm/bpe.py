"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Bytes are mapped to characters for the library and back; offsets count the text's code
points. A token may hold only a part of a character: its offsets then cover the whole
character, and decoding joins the bytes before it reads them as text.

Defined results: null encodes as empty text, null ids decode as empty; repeated rows stay;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, pick, slices
from .tokens import CHAR_TO_BYTE, ByteEncoder, encoder, read_ranks

#: The library's form of the vocabulary, and the ranks that it must agree with.
VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str, pattern: str) -> ByteEncoder:
    return encoder(ByteEncoder, path, pattern)


def byte_table(found: ByteEncoder, ranks: str | None = None) -> list[bytes]:
    """The bytes of each id, by reversing the byte table; special tokens are their own text. They must be those of the rank file."""
    if not hasattr(found, "bytes_of"):
        vocabulary = found.tokenizer.get_vocab()
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(CHAR_TO_BYTE[c] for c in token) if all(c in CHAR_TO_BYTE for c in token) else token.encode()
        if ranks:
            known = read_ranks(ranks)
            if table[: len(known)] != known:
                raise ValueError("the vocabulary and the ranks differ")
        found.bytes_of, found.decimal = table, [str(i) for i in range(len(table))]
    return found.bytes_of


def offsets(ids: np.ndarray, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end code point of each id's characters, a split character counting for all its parts."""
    sizes = np.fromiter((len(table[i]) for i in ids.tolist()), np.int64, len(ids))
    raw = np.frombuffer(b"".join(table[i] for i in ids.tolist()), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return character[ends - sizes], character[ends - 1] + 1


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Columns doc_id, ids, starts, ends (code points, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _encoder(vocabulary, pattern)
        table = byte_table(found)
        for batch in (part for whole in batches for part in slices(whole, size=2_000_000)):
            ids = found(batch.column("text"))
            spans = [offsets(x, table) for x in ids]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.list_(pa.int32())) for x in (ids, [a for a, _ in spans], [b for _, b in spans]))], ["doc_id", "ids", "starts", "ends"])

    d = pick(docs, doc_id=id_col, text=text_col)
    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Columns doc_id, raw (the bytes), text (bytes that are no UTF-8 as U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(_encoder(vocabulary, pattern))
        for batch in batches:
            raw = [b"".join([table[i] for i in x or []]) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array([x.decode(errors="replace") for x in raw])], ["doc_id", "raw", "text"])

    c = pick(coded, doc_id=id_col, ids=ids_col)
    return mapped(c, run, f"doc_id {c.schema['doc_id'].dataType.simpleString()}, raw binary, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, ranks: str | None = RANKS) -> DataFrame:
    """Columns doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _encoder(vocabulary, pattern)
        raw, decimal = byte_table(found, ranks).__getitem__, found.decimal.__getitem__
        for batch in (part for whole in batches for part in slices(whole, size=2_000_000)):
            n, of_ids, of_bytes = [], [], []
            for x in found(batch.column("text")):
                ids = x.tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(map(raw, ids))).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = pick(docs, doc_id=id_col, text=text_col)
    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
