"""Fast use of the tokenizers library over Arrow columns of text.

A text is cut at places that no pre-token crosses. Arrow splits the texts and numbers the
distinct chunks of a batch, the pattern cuts those into pre-tokens, and the library's BPE
model encodes each pre-token that the worker hasn't met yet. The ids of the texts are then
gathered with numpy. The result is that of the library's encode() with
add_special_tokens=False.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import run_lengths

#: Stands between chunks that are cut in one go; texts that hold it are encoded alone.
SEP = "\x00"
#: No id, in place of SEP.
MARK = b"\xff\xff"
#: Pre-tokens that a worker remembers, about 150 bytes each.
REMEMBERED = 250_000
SPACES = "\t-\r\x1c-\x20\x85\xa0  -     　"


def byte_to_char() -> dict[int, str]:
    """The byte table of byte-level BPE: printable bytes stand for themselves, others follow from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in same)}


BYTE_TO_CHAR = byte_to_char()
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """Ids of texts. At most limit pre-tokens are remembered; the first ones, so the frequent ones, stay."""

    def __init__(self, path: str, pattern: str, limit: int = REMEMBERED) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit = self.tokenizer.model, limit
        self.cut = regex.compile(SEP + "|" + pattern).findall
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token as 16-bit numbers."""
        found = self.known.get(text)
        if found is None:
            mapped = text.encode().decode("latin-1").translate(BYTE_TO_CHAR)
            tokens = self.model.tokenize(mapped)
            found = struct.pack(f"<{len(tokens)}H", *[t.id for t in tokens])
            if len(self.known) < self.limit:
                self.known[text] = found
        return found

    def chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of each chunk; no chunk holds SEP."""
        out: list[bytes] = []
        known, piece = self.known.get, self.piece
        for at in range(0, len(texts), 100_000):
            part: list[bytes] = []
            for p in self.cut(SEP.join(texts[at : at + 100_000])):
                if p == SEP:
                    out.append(b"".join(part))
                    part = []
                else:
                    part.append(known(p) or piece(p))
            out.append(b"".join(part))
        return out

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, as 16-bit numbers, and how many each chunk has; no chunk holds SEP.

        Only pre-tokens that aren't remembered take a step of Python; MARK stands for SEP meanwhile.
        """
        ids, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 100_000):
            pieces = self.cut(SEP.join(texts[at : at + 100_000]))
            self.known[SEP] = MARK
            found = list(map(self.known.get, pieces))
            del self.known[SEP]
            for i in [i for i, ids_of in enumerate(found) if ids_of is None]:
                found[i] = self.piece(pieces[i])
            flat = np.frombuffer(b"".join([*found, MARK]), "<u2")
            marks = flat == 0xFFFF
            sizes.append(np.diff(np.flatnonzero(marks), prepend=-1) - 1)
            ids.append(flat[~marks])
        return np.concatenate(ids), np.concatenate(sizes)

    def normal(self, chunks: list[str]) -> list[str]:
        return chunks

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, bool]:
        """The chunks of all texts, where each text's begin (and the last one's end), whether later chunks have a space in front."""
        raise NotImplementedError

    def alone(self, texts: pa.Array) -> pa.Array:
        """Whether a text can't be split."""
        raise NotImplementedError

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as 16-bit numbers; null is an empty text."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(self.alone(texts))
        out: list[np.ndarray] = [np.zeros(0, "<u2")] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = np.frombuffer(self.whole(texts[int(i)].as_py()), "<u2")
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        values, bounds, spaced = self.split(texts.take(pa.array(plain)) if odd.any() else texts)
        coded = values.dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), np.array(coded.indices, dtype=np.int64)
        if spaced:
            first = values.take(pa.array(bounds[:-1])).to_pylist()
            table = self.chunks(self.normal([" " + c for c in distinct])) + self.chunks(self.normal(first))
            index[bounds[:-1]] = len(distinct) + np.arange(len(first))
        else:
            table = self.chunks(self.normal(distinct))
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 2
        flat, starts = np.frombuffer(b"".join(table), "<u2"), np.concatenate(([0], np.cumsum(lengths)))
        sizes = lengths[index]
        ids = flat[run_lengths(starts[index], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        for i, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
            out[i] = ids[a:b]
        return out

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.cut(text)))


class ByteEncoder(Encoder):
    """Byte-level BPE. Its pre-tokens never cross a single space that stands between two other characters, from the left."""

    odd = f"{SEP}| [{SPACES}]|[{SPACES}] |^ |[{SPACES}]\\z"

    def alone(self, texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, self.odd)

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, bool]:
        parts = pc.split_pattern(texts, " ")
        return parts.flatten(), np.array(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py(), True

    def whole(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.piece, self.pattern(text))) for text in [text])

    def __init__(self, path: str, pattern: str, limit: int = REMEMBERED) -> None:
        super().__init__(path, pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{SEP}]"), limit)
        self.pattern = regex.compile(pattern).findall


class WordEncoder(Encoder):
    """Lower-casing BPE with word ends: white space only separates.

    special: whether a text that spells a special token gets that token's id, as encode() does
    unless it is told not to; such texts are encoded alone.
    """

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}" + SEP + "]+"
    #: Characters that the normalizer only lower-cases, as Python does.
    simple = regex.compile(r"[\x01-\x7e\xa1-ɏ]*").fullmatch
    #: Marks that often end a chunk; behind letters each is a pre-token of its own.
    marks = ".,;:!?"

    def __init__(self, path: str, limit: int = REMEMBERED, special: bool = True) -> None:
        super().__init__(path, self.pattern, limit)
        self.tokenizer.encode_special_tokens = not special
        spelled = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.odd = "|".join([SEP, *spelled])

    def alone(self, texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, self.odd, ignore_case=True)

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As Encoder.joined(); only chunks that aren't simple letters with one of marks at most behind them go through the pattern."""
        found, rest = [], []
        known, letters, simple, marks = self.known.get, self.letters, self.simple, {m: self.piece(m) for m in self.marks}
        for text in texts:
            end = b"" if text.isalpha() else marks.get(text[-1:])
            stem = text if end == b"" else text[:-1]
            if end is None or not stem.isalpha() or not (stem.isascii() or simple(stem)):
                rest.append(len(found))
                found.append(b"")
            else:
                found.append((known(stem) or letters(stem)) + end)
        ids, sizes = super().joined([texts[i] for i in rest])
        at, ids = 0, ids.tobytes()
        for i, size in zip(rest, (sizes * 2).tolist(), strict=True):
            found[i] = ids[at : at + size]
            at += size
        return np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2

    def letters(self, text: str) -> bytes:
        """As piece(), of letters that aren't remembered."""
        found = array("H", [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_TO_CHAR))]).tobytes()
        if len(self.known) < self.limit:
            self.known[text] = found
        return found

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, bool]:
        parts = pc.ascii_split_whitespace(texts)
        return parts.flatten(), np.array(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py(), False

    def normal(self, chunks: list[str]) -> list[str]:
        if self.simple("".join(chunks)):
            return [c.lower() for c in chunks]
        lower = self.tokenizer.normalizer.normalize_str
        return [c.lower() if self.simple(c) else lower(c) for c in chunks]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@cache
def encoder(make: Callable[..., Encoder], *args) -> Encoder:
    """One encoder, with what it has learned, for each Python worker."""
    return make(*args)
