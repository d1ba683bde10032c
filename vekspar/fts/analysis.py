"""Text analysis: tokenizers and token filters that make terms with positions and byte offsets."""

from __future__ import annotations

import math
import os
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotSupported
from ..schema import FTSIndexParams
from .stemmer import stem_english


@dataclass(frozen=True)
class Token:
    text: str
    position: int
    start: int  # byte offsets in UTF-8
    end: int


Tokenizer = Callable[[str], list[Token]]
Filter = Callable[[list[Token]], list[Token]]


def _tokens(text: str, spans: Iterator[tuple[int, int]]) -> list[Token]:
    """Tokens of code point spans, in order."""
    out, at, byte = [], 0, 0
    for n, (a, b) in enumerate(spans):
        byte += len(text[at:a].encode("utf-8", "surrogatepass"))
        size = len(text[a:b].encode("utf-8", "surrogatepass"))
        out.append(Token(text[a:b], n, byte, byte + size))
        at, byte = a, byte
    return out


# --- Tokenizers ----------------------------------------------------------------------------

_SPACE = regex.compile(r"[^ \t\n\r\x0b\x0c]+")


def whitespace(text: str) -> list[Token]:
    """Splits at the six ASCII spaces only."""
    return _tokens(text, (m.span() for m in _SPACE.finditer(text)))


_EXT = r"[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]*"
_L = rf"(?:[\p{{WB=ALetter}}\p{{WB=Hebrew_Letter}}]{_EXT})"
_N = rf"(?:\p{{WB=Numeric}}{_EXT})"
_U = rf"(?:\p{{WB=ExtendNumLet}}{_EXT})"
_MID_LETTER = rf"(?:[\p{{WB=MidLetter}}\p{{WB=MidNumLet}}\p{{WB=Single_Quote}}]{_EXT})"
_MID_NUMBER = rf"(?:[\p{{WB=MidNum}}\p{{WB=MidNumLet}}\p{{WB=Single_Quote}}]{_EXT})"
_PICTURE = r"(?:\p{Extended_Pictographic}(?:\p{Emoji_Modifier}|️)?)"
#: Emoji, single ideographs, runs of a script, then letters and digits with what joins them.
_STANDARD = regex.compile(
    r"[0-9#*]️?⃣"
    r"|\p{Regional_Indicator}{2}"
    rf"|{_PICTURE}(?:‍{_PICTURE})*"
    rf"|[\p{{Han}}\p{{Hiragana}}]{_EXT}"
    rf"|(?:\p{{WB=Katakana}}{_EXT})+"
    rf"|(?:\p{{Hangul}}{_EXT})+"
    rf"|(?:\p{{LB=SA}}{_EXT})+"
    rf"|{_U}*(?:{_L}|{_N})(?:{_L}|{_N}|{_U}|{_MID_LETTER}(?<={_L}{_MID_LETTER})(?={_L})|{_MID_NUMBER}(?<={_N}{_MID_NUMBER})(?={_N}))*"
)


def _standard_spans(text: str, max_length: int) -> Iterator[tuple[int, int]]:
    for m in _STANDARD.finditer(text):
        a, b = m.span()
        while b - a > max_length:
            yield a, a + max_length
            a += max_length
            while a < b and not (text[a].isalnum() or ord(text[a]) > 0x2E80):
                a += 1
        if a < b:
            yield a, b


def standard(text: str, max_length: int = 255) -> list[Token]:
    """Words by Unicode word breaks: single ideographs, runs of Katakana, Hangul and South-East Asian scripts, emoji."""
    return _tokens(text, _standard_spans(text, max_length))


def _standard_terms(text: str, max_length: int) -> list[str]:
    """The same tokens' texts. In ASCII a piece of letters and digits alone is one token."""
    if not text.isascii():
        return [text[a:b] for a, b in _standard_spans(text, max_length)]
    out: list[str] = []
    for piece in _ASCII_PIECE.findall(text):
        if len(piece) <= max_length and piece.isalnum():
            out.append(piece)
        else:
            out += [piece[a:b] for a, b in _standard_spans(piece, max_length)]
    return out


#: Pieces of ASCII text: no token of the standard tokenizer reaches from one into another.
_ASCII_PIECE = regex.compile(r"[0-9A-Za-z_'.:,;]+")

_CLASSES = {"letter": "L", "digit": "N", "whitespace": "Z", "punctuation": "P", "symbol": "S"}


def ngram(text: str, low: int = 2, high: int = 2, classes: tuple[str, ...] = ()) -> list[Token]:
    """Runs of low to high code points, at each place the shorter first; with classes, within runs of those characters."""

    def fits(c: str) -> bool:
        return not classes or any(unicodedata.category(c)[0] == _CLASSES[k] or (k == "whitespace" and c.isspace()) for k in classes)

    def spans() -> Iterator[tuple[int, int]]:
        a = 0
        while a < len(text):
            if not fits(text[a]):
                a += 1
                continue
            b = a
            while b < len(text) and fits(text[b]):
                b += 1
            for i in range(a, b):
                for n in range(low, high + 1):
                    if i + n <= b:
                        yield i, i + n
            a = b

    return _tokens(text, spans())


class Jieba:
    """Chinese segmentation with a dictionary of words and frequencies, best path by probability.

    Modes: full (all words), mix (best path), search (best path, with its words of two and
    three characters as well), hmm (as mix: words outside the dictionary are single characters).
    """

    def __init__(self, directory: str, mode: str = "search", user: str = "") -> None:
        path = os.path.join(directory, "jieba.dict.utf8")
        if not os.path.exists(path):
            raise InvalidArgument(f"no dictionary at {path}", "jieba")
        self.mode, self.words = mode, {}
        for p in (path, user):
            if p:
                with open(p, encoding="utf-8") as lines:
                    for line in lines:
                        parts = line.split()
                        if parts:
                            self.words[parts[0]] = float(parts[1]) if len(parts) > 1 and parts[1].replace(".", "", 1).isdigit() else 1.0
        self.total = math.log(sum(self.words.values()) or 1.0)
        self.longest = max(map(len, self.words), default=1)

    def _ends(self, text: str, i: int) -> list[int]:
        return [j for j in range(i + 1, min(len(text), i + self.longest) + 1) if text[i:j] in self.words] or [i + 1]

    def _path(self, text: str) -> list[tuple[int, int]]:
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            best[i] = max((math.log(self.words.get(text[i:j], 1.0)) - self.total + best[j][0], j) for j in self._ends(text, i))
        out, i = [], 0
        while i < len(text):
            out.append((i, best[i][1]))
            i = best[i][1]
        return out

    def __call__(self, text: str) -> list[Token]:
        spans: list[tuple[int, int]] = []
        for m in regex.finditer(r"\p{Han}+|[\p{L}\p{N}]+", text):
            a = m.start()
            if not regex.match(r"\p{Han}", m[0]):
                spans.append(m.span())
            elif self.mode == "full":
                spans += [(a + i, a + j) for i in range(len(m[0])) for j in self._ends(m[0], i)]
            else:
                for i, j in self._path(m[0]):
                    if self.mode == "search":
                        spans += [(a + k, a + k + n) for n in (2, 3) for k in range(i, j - n + 1) if n < j - i and m[0][k : k + n] in self.words]
                    spans.append((a + i, a + j))
        return [replace(t, position=n) for n, t in enumerate(t for s in spans for t in _tokens(text, iter([s])))]


# --- Filters -------------------------------------------------------------------------------


@cache
def _lower(c: str) -> str:
    """One code point to one: U+0130 becomes i, sigma has one form only."""
    if c == "İ":
        return "i"
    low = c.lower()
    return low if len(low) == 1 else c


def _lowered(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(_lower, text))


def lowercase(tokens: list[Token]) -> list[Token]:
    return [replace(t, text=_lowered(t.text)) for t in tokens]


_FOLDS = str.maketrans({
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "TH", "þ": "th", "ß": "ss", "ẞ": "SS", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h",
    "ı": "i", "ĸ": "q", "Ŋ": "N", "ŋ": "n", "Ŧ": "T", "ŧ": "t", "ƒ": "f", "Ƒ": "F", "Ɓ": "B", "ɓ": "b", "Ɗ": "D", "ɗ": "d", "Ɛ": "E", "ɛ": "e", "Ə": "A", "ə": "a", "Ɠ": "G", "ɠ": "g", "Ɨ": "I", "ɨ": "i", "Ƙ": "K", "ƙ": "k", "Ɲ": "N", "ɲ": "n", "Ɵ": "O", "ɵ": "o", "Ƥ": "P", "ƥ": "p", "Ƭ": "T", "ƭ": "t", "Ʈ": "T", "ʈ": "t", "Ʋ": "V", "ʋ": "v", "Ƴ": "Y", "ƴ": "y", "Ƶ": "Z", "ƶ": "z",
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‹": "'", "›": "'", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "⁄": "/",
})


@cache
def _fold(c: str) -> str:
    d = c.translate(_FOLDS)
    if not d.isascii():
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).translate(_FOLDS)
        d = plain if plain.isascii() else c
    return d


def _folded(text: str) -> str:
    return text if text.isascii() else "".join(map(_fold, text))


def ascii_folding(tokens: list[Token]) -> list[Token]:
    """Letters to ASCII where that is possible; what has no ASCII form stays, empty tokens go."""
    folded = (replace(t, text=_folded(t.text)) for t in tokens)
    return [t for t in folded if t.text]


def stemmer(language: str) -> Filter:
    if language not in ("english", "porter"):
        raise NotSupported(f"no stemmer for {language} yet", "stemmer")
    return lambda tokens: [replace(t, text=stem_english(t.text)) for t in tokens]


#: The filters as functions of one token's text; after folding, empty texts go.
_BY_TEXT: dict[str, Callable[[str], str]] = {"lowercase": _lowered, "ascii_folding": _folded, "stemmer": stem_english}


# --- Pipelines -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer and the filters after it, from an index's parameters."""

    params: FTSIndexParams = FTSIndexParams()

    def __call__(self, text: str | None) -> list[Token]:
        return _analyze(self.params, text or "")

    def terms(self, text: str | None) -> list[str]:
        """The tokens' texts, without the tokens."""
        return _terms(self.params, text or "")

    def terms_column(self, text: Column) -> Column:
        """array<string> of a text column; null is an empty text. Each text's terms go into Arrow at once."""
        params = self.params

        @F.arrow_udf("array<string>")
        def run(texts: pa.Array) -> pa.Array:
            parts = [pa.array(_terms(params, x.as_py() or ""), pa.string()) for x in texts]
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.concat_arrays([*parts, pa.array([], pa.string())]))

        return run(text)

    def count(self, text: Column) -> Column:
        """The number of tokens of a text column; one text's tokens are in memory at a time."""
        params = self.params

        @F.arrow_udf("long")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([len(_terms(params, x.as_py() or "")) for x in texts], pa.int64())

        return run(text)

    def column(self, text: Column) -> Column:
        """array<struct<term, position, start, end>> of a text column; null is an empty text."""
        params = self.params

        @F.pandas_udf("array<struct<term: string, position: int, start: int, end: int>>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: [{"term": t.text, "position": t.position, "start": t.start, "end": t.end} for t in _analyze(params, x or "")])

        return run(text)


@cache
def _parts(params: FTSIndexParams) -> tuple[Tokenizer, tuple[Filter, ...]]:
    params.validate()
    extra = params.extra
    low = extra.get("ngram_min", 2)
    if params.tokenizer == "jieba":
        make: Tokenizer = Jieba(extra.get("dict_dir", ""), extra.get("cut_mode", "search"), extra.get("user_dict", ""))
    else:
        make = {
            "whitespace": whitespace,
            "standard": lambda text: standard(text, extra.get("max_token_length", 255)),
            "ngram": lambda text: ngram(text, low, extra.get("ngram_max", low), tuple(extra.get("token_chars", ()))),
        }[params.tokenizer]
    filters = {"lowercase": lambda: lowercase, "ascii_folding": lambda: ascii_folding, "stemmer": lambda: stemmer(extra.get("stemmer_lang", "english"))}
    return make, tuple(filters[name]() for name in params.filters)


def _analyze(params: FTSIndexParams, text: str) -> list[Token]:
    tokenize, filters = _parts(params)
    tokens = tokenize(text)
    for f in filters:
        tokens = f(tokens)
    return tokens


def _terms(params: FTSIndexParams, text: str) -> list[str]:
    _parts(params)  # checks them
    if params.tokenizer == "whitespace":
        terms = _SPACE.findall(text)
    elif params.tokenizer == "standard":
        terms = _standard_terms(text, params.extra.get("max_token_length", 255))
    else:
        return [t.text for t in _analyze(params, text)]
    for name in params.filters:
        if not (name == "ascii_folding" and text.isascii()):
            terms = list(map(_BY_TEXT[name], terms))
        if name == "ascii_folding":
            terms = [t for t in terms if t]
    return terms


def simple_terms(text: Column) -> Column:
    """The whitespace tokenizer and ASCII lower-casing as built-in expressions: array<string>."""
    ascii_lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(ascii_lower, r"[ \t\n\r\x0B\f]+"), "")


def simple_ngrams(text: Column, n: int = 2) -> Column:
    """Code point n-grams as built-in expressions."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n))))
