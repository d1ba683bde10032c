"""Secret scans: patterns, and an assignment-aware lexer of source and configuration text.

The lexer finds pairs of a name and an expression (``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``name => 'literal'``, ``name: type = "literal"``, ``set name literal``
and the like); names may have subscripts and attributes (``a["name"].b``). An expression
is made of quoted literals, bare values and other names, joined by ``+`` or ``.``; names stand
for what was last assigned to them, so a literal kept in a plain constant is found where a
sensitive name takes it. A literal's score adds what the target's name says and how random the
literal looks; placeholders, references and prose score nothing.

The time is in proportion to the length of the text: values that start within one run of
characters share its end, and each character of it counts once.

Spans are code points of the whole text, the end exclusive. Kinds in order: assign, access,
hex (the base patterns), named (the lexer's, the literal alone, unless a base span covers it).

Defined results: a null text is empty and has no span; repeated rows stay; an empty table
gives an empty result; other columns are not read by the scan and are kept by redact().
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, pick, small_batches, texts_of

KINDS = ("assign", "access", "hex", "named")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Parts of names, and what they say about the value.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "authkey": 3, "signingkey": 3, "encryptionkey": 3, "credential": 2, "bearer": 2, "authorization": 2}
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]{0,80}+"
_BLANK = r"[\x20\t]"
#: Subscripts and attributes behind a name.
_PATH = rf"""(?:\[{_BLANK}*(?:"[^"\]\n]{{0,80}}"|'[^'\]\n]{{0,80}}'|[A-Za-z0-9_.-]{{1,80}}){_BLANK}*\]|(?:\?\.|\.|->|::){_NAME}){{0,16}}+"""
_TYPE_NAME = r"[&*]?[A-Za-z_][A-Za-z0-9_.:]{0,80}+(?:\[[^\]\n=]{0,80}\]|<[^\n=>]{0,80}>)*\??"
#: A type between a colon and the sign; the sign stands apart or before a quote, as a bare value may end in '='.
_TYPE = rf""":{_BLANK}*{_TYPE_NAME}(?:{_BLANK}*\|{_BLANK}*{_TYPE_NAME}){{0,16}}(?:{_BLANK}+=(?![=>~])|=(?=["'`]))(?={_BLANK}*[^\x20\t\n])"""
#: A name with an assignment sign, as keys of mappings and subscripts too, or 'set name'; the expression is read from there.
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_.-])(?P<set>(?ai:set){_BLANK}+(?:--?[A-Za-z]+{_BLANK}+)*)?(?:["'](?P<quoted>{_NAME})["'](?:{_BLANK}*\])*|(?P<plain>{_NAME}{_PATH}))(?:[?!]?{_BLANK}*(?:{_TYPE}|:=|=>|=(?!=)|:(?![:/]))|{_BLANK}+(?:is|to)(?={_BLANK}["'])|(?(set){_BLANK}+(?=["'`A-Za-z0-9+/_$])|(?!))){_BLANK}*""")
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+") for q in "\"'`"}
_BARE = re.compile(r"[A-Za-z0-9+/_=@#$%^&*!~.-]+")
_JOIN = re.compile(r"[\x20\t]*(?:\+|\.(?=[\x20\t]|[\"'`]))[\x20\t]*")
_IDENTIFIER = re.compile(_NAME).fullmatch
#: Placeholders: words (none longer than EDGE), and what stands between an opening and a closing sign.
_PLACEHOLDER = re.compile(r"(?ai:change_?me|example|placeholder|your[_-]|dummy|xxx|\*\*\*|\.\.\.|none|null|true|false|todo)")
_BRACKETS = (("<", ">"), ("${", "}"), ("%(", ")"), ("{{", "}}"))
EDGE, LONGEST_NAME = 16, 81


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> int:
    flat = re.sub("[^a-z]", "", name.lower())
    return max((v for k, v in SENSITIVE.items() if k in flat), default=0)


def may_name(text: str) -> bool:
    """Whether any name in the text can have a score: names are ASCII and lie in one piece, so their letters do so here."""
    flat = text.encode("ascii", "ignore").lower().translate(None, _NO_LETTERS).decode()
    return any(k in flat for k in SENSITIVE)


class Value:
    """What a name stands for: a term, or joined values, with all that its score needs.

    A term knows its place alone until its score is asked for. Joined values keep their parts
    instead of their text, so a value that feeds on itself stays small and nothing of it is
    forgotten.
    """

    __slots__ = ("_known", "parts", "quoted", "run", "span", "text")

    def __init__(self, text: str, span: tuple[int, int] | None = None, quoted: bool = True, run: Run | None = None) -> None:
        self.text, self.span, self.quoted, self.run = text, span or (0, len(text)), quoted, run
        self.parts: tuple[Value, ...] = ()
        self._known: Facts | None = None

    @classmethod
    def join(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls("", (0, 0), all(p.quoted for p in parts))
        out.parts = tuple(parts)
        return out

    @property
    def facts(self) -> Facts:
        """Of the term or of all parts; those of parts come first, without recursion."""
        open_ = [self]
        while open_:
            v = open_[-1]
            missing = [p for p in v.parts if p._known is None]
            if v._known is None and missing:
                open_ += missing
                continue
            open_.pop()
            if v._known is None:
                if v.parts:
                    v._known = Facts()
                    for p in v.parts:
                        v._known.add(p._known)
                else:
                    v._known = v.run.facts(v.span[0]) if v.run else Facts.of(v.text[v.span[0] : v.span[1]])
        return self._known

    def score(self, quoted: bool) -> float:
        return self.facts.score(quoted)

    @property
    def placeholder(self) -> bool:
        return self.facts.placeholder

    @property
    def size(self) -> int:
        return self.facts.size


class Facts:
    """What a score needs to know of a text."""

    __slots__ = ("closed", "counts", "head", "opened", "placeholder", "size", "tail")

    def __init__(self) -> None:
        self.size, self.counts, self.head, self.tail, self.placeholder = 0, Counter(), "", "", False
        self.opened, self.closed = [False] * len(_BRACKETS), [False] * len(_BRACKETS)

    @classmethod
    def of(cls, text: str) -> Facts:
        out = cls()
        out.size, out.counts, out.head, out.tail = len(text), Counter(text), text[:EDGE], text[-EDGE:]
        out.opened, out.closed = [a in text for a, _ in _BRACKETS], [b in text for _, b in _BRACKETS]
        out.placeholder = bool(_PLACEHOLDER.search(text)) or any(0 <= text.find(a) < text.rfind(b) for a, b in _BRACKETS)
        return out

    def add(self, p: Facts) -> None:
        """The facts of the text followed by another one."""
        seam, cut = self.tail + p.head, len(self.tail)
        opens = [a in seam[max(0, cut - 1) : cut + 1] and len(a) > 1 for a, _ in _BRACKETS]
        closes = [b in seam[max(0, cut - 1) : cut + 1] and len(b) > 1 for _, b in _BRACKETS]
        self.placeholder |= p.placeholder or bool(_PLACEHOLDER.search(seam)) or any((a or s) and (b or t) for a, s, b, t in zip(self.opened, opens, p.closed, closes, strict=True))
        self.opened = [a or b or c for a, b, c in zip(self.opened, p.opened, opens, strict=True)]
        self.closed = [a or b or c for a, b, c in zip(self.closed, p.closed, closes, strict=True)]
        self.head, self.tail = (self.head + p.head)[:EDGE] if self.size < EDGE else self.head, (self.tail + p.tail)[-EDGE:] if p.size < EDGE else p.tail
        self.size += p.size
        self.counts.update(p.counts)

    def score(self, quoted: bool) -> float:
        """How much it looks like a secret: length, kinds of characters and entropy."""
        if self.size < 8 or " " in self.counts or self.placeholder:
            return 0.0
        chars = "".join(self.counts)
        classes = sum(bool(re.search(c, chars)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        shares = [c / self.size for c in self.counts.values()]
        entropy = -sum(x * math.log2(x) for x in shares if x > 0)
        return (classes - 1) * 0.75 + max(0.0, entropy - 2.5) + 0.5 * quoted


class Run:
    """A run of characters of bare values. Several values may start in it; all of them reach to its end.

    Their facts are made from the end of the run on, so each character counts once.
    """

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self.starts: list[int] = []
        self.made: dict[int, Facts] | None = None

    def facts(self, at: int) -> Facts:
        if self.made is None or at not in self.made:
            self.made, upto, behind = {}, self.end, Facts()
            for start in sorted(set(self.starts), reverse=True):
                own = Facts.of(self.text[start:upto])
                own.add(behind)
                self.made[start], upto, behind = own, start, own
        return self.made[at]


def literal_score(value: str, quoted: bool) -> float:
    return Value(value, quoted=quoted).score(quoted)


class Lexer:
    """Terms of the expressions of a text; each place of it is scanned a bounded number of times."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.run: Run | None = None
        self.unclosed = {q: -1 for q in _QUOTED}  # where a line ends in which a quote isn't closed

    def term(self, at: int) -> tuple[Value, int] | None:
        """The term at a place, and where it ends."""
        text = self.text
        quote = text[at : at + 1]
        if quote in _QUOTED and quote:
            if at < self.unclosed[quote]:
                return None
            end = _QUOTED[quote].match(text, at + 1).end()
            if text[end : end + 1] == quote:
                return Value(text, (at + 1, end)), end + 1
            self.unclosed[quote] = end
            return None
        if self.run is None or not self.run.start <= at < self.run.end:
            m = _BARE.match(text, at)
            if not m:
                return None
            self.run = Run(text, at, m.end())
        self.run.starts.append(at)
        return Value(text, (at, self.run.end), False, self.run), self.run.end

    def expression(self, at: int) -> list[Value]:
        """The terms joined from a place on."""
        terms = []
        while found := self.term(at):
            terms.append(found[0])
            joined = _JOIN.match(self.text, found[1])
            if not joined:
                break
            at = joined.end()
        return terms


def named_spans(text: str, threshold: float = 4.0) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name with enough score."""
    if not may_name(text):
        return []
    # Names first: by then every start in a run is known before a score is asked for.
    lexer, pairs = Lexer(text), []
    for m in _PAIR.finditer(text):
        if terms := lexer.expression(m.end()):
            pairs.append((m["quoted"] or m["plain"], terms))
    constants: dict[str, Value] = {}
    found, told, keep = set(), set(), []  # told: ids of the values in keep
    for name, terms in pairs:
        parts = []
        for term in terms:
            a, b = term.span
            known = constants.get(text[a:b]) if not term.quoted and b - a <= LONGEST_NAME and _IDENTIFIER(text, a, b) else None
            parts.append(known if known is not None else term)
        value = constants[name] = Value.join(parts)
        weight = name_score(name)
        if weight and weight + value.score(value.quoted) >= threshold and value.score(False) > 0:
            open_ = [value]
            while open_:  # each part once in a text, however often it is joined
                v = open_.pop()
                if id(v) not in told:
                    told.add(id(v))
                    keep.append(v)
                    open_ += v.parts
                    if not v.parts and v.span[1] > v.span[0]:
                        found.add(v.span)
    return sorted(found)


def spans(text: str, threshold: float = 4.0) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted."""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))  # how far the spans up to each one go
    extra = []
    for a, b in named_spans(text, threshold):
        before = bisect_right(starts, a)
        if not before or reach[before - 1] < b:
            extra.append((a, 3, b))
    return sorted(base + extra)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 4.0) -> DataFrame:
    """Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                found = spans(text, threshold)
                n = [sum(k == kind for _, k, _ in found) for kind in range(4)]
                base = hashlib.sha256(written([x for x in found if x[1] < 3]).encode()).hexdigest()
                rows.append((*n[:3], base, written(found), n[3]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    d = pick(docs, doc_id=id_col, text=text_col)
    return mapped(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long")


def redacted(text: str, mark: str = "[secret]", threshold: float = 4.0) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at, upto = [], 0, 0
    for a, _, b in spans(text, threshold):
        if a >= upto:
            out += [text[at if not out else upto : a], mark]
        upto = max(upto, b)
        at = upto
    return "".join([*out, text[upto:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", threshold: float = 4.0) -> DataFrame:
    """docs with the secrets of the text column replaced; a null text stays null, all other columns and rows too."""

    @F.pandas_udf(T.StringType())
    def run(texts):
        return texts.map(lambda x: redacted(x, mark, threshold), na_action="ignore")

    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, run(F.col(f"`{text_col}`")))
