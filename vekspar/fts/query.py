"""The full-text query language: lexer, parser, simplification.

Precedence from the lowest: OR; AND and binary NOT; adjacent atoms, by the default operator;
+ and - and atoms. ``field:x`` and ``x^2`` are syntax that is not supported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from ..errors import InvalidArgument, NotSupported, ParseError

MAX_TOKENS, MAX_DEPTH = 65_536, 256
_ESCAPE = r"""\\[-+=&|!(){}\[\]^"~*?:\\/]"""
_START = "A-Za-z0-9_\x80-￿"
#: In the order that decides between rules of the same length.
_RULES = [
    ("OR", r"[oO][rR]"), ("AND", r"[aA][nN][dD]"), ("NOT", r"[nN][oO][tT]"), ("PLUS", r"\+"), ("MINUS", "-"), ("COLON", ":"), ("CARET", r"\^"), ("LPAREN", r"\("), ("RPAREN", r"\)"),
    ("PHRASE", r'"(?:[^"\\\r\n]|\\[\s\S])*"'), ("WORD", r"[A-Za-z_][A-Za-z0-9_-]*"), ("NUMBER", r"[0-9]+(?:\.[0-9]+)?"), ("TERM", rf"[{_START}](?:[{_START}._#/%\-'@]|{_ESCAPE})*"), ("OTHER", r"[\s\S]"),
]
_RULES = [(k, re.compile(r)) for k, r in _RULES]


@dataclass(frozen=True)
class QueryToken:
    kind: str
    text: str
    at: int


def lex(text: str) -> list[QueryToken]:
    out, at = [], 0
    while at < len(text):
        if text[at] in " \t\r\n":
            at += 1
            continue
        if len(out) >= MAX_TOKENS:
            raise ParseError("too many tokens", text, at)
        found = [(m.end(), -i, kind) for i, (kind, rule) in enumerate(_RULES) if (m := rule.match(text, at))]
        end, _, kind = max(found)
        out.append(QueryToken(kind, text[at:end], at))
        at = end
    return [*out, QueryToken("END", "", at)]


@dataclass(frozen=True)
class Node:
    """kind: term, phrase, and, or, empty. mark: '', '+' (must), '-' (must not), '?' (should)."""

    kind: str
    terms: tuple[str, ...] = ()
    children: tuple[Node, ...] = ()
    mark: str = ""
    boost: float = 1.0

    def __str__(self) -> str:
        if self.kind == "empty":
            return "<empty>"
        if self.kind == "term":
            body = self.terms[0]
        elif self.kind == "phrase":
            body = '"' + " ".join(self.terms) + '"'
        else:
            body = f"{self.kind.upper()}({' '.join(map(str, self.children))})"
        return self.mark + body + ("" if self.boost == 1 else f"^{self.boost:g}")


EMPTY = Node("empty")
Analyze = Callable[[str], list[str]]


def _combined(nodes: list[Node], kind: str) -> Node:
    return EMPTY if not nodes else nodes[0] if len(nodes) == 1 else Node(kind, children=tuple(nodes))


class _Parser:
    """First the syntax of everything, then what is supported and the analysis."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.i, self.depth = text, lex(text), 0, 0

    @property
    def now(self) -> QueryToken:
        return self.tokens[self.i]

    def take(self, kind: str) -> bool:
        if self.now.kind == kind:
            self.i += 1
            return True
        return False

    def fail(self, wanted: str) -> ParseError:
        return ParseError(f"expected {wanted}", self.text, self.now.at)

    def whole(self) -> tuple:
        tree = self.disjunction()
        if self.now.kind != "END":
            raise self.fail("the end")
        return tree

    def disjunction(self) -> tuple:
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def conjunction(self) -> tuple:
        parts = [self.adjacent()]
        while self.now.kind in ("AND", "NOT"):
            self.take("AND")
            negated = self.take("NOT")
            part = self.adjacent()
            parts.append(("mark", "-", part) if negated else part)
        return ("and", parts) if len(parts) > 1 else parts[0]

    def adjacent(self) -> tuple:
        parts = [self.unary()]
        while self.now.kind not in ("END", "OR", "AND", "NOT", "RPAREN"):
            parts.append(self.unary())
        return ("default", parts) if len(parts) > 1 else parts[0]

    def unary(self) -> tuple:
        mark = self.now.text if self.now.kind in ("PLUS", "MINUS") else ""
        if mark:
            self.i += 1
        atom = self.atom()
        return ("mark", mark, atom) if mark else atom

    def atom(self) -> tuple:
        t = self.now
        if self.take("LPAREN"):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise ParseError("nested too deeply", self.text, t.at)
            inner = self.disjunction()
            if not self.take("RPAREN"):
                raise self.fail("')'")
            self.depth -= 1
            return self.boosted(inner, t)
        if t.kind in ("PHRASE", "WORD", "NUMBER", "TERM", "OTHER"):
            self.i += 1
            if t.kind == "WORD" and self.take("COLON"):
                return ("unsupported", "field-prefixed queries are not supported", t, self.atom())
            return self.boosted(("phrase" if t.kind == "PHRASE" else "word", t.text), t)
        raise self.fail("a term")

    def boosted(self, inner: tuple, t: QueryToken) -> tuple:
        if self.take("CARET"):
            if not self.take("NUMBER"):
                raise self.fail("a number")
            return ("unsupported", "boost queries are not supported", t, inner)
        return inner


def _unescape(text: str) -> str:
    return re.sub(_ESCAPE, lambda m: m[0][1], text)


def _build(tree: tuple, analyze: Analyze, default: str) -> Node:
    kind = tree[0]
    if kind == "phrase":
        return Node("phrase", tuple(analyze(_unescape(tree[1][1:-1]))))
    if kind == "word":
        return _combined([Node("term", (t,)) for t in analyze(_unescape(tree[1]))], default)
    if kind == "mark":
        return replace(_build(tree[2], analyze, default), mark=tree[1])
    parts = [n for n in (_build(t, analyze, default) for t in tree[1]) if n.kind != "empty"]
    return _combined(parts, default if kind == "default" else kind)


def _unsupported(tree: object, text: str) -> None:
    if isinstance(tree, tuple):
        if tree and tree[0] == "unsupported":
            raise NotSupported(f"{tree[1]} (offset {len(text[: tree[2].at].encode())})", "parse text query")
        for t in tree:
            _unsupported(t, text)
    elif isinstance(tree, list):
        for t in tree:
            _unsupported(t, text)


def _operator(name: str) -> str:
    if name.upper() not in ("OR", "AND"):
        raise InvalidArgument(f"default operator {name!r}", "text query")
    return name.lower()


def parse(text: str, analyze: Analyze, default_operator: str = "OR") -> Node:
    default = _operator(default_operator)
    if not text.strip(" \t\r\n"):
        raise ParseError("expected a term", text, 0)
    tree = _Parser(text).whole()
    _unsupported(tree, text)
    return _build(tree, analyze, default)


def match(text: str, analyze: Analyze, default_operator: str = "OR") -> Node:
    """Plain text: all its terms, joined by the default operator."""
    return _combined([Node("term", (t,)) for t in analyze(text)], _operator(default_operator))


# --- Simplification ------------------------------------------------------------------------


def _key(n: Node) -> tuple:
    return (n.kind, n.terms, tuple(_key(c) for c in n.children))


def _merged(nodes: list[Node]) -> list[Node]:
    """Equal terms and phrases with equal marks become one, their boosts added."""
    out: list[Node] = []
    places: dict[tuple, int] = {}
    for n in nodes:
        key = (_key(n), n.mark)
        if n.kind in ("term", "phrase") and key in places:
            i = places[key]
            out[i] = replace(out[i], boost=out[i].boost + n.boost)
        else:
            places.setdefault(key, len(out))
            out.append(n)
    return out


def simplify(n: Node) -> Node:
    """The canonical form: flat, without doubles; AND children are plain (must), - or ?."""
    if not math.isfinite(n.boost):
        raise InvalidArgument("a boost must be finite", "text query")
    found = _simple(n)
    return EMPTY if found.mark == "-" else replace(found, mark="")


def _simple(n: Node) -> Node:
    if n.kind in ("term", "phrase", "empty"):
        return EMPTY if n.kind == "phrase" and not n.terms else replace(n, kind="term") if n.kind == "phrase" and len(n.terms) == 1 else n
    children = []
    for c in map(_simple, n.children):
        if c.kind == "empty":
            if n.kind == "and" and c.mark not in ("-", "?"):
                return EMPTY
            continue
        if c.kind == n.kind and not c.mark and c.boost == 1:
            children += c.children
        else:
            children.append(c)
    if n.kind == "or" and any(c.mark in ("+", "-") for c in children):
        must = [replace(c, mark="") for c in children if c.mark == "+"]
        gone = [c for c in children if c.mark == "-"]
        free = [replace(c, mark="") for c in children if c.mark not in ("+", "-")]
        if must:
            should = _simple(_combined(_merged(free), "or")) if free else EMPTY
            children = [*must, *gone, *([replace(should, mark="?")] if should.kind != "empty" else [])]
        elif free:
            children = [_simple(_combined(_merged(free), "or")), *gone]
        else:
            return EMPTY
        return replace(_simple(Node("and", children=tuple(children))), mark=n.mark)
    if n.kind == "and":
        children = [replace(c, mark="") if c.mark == "+" else c for c in children]
        flat = []
        for c in children:
            flat += c.children if c.kind == "and" and not c.mark and c.boost == 1 else [c]
        children = flat
    children = _merged(children)
    if n.kind == "and":
        positive = {_key(c) for c in children if c.mark == ""}
        if any(c.mark == "-" and _key(c) in positive for c in children) or not positive:
            return EMPTY
    if not children:
        return EMPTY
    if len(children) == 1:
        return replace(children[0], mark=n.mark, boost=children[0].boost * n.boost)
    return replace(n, children=tuple(children))
