"""Boolean, phrase and prefix queries: syntax tree, parser, limits, wire form.

    query  := or        or := and (OR and)*       and := not (AND not)*
    not    := NOT not | '(' or ')' | "phrase" | word | word*

Operators are upper case; adjacent operands are an error. An unquoted word must
analyse to one token. An empty query, and a phrase without words, match nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from textloom import PROFILE
from textloom.functions.analysis import LimitError, analyze_text

# Fixed values of the wire form: magic, kind, version 1, no features.
MAGIC = b"PIN1"
KIND_QUERY = 5
SYNTAX_VERSION = 1
_HEADER = struct.Struct("<4sHHII")
_BODY = struct.Struct("<IHHI")
SPACES = " \t\n\f\r"


@dataclass(frozen=True)
class QueryLimits:
    bytes: int = 16_384
    nodes: int = 1_024
    depth: int = 64
    terms: int = 256
    term_bytes: int = 1_024


class QuerySyntaxError(ValueError):
    """Not a query; *offset* is the byte where that shows."""

    def __init__(self, offset: int) -> None:
        super().__init__(f"query syntax error at byte {offset}")
        self.offset = offset


class WireError(ValueError):
    """Bytes that are not an encoded query."""


@dataclass(frozen=True)
class Node:
    def children(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class Nothing(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    term: str


@dataclass(frozen=True)
class Prefix(Node):
    stem: str


@dataclass(frozen=True)
class Phrase(Node):
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Not(Node):
    child: Node

    def children(self) -> tuple[Node, ...]:
        return (self.child,)


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return (self.left, self.right)


def depth_of(node: Node) -> int:
    return 1 + max((depth_of(c) for c in node.children()), default=0)


def walk(node: Node):
    """Nodes, children first."""
    for c in node.children():
        yield from walk(c)
    yield node


@dataclass(frozen=True)
class Query:
    source: str
    root: Node

    @cached_property
    def node_count(self) -> int:
        return sum(1 for _ in walk(self.root))

    @cached_property
    def depth(self) -> int:
        return depth_of(self.root)

    @cached_property
    def term_count(self) -> int:
        return sum(len(n.terms) if isinstance(n, Phrase) else isinstance(n, Term | Prefix) for n in walk(self.root))

    @property
    def is_single_term(self) -> bool:
        return isinstance(self.root, Term)

    @property
    def profile(self) -> int:
        return PROFILE

    def encode(self) -> bytes:
        text = self.source.encode()
        body = _BODY.pack(PROFILE, SYNTAX_VERSION, 0, len(text)) + text
        return _HEADER.pack(MAGIC, KIND_QUERY, 1, 0, len(body)) + body


class _Parser:
    def __init__(self, source: str, limits: QueryLimits) -> None:
        self.s, self.at, self.limits = source, 0, limits
        self.nodes = self.terms = self.open = 0

    def fail(self, at: int | None = None) -> QuerySyntaxError:
        return QuerySyntaxError(len(self.s[: self.at if at is None else at].encode()))

    def skip(self) -> None:
        while self.at < len(self.s) and self.s[self.at] in SPACES:
            self.at += 1

    def made(self, node: Node, words: tuple[str, ...] = ()) -> Node:
        self.nodes += 1
        self.terms += len(words)
        if self.nodes > self.limits.nodes:
            raise LimitError("query nodes")
        if self.terms > self.limits.terms:
            raise LimitError("query terms")
        if any(len(w.encode()) > self.limits.term_bytes for w in words):
            raise LimitError("query term bytes")
        return node

    def word_end(self, at: int) -> int:
        while at < len(self.s) and self.s[at] not in SPACES + '()"':
            at += 1
        return at

    def keyword(self, name: str) -> bool:
        """Consume the operator *name* if it is next."""
        self.skip()
        end = self.word_end(self.at)
        if self.s[self.at : end] == name:
            self.at = end
            return True
        return False

    def binary(self, name: str, operand: Callable[[int], Node], make, level: int) -> Node:
        left = operand(level)
        while self.keyword(name):
            left = self.made(make(left, operand(level)))
        return left

    def either(self, level: int) -> Node:
        return self.binary("OR", self.both, Or, level)

    def both(self, level: int) -> Node:
        return self.binary("AND", self.unary, And, level)

    def unary(self, level: int) -> Node:
        flips = 0
        while self.keyword("NOT"):
            flips += 1
            if flips > self.limits.nodes:
                raise LimitError("query nodes")
        node = self.atom(level)
        for _ in range(flips):
            node = self.made(Not(node))
        return node

    def atom(self, level: int) -> Node:
        self.skip()
        if self.at >= len(self.s):
            raise self.fail()
        c = self.s[self.at]
        if c == "(":
            if level >= self.limits.depth:
                raise LimitError("query depth")
            self.at += 1
            node = self.either(level + 1)
            self.skip()
            if self.at >= len(self.s) or self.s[self.at] != ")":
                raise self.fail()
            self.at += 1
            return node
        if c == '"':
            return self.phrase()
        return self.literal()

    def phrase(self) -> Node:
        begin, out, i = self.at, [], self.at + 1
        while i < len(self.s) and self.s[i] != '"':
            if self.s[i] == "\\":
                i += 1
                if i >= len(self.s) or self.s[i] not in '"\\':
                    raise self.fail(i - 1)
            out.append(self.s[i])
            i += 1
        if i >= len(self.s):
            raise self.fail(begin)
        self.at = i + 1
        words = tuple(analyze_text("".join(out)))
        return self.made(Phrase(words) if words else Nothing(), words)

    def literal(self) -> Node:
        begin, end = self.at, self.word_end(self.at)
        text = self.s[begin:end]
        if not text or text in ("AND", "OR", "NOT"):
            raise self.fail(begin)
        stem = text.removesuffix("*")
        if not stem or "*" in stem or "\\" in stem:
            raise self.fail(begin)
        words = tuple(analyze_text(stem))
        if len(words) != 1:
            raise self.fail(begin)
        self.at = end
        return self.made(Prefix(words[0]) if stem != text else Term(words[0]), words)


def parse_query(source: str, limits: QueryLimits | None = None) -> Query:
    """The query that *source* says; QuerySyntaxError or LimitError otherwise."""
    limits = limits or QueryLimits()
    if len(source.encode()) > limits.bytes:
        raise LimitError("query bytes")
    parser = _Parser(source, limits)
    parser.skip()
    if parser.at == len(source):
        return Query(source, Nothing())
    root = parser.either(0)
    parser.skip()
    if parser.at < len(source):
        raise parser.fail()
    if _depth_exceeds(root, limits.depth):
        raise LimitError("query depth")
    return Query(source, root)


def _depth_exceeds(node: Node, limit: int) -> bool:
    level = [node]
    for _ in range(limit):
        level = [c for n in level for c in n.children()]
        if not level:
            return False
    return True


def decode_query(data: bytes, limits: QueryLimits | None = None) -> Query:
    """The query in *data*, parsed anew; WireError if the envelope or a version is wrong."""
    if len(data) < _HEADER.size + _BODY.size:
        raise WireError("too short")
    magic, kind, version, features, size = _HEADER.unpack_from(data)
    if (magic, kind, version, features) != (MAGIC, KIND_QUERY, 1, 0) or size != len(data) - _HEADER.size:
        raise WireError("envelope")
    profile, syntax, reserved, length = _BODY.unpack_from(data, _HEADER.size)
    if profile != PROFILE or syntax != SYNTAX_VERSION or reserved or length != size - _BODY.size:
        raise WireError("profile, version or length")
    try:
        text = data[_HEADER.size + _BODY.size :].decode()
    except UnicodeDecodeError as e:
        raise WireError("utf-8") from e
    return parse_query(text, limits)


def query_valid(data: bytes | None) -> bool | None:
    if data is None:
        return None
    try:
        decode_query(bytes(data))
    except (WireError, LimitError, QuerySyntaxError):
        return False
    return True


def simplify(node: Node) -> Node:
    """Without double negations, repeated operands and operands that decide or change nothing."""
    if isinstance(node, Not):
        inner = simplify(node.child)
        return inner.child if isinstance(inner, Not) else Not(inner)
    if isinstance(node, And | Or):
        a, b = simplify(node.left), simplify(node.right)
        none, every = Nothing(), Not(Nothing())
        loses, wins = (every, none) if isinstance(node, And) else (none, every)
        if a == b or b == loses or a == wins:
            return a
        if a == loses or b == wins:
            return b
        return type(node)(a, b)
    if isinstance(node, Phrase) and len(node.terms) == 1:
        return Term(node.terms[0])
    return node


def scoring_leaves(node: Node, positive: bool = True) -> tuple[set[str], set[str]]:
    """(terms, prefixes) that stand under an even number of negations."""
    if isinstance(node, Term):
        return ({node.term}, set()) if positive else (set(), set())
    if isinstance(node, Phrase):
        return (set(node.terms), set()) if positive else (set(), set())
    if isinstance(node, Prefix):
        return (set(), {node.stem}) if positive else (set(), set())
    terms: set[str] = set()
    stems: set[str] = set()
    for c in node.children():
        t, s = scoring_leaves(c, positive != isinstance(node, Not))
        terms |= t
        stems |= s
    return terms, stems


@dataclass(frozen=True)
class Cover:
    """What candidates to read: nothing, every document, or those of some terms."""

    kind: str  # "empty", "universe", "terms"
    terms: tuple[str, ...] = ()


def cover_of(node: Node, df: Callable[[str], int] | None = None) -> Cover:
    """A superset of the matches; of two conjuncts the smaller cover is taken."""
    weight = df or (lambda _t: 1)
    if isinstance(node, Nothing):
        return Cover("empty")
    if isinstance(node, Term):
        return Cover("terms", (node.term,))
    if isinstance(node, Phrase):
        return Cover("terms", (min(node.terms, key=lambda t: (weight(t), t)),))
    if isinstance(node, And | Or):
        a, b = cover_of(node.left, df), cover_of(node.right, df)
        size = {"empty": lambda _c: -1, "terms": lambda c: sum(map(weight, c.terms)), "universe": lambda _c: float("inf")}
        if isinstance(node, And):
            return min(a, b, key=lambda c: size[c.kind](c))
        if "universe" in (a.kind, b.kind):
            return Cover("universe")
        both = tuple(sorted({*a.terms, *b.terms}))
        return Cover("terms", both) if both else Cover("empty")
    return Cover("universe")


def is_exact(node: Node) -> bool:
    """Whether posting sets alone decide the query: terms joined by AND and OR."""
    return all(isinstance(n, Term | And | Or | Nothing) for n in walk(node))
