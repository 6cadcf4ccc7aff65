"""The query language: goldens, rejects, limits, wire form, simplification."""

import pytest

from textloom.functions.analysis import LimitError, analyze_text
from textloom.plans.predicate import holds_without, text_matches
from textloom.plans.query import (
    Cover, QueryLimits, QuerySyntaxError, WireError, cover_of, decode_query, is_exact, parse_query, query_valid, scoring_leaves, simplify,
)

# Analysis, match and reject goldens.
TOKENS = {
    "can't 32.3 a_b a:b a.b": ["can't", "32.3", "a_b", "a:b", "a.b"],
    "CAFÉ café": ["café", "café"],
    "Σ ς K": ["σ", "σ", "k"],
    "Straße STRASSE ẞ ß": ["straße", "strasse", "ß", "ß"],
    "日本": ["日", "本"],
    "foo-bar": ["foo", "bar"],
    "": [],
}
MATCHES = [
    ("a b", "a AND b", True), ("a a", '"a a"', True), ("a", '"a a"', False), ("a x a", '"a a"', False), ("a b a b a", '"b a b"', True),
    ("a b", '"b a"', False), ("alpha alpine", "alp*", True), ("alpha", "alpha* AND z*", False), ("", "NOT missing", True), ("", "", False),
    ("anything", '""', False), ("anything", 'NOT ""', True), ('a "b" \\ c', r'"a \"b\" \\ c"', True), ("and", "and", True),
    ("a c", "a OR b AND z", True), ("b", "NOT a AND b", True), ("foo bar", '"foo-bar"', True),
]
REJECTS = ["a b", "AND a", "a AND", "a NOT b", "()", "(a", "a)", "a(b)", '"a', "*", "a*b", "a**", "a\\b", '"a\\q"', "NOT", "a OR OR b", "foo-bar"]
WIRE_A = b"PIN1\x05\0\x01\0\0\0\0\0\x0d\0\0\0\x01\0\0\0\x01\0\0\0\x01\0\0\0a"


@pytest.mark.parametrize("text,want", TOKENS.items())
def test_analysis(text, want):
    assert analyze_text(text) == want


@pytest.mark.parametrize("text,query,want", MATCHES)
def test_match(text, query, want):
    root = parse_query(query).root
    assert text_matches(analyze_text(text), root) is want
    assert text_matches(analyze_text(text), simplify(root)) is want


@pytest.mark.parametrize("query", REJECTS)
def test_reject(query):
    with pytest.raises(QuerySyntaxError):
        parse_query(query)


def test_limits():
    cases = [
        ("abc", QueryLimits(bytes=2)), ("a AND b", QueryLimits(nodes=2)), ("((a))", QueryLimits(depth=1)), ("NOT NOT a", QueryLimits(depth=2)),
        ("a AND b", QueryLimits(terms=1)), ("abc", QueryLimits(term_bytes=2)),
    ]
    for query, limits in cases:
        with pytest.raises(LimitError):
            parse_query(query, limits)
        parse_query(query)


def test_wire():
    assert parse_query("a").encode() == WIRE_A
    for source in ["", "a OR NOT b", '"CAFÉ café"', "(a AND b) OR alp*"]:
        data = parse_query(source).encode()
        back = decode_query(data)
        assert (back.source, back.node_count) == (source, parse_query(source).node_count)
        for cut in range(len(data)):
            assert query_valid(data[:cut]) is False
        assert query_valid(data + b"x") is False
    for at, value in [(5, 1), (6, 2), (8, 1), (16, 2), (20, 2), (22, 1), (28, 255)]:
        broken = bytearray(WIRE_A)
        broken[at] = value
        with pytest.raises(WireError):
            decode_query(bytes(broken))
    assert query_valid(None) is None


def test_properties():
    q = parse_query('a AND "b c" OR NOT d*')
    assert (q.node_count, q.depth, q.term_count, q.is_single_term) == (6, 3, 4, False)
    assert parse_query("a").is_single_term and not parse_query('"a"').is_single_term
    assert scoring_leaves(parse_query('a AND NOT (b OR NOT c) AND "x y" AND al*').root) == ({"a", "c", "x", "y"}, {"al"})
    assert cover_of(parse_query("rare AND (x OR y)").root, {"rare": 1, "x": 9, "y": 9}.get) == Cover("terms", ("rare",))
    assert cover_of(parse_query("NOT a").root).kind == "universe" and cover_of(parse_query("").root).kind == "empty"
    assert is_exact(parse_query("a AND (b OR c)").root) and not is_exact(parse_query("NOT a").root)
    assert holds_without(parse_query("NOT a OR b").root) and not holds_without(parse_query("NOT a AND b").root)
