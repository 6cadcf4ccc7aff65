"""Queries as Spark Columns over token lists: exact for every node, null on null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.analysis import padded, tokens
from textloom.plans.query import And, Node, Not, Nothing, Or, Phrase, Prefix, Query, Term, parse_query, simplify


def as_query(query: str | Query) -> Query:
    return query if isinstance(query, Query) else parse_query(query)


def over_norm(node: Node, norm: Column) -> Column:
    """The predicate over tokens framed by spaces (see padded())."""
    if isinstance(node, Nothing):
        return F.when(norm.isNotNull(), F.lit(False))
    if isinstance(node, Term):
        return F.contains(norm, F.lit(f" {node.term} "))
    if isinstance(node, Prefix):
        return F.contains(norm, F.lit(f" {node.stem}"))
    if isinstance(node, Phrase):
        return F.contains(norm, F.lit(f" {' '.join(node.terms)} "))
    if isinstance(node, Not):
        return ~over_norm(node.child, norm)
    a, b = over_norm(node.left, norm), over_norm(node.right, norm)
    return a & b if isinstance(node, And) else a | b


def matches_tokens(found: Column, query: str | Query) -> Column:
    """Whether a token list matches."""
    return over_norm(simplify(as_query(query).root), padded(found))


def matches(text: Column | str, query: str | Query) -> Column:
    """Whether a text matches; null for a null text. Plain texts stay in built-in functions."""
    column = F.col(text) if isinstance(text, str) else text
    return matches_tokens(tokens(column), query)


def over_flags(node: Node, flag) -> Column:
    """The Boolean skeleton over Columns that *flag* gives for the leaves."""
    if isinstance(node, Nothing):
        return F.lit(False)
    if isinstance(node, Not):
        return ~over_flags(node.child, flag)
    if isinstance(node, And | Or):
        a, b = over_flags(node.left, flag), over_flags(node.right, flag)
        return a & b if isinstance(node, And) else a | b
    return flag(node)


def holds_without(node: Node) -> bool:
    """Whether a document without any of the query's terms matches."""
    if isinstance(node, Not):
        return not holds_without(node.child)
    if isinstance(node, And):
        return holds_without(node.left) and holds_without(node.right)
    if isinstance(node, Or):
        return holds_without(node.left) or holds_without(node.right)
    return False


def leaves(node: Node) -> list[Node]:
    """Distinct terms, prefixes and phrases, in order."""
    found = [node] if not node.children() else [x for c in node.children() for x in leaves(c)]
    return list(dict.fromkeys(x for x in found if not isinstance(x, Nothing)))


def text_matches(found: list[str], node: Node) -> bool:
    """The same predicate on a Python token list; used by the SQL function and as a test oracle."""
    if isinstance(node, Nothing):
        return False
    if isinstance(node, Term):
        return node.term in found
    if isinstance(node, Prefix):
        return any(t.startswith(node.stem) for t in found)
    if isinstance(node, Phrase):
        n = len(node.terms)
        return any(tuple(found[i : i + n]) == node.terms for i in range(len(found) - n + 1))
    if isinstance(node, Not):
        return not text_matches(found, node.child)
    return reduce(lambda a, b: a and b if isinstance(node, And) else a or b, (text_matches(found, c) for c in node.children()))
