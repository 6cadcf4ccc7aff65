"""Posting tables and the set algebra over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.analysis import LimitError, term_vectors, with_tokens
from textloom.plans.predicate import holds_without, leaves, over_flags
from textloom.plans.query import Node, Nothing, Phrase, Prefix, Term

#: Terms that one prefix may stand for; more is an error.
PREFIX_TERMS = 4_096


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings(term, doc_id, tf, positions), docs(doc_id, dl)); null texts are in neither."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    analyzed = with_tokens(read).select("doc_id", "tokens")
    return term_vectors(analyzed), analyzed.select("doc_id", F.size("tokens").alias("dl"))


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, total_length, average_length (1.0 if there are no tokens)."""
    total = F.coalesce(F.sum("dl"), F.lit(0)).cast("long")
    average = F.when(total > 0, total / F.count(F.lit(1))).otherwise(F.lit(1.0))
    return docs.agg(F.count(F.lit(1)).alias("documents"), total.alias("total_length"), average.alias("average_length"))


def of_term(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term).select("doc_id").distinct()


def expand_prefix(words: DataFrame, stem: str, limit: int = PREFIX_TERMS) -> list[str]:
    """The dictionary's terms that begin with *stem*, in order; LimitError beyond *limit*."""
    found = [r.term for r in words.where(F.startswith("term", F.lit(stem))).select("term").orderBy("term").limit(limit + 1).collect()]
    if len(found) > limit:
        raise LimitError("prefix terms")
    return found


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents in both sets."""
    return a.join(b, "doc_id", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of *a* that are not in *b*."""
    return a.join(b, "doc_id", "left_anti")


def complement(docs: DataFrame, a: DataFrame) -> DataFrame:
    """Documents of the universe (empty ones too) that are not in *a*."""
    return docs.select("doc_id").join(a, "doc_id", "left_anti")


def phrase_by_join(postings: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Documents with the terms at consecutive positions, by a join on (document, first position)."""
    sides = [
        postings.where(F.col("term") == t).select("doc_id", F.explode("positions").alias("p")).select("doc_id", (F.col("p") - i).alias("start"))
        for i, t in enumerate(terms)
    ]
    return reduce(lambda a, b: a.join(b, ["doc_id", "start"], "left_semi"), sides).select("doc_id").distinct()


def leaf_rows(root: Node) -> Column:
    """Which postings a query reads; equality and prefix tests reach the Parquet scan."""
    words = {t for x in leaves(root) for t in (x.terms if isinstance(x, Phrase) else (x.term,) if isinstance(x, Term) else ())}
    tests = [F.col("term").isin(sorted(words))] if words else []
    tests += [F.startswith("term", F.lit(x.stem)) for x in leaves(root) if isinstance(x, Prefix)]
    return reduce(lambda a, b: a | b, tests)


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _held(leaf: Node) -> Column:
    """Aggregate over a document's postings: whether a leaf matches it."""
    if isinstance(leaf, Term):
        return F.coalesce(F.bool_or(F.col("term") == leaf.term), F.lit(False))
    if isinstance(leaf, Prefix):
        return F.coalesce(F.bool_or(F.startswith("term", F.lit(leaf.stem))), F.lit(False))
    shifted = []
    for i, t in enumerate(leaf.terms):
        at = F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), F.array().cast("array<int>"))
        shifted.append(_moved(at, i) if i else at)
    return F.size(reduce(F.array_intersect, shifted)) > 0


def search(postings: DataFrame, docs: DataFrame, root: Node) -> DataFrame:
    """doc_id of the matches: one scan of the leaves' postings and one shuffle by document.

    The universe is only read if a document without any of the terms matches.
    """
    if isinstance(root, Nothing) or not leaves(root):
        return docs.select("doc_id").where(F.lit(holds_without(root)))
    return matched(postings.where(leaf_rows(root)), docs.select("doc_id"), root).select("doc_id")


def matched(rows: DataFrame, docs: DataFrame, root: Node, more: list[Column] | None = None) -> DataFrame:
    """The documents that match, by the postings *rows* of the query's leaves.

    With *more* aggregates over these rows, each with the columns of *docs*.
    """
    names = {leaf: f"leaf{i}" for i, leaf in enumerate(leaves(root))}
    flags = rows.groupBy("doc_id").agg(*[_held(leaf).alias(n) for leaf, n in names.items()], *(more or []))
    if holds_without(root):
        flags = docs.join(flags, "doc_id", "left").na.fill(False, list(names.values()))
    elif more:
        flags = flags.join(docs, "doc_id")
    return flags.where(over_flags(root, lambda leaf: F.col(names[leaf]))).drop(*names.values())


def candidates(postings: DataFrame, docs: DataFrame, kind: str, terms: tuple[str, ...]) -> DataFrame:
    """Documents of a cover (see plans.query.cover_of)."""
    if kind == "universe":
        return docs.select("doc_id")
    rows = postings.where(F.col("term").isin(list(terms)) if terms and kind == "terms" else F.lit(False))
    return rows.select("doc_id").distinct()
