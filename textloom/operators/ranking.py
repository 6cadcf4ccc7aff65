"""BM25 top-k over postings, with corpus statistics that may be supplied."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.postings import PREFIX_TERMS, corpus_stats, dictionary, expand_prefix, leaf_rows, matched, search
from textloom.plans.predicate import as_query
from textloom.plans.query import Query, scoring_leaves, simplify


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if not (math.isfinite(self.k1) and self.k1 > 0 and math.isfinite(self.b) and 0 <= self.b <= 1):
            raise ValueError("k1 must be finite and positive, b between 0 and 1")


@dataclass(frozen=True)
class Statistics:
    """A snapshot that scores refer to: documents, total length, document frequencies."""

    documents: int
    total_length: int
    frequencies: Mapping[str, int]

    def __post_init__(self) -> None:
        df = self.frequencies.values()
        if self.documents < 0 or self.total_length < 0 or any(n < 0 or n > self.documents for n in df) or sum(df) > self.total_length:
            raise ValueError("statistics are not coherent")

    @property
    def average_length(self) -> float:
        return self.total_length / self.documents if self.documents and self.total_length else 1.0


def idf(documents: int, df: int, boost: float = 1.0) -> float:
    if not (math.isfinite(boost) and boost >= 0):
        raise ValueError("boost must be finite and not negative")
    return math.log1p((documents - df + 0.5) / (df + 0.5)) * boost


def term_score(tf: Column, dl: Column, weight: Column, average: float, p: Bm25) -> Column:
    """Score of one term in one document; a frequency above the length is an error."""
    score = weight * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * dl / average))
    return F.when(tf > dl, F.raise_error(F.lit("statistics: tf exceeds length"))).when(tf == 0, 0.0).otherwise(score)


def gather_statistics(words: DataFrame, docs: DataFrame, terms: list[str]) -> Statistics:
    """Statistics of the whole corpus for the given terms, from a dictionary (term, df, ...): two small aggregates."""
    stats = corpus_stats(docs).first()
    found = words.where(F.col("term").isin(terms)).select("term", "df").collect() if terms else []
    return Statistics(stats.documents, stats.total_length, {r.term: r.df for r in found})


def rank(
    postings: DataFrame,
    docs: DataFrame,
    query: str | Query,
    limit: int = 10,
    offset: int = 0,
    eligible: DataFrame | None = None,
    parameters: Bm25 | None = None,
    statistics: Statistics | None = None,
    boosts: Mapping[str, float] | None = None,
    words: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, score) of the best matches: score descending, then doc_id.

    One scan of the postings of the query's leaves and one shuffle by document
    give both the matches and their scores. *eligible* (doc_id) filters before
    the cut; statistics stay those of the whole corpus. Matches without a
    scoring term have score 0. *words* is the dictionary (term, df) where one is
    stored; it gives frequencies and the terms of prefixes without the postings.
    """
    p = parameters or Bm25()
    root = simplify(as_query(query).root)
    words = dictionary(postings) if words is None else words
    terms, stems = scoring_leaves(root)
    for stem in sorted(stems):
        terms |= set(expand_prefix(words, stem, PREFIX_TERMS))
    wanted = sorted(terms)
    stats = statistics or gather_statistics(words, docs, wanted)
    # at most the query's terms and PREFIX_TERMS for each prefix
    weights = [(t, idf(stats.documents, stats.frequencies.get(t, 0), (boosts or {}).get(t, 1.0))) for t in wanted]
    if not weights:
        found = search(postings, docs, root).withColumn("score", F.lit(0.0))
    else:
        weight = F.broadcast(postings.sparkSession.createDataFrame(weights, "term string, weight double"))
        part = F.when(F.col("weight").isNotNull(), F.struct("term", "tf", "weight"))
        rows = postings.where(leaf_rows(root)).join(weight, "term", "left")
        held = matched(rows, docs.select("doc_id", "dl"), root, [F.array_sort(F.collect_list(part)).alias("parts")])
        # summed in the order of the terms, so that the result does not depend on partitions
        add = lambda a, x: a + term_score(x.tf, F.col("dl"), x.weight, stats.average_length, p)
        score = F.coalesce(F.aggregate("parts", F.lit(0.0), add), F.lit(0.0))
        found = held.select("doc_id", score.alias("score"))
    if eligible is not None:
        found = found.join(eligible.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
