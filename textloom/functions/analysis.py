"""Text analysis: NFC, simple case folding, NFC, UAX #29 words.

Two paths give the same tokens. Texts of ASCII and Latin-1 letters (without the
micro sign) are analysed by built-in functions: lower-casing equals simple
folding there, such text is in NFC, and the word rules reduce to one regular
expression. Other texts go through an Arrow UDF, which gets nulls for plain
texts; one scan serves both. The limits hold on every path: a breach is an error.

A null text has null tokens; an empty text has an empty list.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word with mid-letter and mid-number marks and joining underscores.
WORD = r"_*(?:(?:\p{L}+(?:[:.'’·]\p{L}+)*|\p{Nd}+(?:[,;.'’]\p{Nd}+)*)_*)+"
#: Texts that the built-in path handles.
PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"


@dataclass(frozen=True)
class AnalysisLimits:
    """Limits whose breach is an error, never a truncation."""

    document_bytes: int = 1 << 20
    normalized_bytes: int = 2 << 20
    tokens: int = 262_144
    term_bytes: int = 1_024


LIMITS = AnalysisLimits()

#: Folds that neither casefold() nor lower() of one character gives.
_FOLD_MORE = {0xFB05: 0xFB06}


def fold_char(c: str) -> str:
    """Simple (one to one) default case folding of a character."""
    if ord(c) in _FOLD_MORE:
        return chr(_FOLD_MORE[ord(c)])
    folded = c.casefold()
    if len(folded) == 1:
        return folded
    lower = c.lower()
    return lower if len(lower) == 1 else c


def normalize_text(text: str) -> str:
    nfc = unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", "".join(map(fold_char, nfc)))


def words_of(text: str) -> list[str]:
    """Segments between word boundaries that hold an alphabetic or numeric character."""
    import regex

    return [w for w in regex.split(r"(?V1w)\b", text) if regex.search(r"[\p{Alphabetic}\p{N}]", w)]


class LimitError(ValueError):
    """A limit of analysis or of a query was exceeded."""


def analyze_text(text: str, limits: AnalysisLimits = LIMITS) -> list[str]:
    """Tokens of one text, on the driver or inside a UDF."""
    if len(text.encode()) > limits.document_bytes:
        raise LimitError("document bytes")
    norm = normalize_text(text)
    if len(norm.encode()) > limits.normalized_bytes:
        raise LimitError("normalized bytes")
    tokens = words_of(norm)
    if len(tokens) > limits.tokens:
        raise LimitError("document tokens")
    if any(len(t.encode()) > limits.term_bytes for t in tokens):
        raise LimitError("term bytes")
    return tokens


def is_plain(text: Column) -> Column:
    """Whether the built-in path handles a text."""
    return F.regexp_like(text, F.lit(PLAIN))


def plain_tokens(text: Column) -> Column:
    """Tokens by built-in functions; right where is_plain() holds."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


@lru_cache(maxsize=1)
def _general_udf():
    """One object, so that an expression that occurs twice in a plan is evaluated once."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def general(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else analyze_text(t))

    return general


def check_document(text: Column, limits: AnalysisLimits = LIMITS) -> Column:
    """The text, or an error if it has too many bytes."""
    return F.when(F.octet_length(text) > limits.document_bytes, F.raise_error(F.lit("limit: document bytes"))).otherwise(text)


def check_tokens(found: Column, limits: AnalysisLimits = LIMITS) -> Column:
    def check(words: Column) -> Column:
        long = F.exists(words, lambda t: F.octet_length(t) > limits.term_bytes)
        return (
            F.when(F.size(words) > limits.tokens, F.raise_error(F.lit("limit: document tokens")))
            .when(long, F.raise_error(F.lit("limit: term bytes")))
            .otherwise(words)
        )

    # a lambda's argument is evaluated once, an expression at each place it stands
    return F.transform(F.array(found), check)[0]


def tokens(text: Column, checked: bool = True) -> Column:
    """Tokens of any text as one expression, within the limits if *checked*."""
    plain = is_plain(text)
    source = check_document(text) if checked else text
    found = F.when(plain, plain_tokens(source)).otherwise(_general_udf()(F.when(~plain, source)))
    return check_tokens(found) if checked else found


def with_tokens(df: DataFrame, text_col: str = "text", out: str = "tokens", checked: bool = True) -> DataFrame:
    """*df* with a token list in the new column *out*."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {out} already")
    return df.withColumn(out, tokens(F.col(text_col), checked))


def padded(found: Column) -> Column:
    """Tokens joined and framed by spaces, for containment tests."""
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def term_vectors(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(id, term, tf, positions): positions from 0, sorted. Rows that repeat an id count as one document.

    Each row gives its own vectors; only rows of repeated ids, which a job over the ids finds, are shuffled.
    """
    from textloom.operators.blocks import vectors

    again = repeated(df, id_col)
    if again.isEmpty():
        return vectors(df, id_col, tokens_col)
    again = again.withColumnRenamed(id_col, "again_id")
    same = F.col(id_col).eqNullSafe(F.col("again_id"))
    flat = df.join(again, same, "left_semi").select(id_col, F.posexplode(tokens_col).alias("pos", "term"))
    met = flat.groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return vectors(df.join(again, same, "left_anti"), id_col, tokens_col).unionByName(met)


def repeated(df: DataFrame, id_col: str) -> DataFrame:
    """Ids (null too) of more than one row."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(id_col)


def invalid_vectors(vectors: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents whose vectors are not coherent: lengths, order or distinct positions."""
    sums = vectors.groupBy(id_col).agg(
        F.sum("tf").alias("total"),
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("places"),
        F.max(F.array_max("positions")).alias("last"),
        F.bool_and(F.size("positions") == F.col("tf")).alias("sized"),
    )
    met = docs.join(sums, id_col, "left")
    good = (F.coalesce("total", F.lit(0)) == F.col("dl")) & (F.coalesce("places", F.lit(0)) == F.col("dl")) & (F.coalesce("last", F.lit(-1)) < F.col("dl")) & F.coalesce("sized", F.lit(True))
    return met.where(~good).select(id_col)
