"""SQL functions: search_match, tokenize, parse_query, query_valid, version, tokenize_table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import VERSION
from textloom.functions.analysis import analyze_text
from textloom.plans.predicate import text_matches
from textloom.plans.query import parse_query, query_valid


@lru_cache(maxsize=256)
def _parsed(source: str):
    return parse_query(source)


def _match_udf():
    @F.pandas_udf(T.BooleanType())
    def search_match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, query in batches:
            yield pd.Series([None if t is None or q is None else text_matches(analyze_text(t), _parsed(q).root) for t, q in zip(text, query, strict=True)], dtype=object)

    return search_match


def register(spark: SparkSession) -> None:
    """Register the functions in a session.

    search_match takes any query per row; for one query over a table the Column
    function plans.predicate.matches() stays in built-in functions.
    """
    spark.udf.register("search_match", _match_udf())
    spark.udf.register("tokenize", F.pandas_udf(lambda s: s.map(lambda t: None if t is None else analyze_text(t)), T.ArrayType(T.StringType())))
    spark.udf.register("parse_query", F.pandas_udf(lambda s: s.map(lambda q: None if q is None else parse_query(q).encode()), T.BinaryType()))
    spark.udf.register("query_valid", F.pandas_udf(lambda s: s.map(query_valid).astype(object), T.BooleanType()))

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION textloom_version() RETURNS STRING RETURN '{VERSION}'")

    @F.udtf(returnType="pos: int, term: string")
    class TokenizeTable:
        def eval(self, text: str):
            if text is not None:
                yield from enumerate(analyze_text(text))

    spark.udtf.register("tokenize_table", TokenizeTable)
