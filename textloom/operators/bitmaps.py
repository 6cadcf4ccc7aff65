"""Posting sets as bitmaps of 32,768 documents, for Boolean counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_bitmaps(postings: DataFrame) -> DataFrame:
    """(term, bucket, bits); any 64-bit id has a bucket and a bit of its own."""
    bits = F.expr("bitmap_construct_agg(bitmap_bit_position(doc_id))").alias("bits")
    return postings.groupBy("term", F.expr("bitmap_bucket_number(doc_id)").alias("bucket")).agg(bits)


def count_all_of(bitmaps: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents with all the terms. A bucket must have every term's bitmap."""
    rows = bitmaps.where(F.col("term").isin(terms)).groupBy("bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.countDistinct("term").alias("n"))
    kept = rows.where(F.col("n") == len(set(terms)))
    return kept.agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("n"))


def count_any_of(bitmaps: DataFrame, terms: list[str]) -> DataFrame:
    rows = bitmaps.where(F.col("term").isin(terms)).groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    return rows.agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("n"))


def count_without(bitmaps: DataFrame, left: str, right: str) -> DataFrame:
    """Documents with *left* and not *right*: |left| - |left and right|."""
    only = bitmaps.where(F.col("term") == left).agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("a"))
    met = count_all_of(bitmaps, [left, right]).withColumnRenamed("n", "b")
    return only.crossJoin(met).select((F.col("a") - F.col("b")).alias("n"))  # one row each
