"""From raw documents to token ids in five stages, each of which reads what the one before kept.

1. quality: documents that the classifier rejects go.
2. exact: of texts equal after white space is normalised, the smallest id stays.
3. near: of each component of near duplicates, the smallest id stays.
4. mix: documents are dealt in blocks by target weights; files are in stream order.
5. encode: one sampled segmentation of each document, as token ids, with the
   document's position in the stream.

Every stage but the last returns the columns of documents. A stage's result is
written as Parquet and read again by the next one; a table goes once the stage
after the next has been written, the last one with the driver's JVM.

Null and empty texts are scored like any other, are copies of each other, have
no near copies and encode to nothing. Very long texts are read whole in every
stage. Of rows repeated with id and text one stays; null ids and null sources
are kept (see the operators). Other columns pass through all stages but the
last, whatever their names. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, jaccard_join, lattice, mixing, quality
from textloom.llm.common import discard, materialise, read_table
from textloom.llm.queries import MODEL_FILE, REST_WEIGHT, WEIGHTS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, each_component=True)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_stream(docs, WEIGHTS, rest_weight=REST_WEIGHT, each_source=True)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice.encode_samples(mixing.with_positions(docs), MODEL_FILE, k=1, carry=["position"])


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding", encode_stage),
]

#: No SQL: a fitted classifier and seeded sampling; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last written to the shared scratch folder."""
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        out = materialise(stage(spark, docs, sf_dir), f"pipeline-{n}")
        if n:
            discard(spark, docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
