"""A streaming sink that appends each micro-batch as an index segment, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from textloom.functions.analysis import repeated
from textloom.operators.index import MERGE_SEGMENTS, Index


def append_stream(docs: DataFrame, index: Index, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", name: str = "documents", merge_at: int = MERGE_SEGMENTS) -> DataStreamWriter:
    """A writer to start(): replays of a batch do nothing, small segments are merged.

    A document that comes again replaces its older version; of rows of one batch
    with the same id the one of the greatest text is taken.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = batch.select(id_col, text_col)
        if not repeated(batch, id_col).isEmpty():
            once = batch.groupBy(id_col).agg(F.max(text_col).alias(text_col))
        index.append(once, id_col, text_col, batch=f"{name}:{number}")
        index.merge(at_least=merge_at)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
