"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned between sampled splitters on their normalised text -
by its first LEAD characters, then by a hash of all of it, so that splitters
stay short for the driver. Each partition is sorted externally by that and by
the whole text, and neighbours with fully equal texts form a group whose
smallest id stays. A text with very many copies would fill one
range; such texts (by a map-side combined count) get a salt as a second sort
key, which spreads their copies over several ranges. At most ``HOT_LIST``
texts can be hot, so the list of them is broadcast.

Null and empty texts are equal to each other. A null id sorts last: it stays
only in a group without any other id. Of rows with the same id and text one
stays. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import SPACE_CLASS, whole_text

#: A text is hot when it has over 1/HOT_LIST of all rows (and HOT_LEAST copies).
HOT_LIST = 2048
HOT_LEAST = 64
#: Characters of a text that its splitters hold.
LEAD = 24


def normalised(text_col: str = "text"):
    return F.regexp_replace(whole_text(text_col), SPACE_CLASS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    *carry*: columns of the input handed on as the struct ``carried``.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        normalised(text_col).alias("norm"),
        F.struct(*[F.col(c) for c in carry or [id_col]]).alias("carried"),
    ).withColumn("text_sha256", F.sha2("norm", 256))
    if not carry:
        rows = rows.drop("carried")
    limit = max(HOT_LEAST, docs.count() // HOT_LIST)
    hot = (
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("hot_size"), F.min("doc_id").alias("hot_keep"))
        .where(F.col("hot_size") > limit)
    )
    salt = F.when(F.col("hot_size").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("hot_size") / F.lit(limit)).cast("long"))
    )
    placed = rows.join(F.broadcast(hot), "text_sha256", "left").withColumn("salt", salt)
    placed = placed.withColumns({"lead": F.substring("norm", 1, LEAD), "whole": F.xxhash64("norm")})
    run = W.partitionBy("lead", "whole", "salt", "norm")
    nearest = run.orderBy(F.col("doc_id").asc_nulls_last())
    runs = placed.repartitionByRange("lead", "whole", "salt").select(
        "*",
        F.row_number().over(nearest).alias("nth"),
        F.first("doc_id").over(nearest).alias("run_keep"),
        F.count(F.lit(1)).over(run).alias("run_size"),
    )
    keep = F.when(F.col("hot_size").isNull(), F.col("run_keep")).otherwise(F.col("hot_keep"))
    return runs.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
        *(["carried"] if carry else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """*docs* without the rows that are copies, with all columns it had."""
    out = exact_dedup(docs, id_col, text_col, carry=docs.columns)
    return out.where("kept").select("carried.*")
