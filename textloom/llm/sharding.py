"""Sharding through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size
(start and step from a digest of its name). The shards take turns, in
proportion to their weights, and claim their next free slot until none is
left. A document's key digest picks a slot and hence its shard. The table has
``table_size`` entries whatever the data's size, so it is broadcast.

Null ids share the key of the empty string. Repeated ids go to the same shard.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh

TABLE_SIZE = 65_537
MAX_TABLE = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], table_size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """Slot -> index of the shard that claimed it.

    A shard of weight w takes w turns in a round. Removing a shard moves few
    slots of the others.
    """
    if not is_prime(table_size) or table_size > MAX_TABLE:
        raise ValueError(f"table_size must be a prime up to {MAX_TABLE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > table_size:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    turns = list(weights) if weights is not None else [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("weights must be positive integers, one for each shard")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % table_size for d in digests]
    step = [int.from_bytes(d[8:], "big") % (table_size - 1) + 1 for d in digests]
    table = [-1] * table_size
    left = table_size
    while left:
        for i, n in enumerate(turns):
            for _ in range(n):
                if not left:
                    break
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % table_size
                table[at[i]] = i
                left -= 1
    return table


def slot_of(key: Column, table_size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(table_size)).cast("int")


def assign_shards(docs: DataFrame, shards: Sequence[str], table_size: int = TABLE_SIZE, weights: Sequence[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, slot, shard (its index in *shards*). No shuffle."""
    table = fill_table(shards, table_size, weights)
    lookup = docs.sparkSession.createDataFrame(list(enumerate(table)), "slot int, shard int")
    rows = docs.select(F.col(id_col).alias("doc_id"), slot_of(F.col(id_col), table_size).alias("slot"))
    return rows.join(F.broadcast(lookup), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], table_size: int = TABLE_SIZE, id_col: str = "doc_id", files_per_shard: int = 4) -> None:
    """Parquet folders ``shard=<n>`` of whole rows; each shard is dealt to several writers.

    Where *docs* has a column ``shard`` it stays, and the folders are ``_shard=<n>``.
    """
    slot, part = fresh(docs, "slot", "part")
    shard = fresh(docs, "shard")[0] if "shard" in (c.lower() for c in docs.columns) else "shard"
    table = docs.sparkSession.createDataFrame(list(enumerate(fill_table(shards, table_size))), f"`{slot}` int, `{shard}` int")
    keyed = docs.withColumn(slot, slot_of(F.col(id_col), table_size))
    placed = keyed.join(F.broadcast(table), slot).withColumn(part, F.pmod(slot, F.lit(files_per_shard)))
    placed.repartition(shard, part).drop(slot, part).write.partitionBy(shard).parquet(path)
