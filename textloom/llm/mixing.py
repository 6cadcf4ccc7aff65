"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

The rows of a source, in the order of a digest of their ids, form blocks of
``block_rows``. Block j (from 1) of a source with weight w is released at
floor((j-1)/w) and due at ceil(j/w); earliest deadline first gives every block
a slot inside that window, so at any time a source has had less than one block
more or less than its share. Weights are rounded to multiples of 1/resolution;
the schedule then repeats every ``resolution`` slots, so only that many slots
are ever computed on the driver and broadcast, whatever the number of rows.

A source without a weight, and a null source, count as the class ``*``; with
``each_source`` every one of them is a class of its own, with an equal part of
that class's weight. Slots of a class that has run out stay empty; all rows are
kept. Ranks come from
counts of digest buckets (two levels of prefix sums), never from one task that
holds a whole source. Null ids sort by the digest of the empty string. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import fresh

REST = "*"
BLOCK_ROWS = 16
RESOLUTION = 1024
#: Sources that each_source schedules on the driver; more are refused, not pooled.
MOST_SOURCES = 1 << 14
#: Rows that a digest bucket has on average, over all sources.
BUCKET_ROWS = 1024


def quotas(weights: Mapping[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole shares of *resolution* by largest remainder, each at least 1."""
    if not weights or any(not math.isfinite(w) or w <= 0 for w in weights.values()):
        raise ValueError("weights must be finite and positive")
    if len(weights) > resolution:
        raise ValueError("resolution must be at least the number of classes")
    names = sorted(weights)
    total = sum(Fraction(weights[n]) for n in names)
    exact = {n: Fraction(weights[n]) * resolution / total for n in names}
    out = {n: max(1, math.floor(exact[n])) for n in names}
    short = resolution - sum(out.values())
    sign = 1 if short > 0 else -1
    nearest = [(sign * (out[n] - exact[n]), i) for i, n in enumerate(names)]
    heapq.heapify(nearest)
    while short:
        _, i = heapq.heappop(nearest)
        if sign > 0 or out[names[i]] > 1:
            out[names[i]] += sign
            short -= sign
            heapq.heappush(nearest, (sign * (out[names[i]] - exact[names[i]]), i))
    return out


def source_weights(docs: DataFrame, weights: Mapping[str, float], rest_weight: float, source_col: str = "source") -> tuple[dict[str, float], str]:
    """A weight for every source of *docs*, and the class name of the null source.

    The sources that *weights* lacks share *rest_weight* equally.
    """
    rows = docs.select(F.col(source_col).cast("string").alias("source")).distinct().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    found = {r.source for r in rows}
    none = REST
    while none in found or none in weights:
        none += REST
    rest = sorted((none if s is None else s) for s in found if s not in weights)
    return ({**weights, **{s: rest_weight / len(rest) for s in rest}} or {none: rest_weight}), none


def schedule(shares: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(class, j from 0, slot, release, deadline) for one period, by earliest deadline."""
    period = sum(shares.values())
    names = sorted(shares)
    waiting = [(0, i, 0) for i in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[names[i]]), i, j, release))
        due, i, j, release = heapq.heappop(ready)
        out.append((names[i], j, slot, release, due))
        if j + 1 < shares[names[i]]:
            heapq.heappush(waiting, ((j + 1) * period // shares[names[i]], i, j + 1))
    return out


def mix(docs: DataFrame, weights: Mapping[str, float], rest_weight: float = 1.0, block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION, id_col: str = "doc_id", source_col: str = "source", carry: list[str] | None = None, each_source: bool = False) -> DataFrame:
    """One row per input row: doc_id, source, class, block, row_in_block, slot, release, deadline.

    Ordering by (slot, row_in_block) is the mixed stream. *carry*: columns of
    the input handed on as the struct ``carried``. *each_source*: no source
    shares a class; the resolution grows to four slots for each class at least.
    """
    spark = docs.sparkSession
    if each_source:
        classes, none = source_weights(docs, weights, rest_weight, source_col)
        resolution = max(resolution, 4 * len(classes))
        shares = quotas(classes, resolution)
        label = F.coalesce(F.col(source_col).cast("string"), F.lit(none))
    else:
        shares = quotas({**weights, REST: rest_weight}, resolution)
        named = [n for n in shares if n != REST]
        label = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(REST))
    plan = spark.createDataFrame(schedule(shares), "class string, j long, at long, release_at long, due_at long")
    share = spark.createDataFrame(sorted(shares.items()), "class string, share long")
    n = docs.count()
    low = max(1, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16) / 2)) if n > BUCKET_ROWS else 1
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))

    def placed(*more):
        return docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            label.alias("class"),
            digest.alias("digest"),
            *more,
        ).withColumns({"upper": F.substring("digest", 1, low), "lower": F.substring("digest", low + 1, low)})

    sizes = placed().groupBy("class", "upper", "lower").agg(F.count(F.lit(1)).alias("n"))
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = sizes.withColumn("skip", F.coalesce(F.sum("n").over(before(["class", "upper"], "lower")), F.lit(0)))
    outer = (
        placed()
        .groupBy("class", "upper")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("class", "upper", F.coalesce(F.sum("n").over(before(["class"], "upper")), F.lit(0)).alias("skip_upper"))
    )
    starts = inner.join(outer, ["class", "upper"]).select("class", "upper", "lower", (F.col("skip") + F.col("skip_upper")).alias("start"))
    within = W.partitionBy("class", "upper", "lower").orderBy("digest", "doc_id", "source")
    payload = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    ranked = placed(*payload).withColumn("nth", F.row_number().over(within)).join(starts, ["class", "upper", "lower"])
    block = F.floor((F.col("start") + F.col("nth") - 1) / F.lit(block_rows)).cast("long")
    timed = ranked.withColumn("block", block).join(F.broadcast(share), "class")
    timed = timed.withColumns({"round": F.floor(F.col("block") / F.col("share")).cast("long"), "j": F.col("block") % F.col("share")})
    out = timed.join(F.broadcast(plan), ["class", "j"])
    shift = F.col("round") * F.lit(resolution)
    return out.select(
        "doc_id",
        "source",
        "class",
        "block",
        ((F.col("start") + F.col("nth") - 1) % F.lit(block_rows)).cast("long").alias("row_in_block"),
        (F.col("at") + shift).alias("slot"),
        (F.col("release_at") + shift).alias("release"),
        (F.col("due_at") + shift).alias("deadline"),
        *(["carried"] if carry else []),
    )


def mixed_stream(docs: DataFrame, weights: Mapping[str, float], **options) -> DataFrame:
    """*docs* with all its columns, dealt to files and sorted in the mixed order."""
    out = mix(docs, weights, carry=docs.columns, **options)
    return out.repartitionByRange("slot", "row_in_block").sortWithinPartitions("slot", "row_in_block").select("carried.*")


def with_positions(stream: DataFrame) -> DataFrame:
    """*stream*, read from the Parquet files of a written mixed_stream, with its order as ``position`` from 0.

    A reader packs files into partitions by size; the order is that of the part
    numbers in the files' names and of the rows inside a file. Only the files'
    row counts are collected.
    """
    file, row, first = fresh(stream, "file", "row", "first")
    rows = stream.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    sizes = rows.groupBy(file).count().collect()
    start, starts = 0, []
    for r in sorted(sizes, key=lambda r: (*(int(x) for x in re.match(r"part-(\d+)-.*?-c(\d+)\.", r[file]).groups()), r[file])):
        starts.append((r[file], start))
        start += r["count"]
    at = stream.sparkSession.createDataFrame(starts, f"`{file}` string, `{first}` long")
    return rows.join(F.broadcast(at), file).withColumn("position", F.col(first) + F.col(row)).select(*stream.columns, "position")
