"""Exact top-k inner product search with block-at-a-time pruning.

Candidates in the order of their ids form blocks of ``block_rows``; a block
keeps its forward index (the vectors) and, per component and sign, the largest
weight in it. For a query the blocks of a task are ordered by the sum of these
maxima over its components, the upper bound of any score inside. Blocks are
scored through the forward index from the best bound on, and a query stops once
the next bound is below its k-th score (an equal bound goes on, as ties go to
the smaller id).

How many blocks are scored depends on the data: where block maxima say little,
as for directions spread evenly in many dimensions, all are.

The stated queries meet all rows in tasks of ``group_rows`` candidates times
``chunk_rows`` queries; each task keeps k rows a query, and the best k of these
are the result. Nothing is broadcast and no task grows with the table.

Components become floor(64 * x). Vectors that are null, empty, or hold null or
non-finite components take no part, nor do rows without id. Rows that share an
id count once, by their smallest vector. Vectors of another length than the
query's score over the components both have (missing ones are 0). Scores are
exact; one beyond 64 bits is given as the nearest 64-bit integer. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 256
GROUP_ROWS = 8192
CHUNK_ROWS = 1024
TOP = 20
EVERY = 20
#: Rows that a task collects before it keeps the best of each query.
MERGE_ROWS = 1 << 17
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): one row per id that takes part."""
    x = F.col("x")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & good)
    return kept.select("vec_id", F.transform(x, lambda e: F.floor(e * 64)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """(name, ids, dims, values): about *size* rows of neighbouring ids in each row."""
    parts = max(1, math.ceil(n / size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(2)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(0, 1), pa.array([b.column(1).to_numpy().tobytes()], pa.binary()), pa.array([np.asarray(v.value_lengths()).astype(np.int32).tobytes()], pa.binary()), pa.array([np.asarray(v.flatten()).tobytes()], pa.binary())],
                    [name, "ids", "dims", "values"],
                )

    placed = rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").select((F.spark_partition_id() % parts).alias(name), "vec_id", "v")
    return placed.mapInArrow(run, f"{name} int, ids binary, dims binary, values binary")


def unpacked(ids: bytes, dims: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    i, d, v = np.frombuffer(ids, np.int64), np.frombuffer(dims, np.int32), np.frombuffer(values, np.int64)
    width = int(d.max())
    if (d == width).all():
        return i, v.reshape(len(i), width)
    out = np.zeros((len(i), width), np.int64)
    out[np.arange(width) < d[:, None]] = v
    return i, out


def search_blocks(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, top: int = TOP, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, id, score) of each query's best *top* other ids, and the number of block scores computed."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    big = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width
    kind = np.float64 if big < 2**53 else object if big >= 2**62 else np.int64
    q, v = q.astype(kind), v.astype(kind)
    starts = np.arange(0, len(ids), block_rows)
    high, low = np.maximum.reduceat(v, starts), np.minimum.reduceat(v, starts)
    bounds = np.where(q > 0, q, 0) @ high.T + np.where(q < 0, q, 0) @ low.T
    order = np.argsort(-bounds.astype(np.float64), axis=1, kind="stable") if kind is not object else np.array([sorted(range(len(starts)), key=lambda j: -b[j]) for b in bounds])
    n = len(q)
    none_id = np.iinfo(np.int64).max
    best_s = np.full((n, top), -np.inf if kind is np.float64 else -(1 << 63) if kind is np.int64 else -(1 << 200), dtype=kind)
    best_i = np.full((n, top), none_id)
    live, done = np.arange(n), 0
    for step in range(len(starts)):
        block = order[live, step]
        full = best_i[live, top - 1] != none_id
        go = ~(full & (bounds[live, block] < best_s[live, top - 1]))
        live, block = live[go], block[go]
        if not len(live):
            break
        for j in np.unique(block):
            who = live[block == j]
            a = starts[j]
            here = ids[a : a + block_rows]
            s = q[who] @ v[a : a + block_rows].T
            done += len(who)
            # a query whose k-th score is above all of the block's keeps its list
            hit = (s >= best_s[who, top - 1][:, None]).any(axis=1) | (best_i[who, top - 1] == none_id)
            who, s = who[hit], s[hit]
            if not len(who):
                continue
            i = np.broadcast_to(here, s.shape)
            own = i == q_ids[who][:, None]
            s = np.where(own, best_s.dtype.type(0) if kind is not object else 0, s)
            all_s = np.concatenate((best_s[who], s), axis=1)
            all_i = np.concatenate((best_i[who], np.where(own, none_id, i)), axis=1)
            if kind is object:
                for row, w in enumerate(who):
                    ranked = sorted((x for x in zip(all_s[row], all_i[row]) if x[1] != none_id), key=lambda x: (-x[0], x[1]))[:top]
                    for c, (x, y) in enumerate(ranked):
                        best_s[w, c], best_i[w, c] = x, y
                continue
            absent = all_i == none_id
            rank = np.lexsort((all_i, -all_s, absent), axis=1)[:, :top]
            best_s[who], best_i[who] = np.take_along_axis(all_s, rank, 1), np.take_along_axis(all_i, rank, 1)
    row, col = np.nonzero(best_i != none_id)
    return row, best_i[row, col], best_s[row, col], done


def longs(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those out of range become the nearest one."""
    if scores.dtype == object:
        scores = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64)
    return scores.astype(np.int64)


def best_of(rows: np.ndarray, top: int) -> np.ndarray:
    """The best *top* (query, id, score) rows of each query."""
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
    begins = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))) if len(rows) else np.zeros(0, np.int64)
    nth = np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows))))
    return rows[nth < top]


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by *every*."""
    rows = integer_vectors(vectors, id_col, vector_col)
    n = rows.count()
    ask = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    groups, chunks = max(1, math.ceil(n / GROUP_ROWS)), max(1, math.ceil(n / every / CHUNK_ROWS))
    blocks = packed(rows, n, GROUP_ROWS, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = packed(ask, n // every, CHUNK_ROWS, "chunk").select("chunk", F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("values").alias("q_values"))
    meet = blocks.join(asked.hint("shuffle_hash"), "chunk").repartition(groups * chunks, "part", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 3), np.int64)
        new: list[np.ndarray] = []
        for b in batches:
            for x in b.to_pylist():
                q_ids, q = unpacked(x["q_ids"], x["q_dims"], x["q_values"])
                ids, v = unpacked(x["ids"], x["dims"], x["values"])
                row, i, s, _ = search_blocks(q_ids, q, ids, v, top)
                new.append(np.column_stack((q_ids[row], i, longs(s))))
                if sum(map(len, new)) > MERGE_ROWS + len(kept):
                    kept, new = best_of(np.concatenate((kept, *new)), top), []
        kept = best_of(np.concatenate((kept, *new)), top)
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, c].copy()) for c in range(3)], ["query_id", "vec_id", "score"])

    found = meet.select("q_ids", "q_dims", "q_values", "ids", "dims", "values").mapInArrow(run, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
