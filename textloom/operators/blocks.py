"""Postings as blocks: a few postings of one term in a short binary, small to write and to shuffle.

A block has, as variable-length integers: its number n of postings, n steps of
doc_id (the first from the row's doc_id), n frequencies, and the steps of each
posting's positions. A worker groups a bounded number of tokens at once, so
no posting is alone in a row of the shuffle where its term is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of terms have a block; rows of documents have, in the same form, their lengths as frequencies.
BLOCKS = "term string, doc_id long, block binary, lengths binary"
#: Postings of a block at most, so that a range of blocks holds a bounded multiple of another's postings.
BLOCK = 32
#: Documents of a block of lengths.
LENGTHS = 1_024
#: Tokens that a worker groups at once, and bytes of blocks that it decodes at once.
CHUNK_TOKENS, CHUNK_BYTES = 1 << 21, 1 << 22


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of unsigned 64-bit values, seven bits each, and where each value begins and the last ends."""
    width = np.ones(len(values), np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        width += rest > 0
        rest >>= np.uint64(7)
    at = np.concatenate(([0], np.cumsum(width)))
    out, place = np.empty(at[-1], np.uint8), at[:-1]
    while len(values):
        more = values > 127
        out[place] = (values & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        place, values = place[more] + 1, values[more] >> np.uint64(7)
    return out, at


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, and the last byte of each."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
    if len(ends) == len(data):
        return data.astype(np.uint64), ends
    nth = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * nth).astype(np.uint64), starts), ends


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive groups of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def encode(codes: np.ndarray, ids: np.ndarray, tfs: np.ndarray, places: np.ndarray | None, most: int) -> tuple[np.ndarray, pa.Array]:
    """The first posting of each block, and the blocks, of postings in order of (code, id)."""
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    first = np.flatnonzero(_within(np.diff(np.append(starts, len(codes)))) % most == 0)
    n = np.diff(np.append(first, len(codes)))
    steps = np.diff(ids.view(np.uint64), prepend=ids.view(np.uint64)[:1])
    steps[first] = 0
    held = np.add.reduceat(tfs, first) if places is not None else np.zeros(len(first), np.int64)
    sizes = 1 + 2 * n + held
    at = np.cumsum(sizes) - sizes
    values = np.empty(sizes.sum(), np.uint64)
    values[at] = n
    where = np.repeat(at + 1, n) + _within(n)
    values[where] = steps
    values[where + np.repeat(n, n)] = tfs
    if places is not None:
        moves = np.diff(places, prepend=0)
        begin = np.cumsum(tfs) - tfs
        moves[begin] = places[begin]
        values[np.repeat(at + 1 + 2 * n, held) + _within(held)] = moves
    data, byte = varints(values)
    offsets = np.append(byte[at], byte[-1]).astype(np.int32)
    return first, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode(ids: np.ndarray, blocks: pa.Array, placed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(block number, doc_id, frequency) of each posting, and all positions if *placed*."""
    offsets = np.frombuffer(blocks.buffers()[1], np.int32)[blocks.offset : blocks.offset + len(blocks) + 1].astype(np.int64)
    values, ends = from_varints(np.frombuffer(blocks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    at = np.searchsorted(ends, offsets - offsets[0])
    at, stop = at[:-1], at[1:]
    n = values[at].astype(np.int64)
    block = np.repeat(np.arange(len(blocks)), n)
    where = at[block] + 1 + _within(n)
    total = np.cumsum(values[where])
    found = ids.view(np.uint64)[block] + total - total[(np.cumsum(n) - n)[block]]
    tfs = values[where + n[block]].astype(np.int64)
    places = None
    if placed:
        held = stop - at - 1 - 2 * n
        moves = values[np.repeat(at + 1 + 2 * n, held) + _within(held)].astype(np.int64)
        total, begin = np.cumsum(moves), np.cumsum(tfs) - tfs
        places = total - np.repeat(total[begin] - moves[begin], tfs)
    return block, found.view(np.int64), tfs, places


def _sizes(lists: pa.Array) -> np.ndarray:
    """Elements of each list or bytes of each binary; nulls have none."""
    sizes = pc.binary_length(lists) if pa.types.is_binary(lists.type) or pa.types.is_large_binary(lists.type) else pc.list_value_length(lists)
    return sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows with at most *most* elements of a column at once, or a single row."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        ends, at = np.cumsum(_sizes(batch.column(column))), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, base + most - size, "right"))
            if stop <= at and held:
                yield joined()
                held, size = [], 0
                continue
            stop = max(stop, at + 1)
            held.append(batch.slice(at, stop - at))
            size, at = size + int(ends[stop - 1] - base), stop
    if held:
        yield joined()


def _grouped(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms; code of the term, row and frequency of each posting; all positions) of token lists, by term and row."""
    sizes = _sizes(lists)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    codes, rows, places = codes[order], np.repeat(np.arange(len(sizes)), sizes)[order], _within(sizes)[order]
    first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1]))))[: len(codes)]
    return coded.dictionary, codes[first], rows[first], np.diff(np.append(first, len(codes))), places


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, 1, CHUNK_TOKENS):
        terms, codes, rows, tfs, places = _grouped(batch.column(1))
        if len(codes):
            columns = [batch.column(0).take(pa.array(rows)), terms.take(pa.array(codes)), pa.array(tfs.astype(np.int32)), _lists(tfs, places)]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "term", "tf", "positions"])


def vectors(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, term, tf, positions) of each row by itself, without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, tokens_col).mapInArrow(_vectors, f"`{id_col}` {kind}, term string, tf int, positions array<int>")


def _in_order(batch: pa.RecordBatch, column: int) -> tuple[pa.RecordBatch, np.ndarray]:
    ids = batch.column(column).to_numpy(zero_copy_only=False)
    if (ids[1:] < ids[:-1]).any():
        order = np.argsort(ids, kind="stable")
        return batch.take(pa.array(order)), ids[order]
    return batch, ids


def _rows(terms: pa.Array | None, ids: np.ndarray, blocks: pa.Array) -> pa.RecordBatch:
    nothing = pa.nulls(len(blocks), pa.binary())
    columns = [pa.nulls(len(blocks), pa.string()) if terms is None else terms, pa.array(ids)]
    return pa.RecordBatch.from_arrays([*columns, *((nothing, blocks) if terms is None else (blocks, nothing))], names=["term", "doc_id", "block", "lengths"])


def _from_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, 1, CHUNK_TOKENS):
        batch, ids = _in_order(batch, 0)
        first, blocks = encode(np.zeros(len(ids), np.int64), ids, _sizes(batch.column(1)), None, LENGTHS)
        yield _rows(None, ids[first], blocks)
        terms, codes, rows, tfs, places = _grouped(batch.column(1))
        if len(codes):
            first, blocks = encode(codes, ids[rows], tfs, places, BLOCK)
            yield _rows(terms.take(pa.array(codes[first])), ids[rows][first], blocks)


def _from_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, 2, CHUNK_TOKENS):
        coded, ids = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, codes))
        codes, ids, lists = codes[order], ids[order], batch.column(2).take(pa.array(order))
        first, blocks = encode(codes, ids, _sizes(lists), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), BLOCK)
        yield _rows(coded.dictionary.take(pa.array(codes[first])), ids[first], blocks)


def of_tokens(df: DataFrame) -> DataFrame:
    """Blocks of terms and of lengths of (doc_id, tokens); a row without an id is an error."""
    none = F.raise_error(F.lit("a document has no id"))
    known = F.when(F.col("doc_id").isNull(), none).otherwise(F.col("doc_id").cast("long"))
    return df.select(known.alias("doc_id"), "tokens").mapInArrow(_from_tokens, BLOCKS)


def of_postings(df: DataFrame) -> DataFrame:
    """Blocks of terms of (term, doc_id, positions)."""
    return df.select("term", F.col("doc_id").cast("long").alias("doc_id"), "positions").mapInArrow(_from_postings, BLOCKS)


def _to_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, 2, CHUNK_BYTES):
        block, ids, tfs, places = decode(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).cast(pa.binary()), True)
        columns = [batch.column(0).take(pa.array(block)), pa.array(ids), pa.array(tfs.astype(np.int32)), _lists(tfs, places)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tf", "positions"])


def _to_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, 1, CHUNK_BYTES):
        _, ids, dls, _ = decode(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary()), False)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(dls.astype(np.int32))], names=["doc_id", "dl"])


def sorted_postings(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) in ranges of terms, sorted by term; a frequent term spans ranges, a rare one is in one."""
    rows = blocks.where(F.col("term").isNotNull()).select("term", "doc_id", "block")
    return rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").mapInArrow(_to_postings, "term string, doc_id long, tf int, positions array<int>")


def lengths(blocks: DataFrame) -> DataFrame:
    """(doc_id, dl)."""
    return blocks.where(F.col("lengths").isNotNull()).select("doc_id", "lengths").mapInArrow(_to_lengths, "doc_id long, dl int")
