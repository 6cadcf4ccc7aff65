"""Substring deduplication over a sparse de Bruijn graph of words.

Word k-mers are edges between their (k-1)-word ends; of all k-mers of a text
only the anchor of each 50-word window is kept (see ``repeats``), and an edge
is joined to the next one of its document by a hash of all words through both.
Edges that occur in two documents are found by a join on the k-mer; where all
occurrences of an edge go on to one and the same next edge the path does not
branch and is compacted, so the inside of a long repeat is settled without its
words. Where paths branch or end, the source coordinates bring the words around
the edge: every window through it, by its hash and its place around the edge, is
compared over all documents of the edge, and the smallest document with that
window decides. Equal contexts are collapsed to one row, with their smallest document,
before the shuffle.

Words are maximal runs without white space, unchanged; null and empty texts
have none. A window repeated inside one document only, or in rows that share
its id, removes nothing; a row without id neither loses nor removes words. An
empty table gives an empty result; other columns are not read. Words enter
comparisons by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import symbols as S
from textloom.llm.common import row_id, row_key, whole_text
from textloom.llm.repeats import CONTEXT, Spec, covered, spans_of, walk

WINDOW = 50
SPEC = Spec(WINDOW, 8, "word", across=True)
#: Contexts compared at once; a key's rows are never split between two calls.
AT_ONCE = 1 << 15


def first_documents(key: np.ndarray, low: np.ndarray, shared: np.ndarray, first: np.ndarray, windows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, before, after, document): the smallest document that holds each run of windows of a context.

    Row i has the windows that start first[i], first[i]-1, ... words before its
    edge; their hashes are windows[bounds[i]:bounds[i+1]]. *shared*: whether
    several documents have the very same context.
    """
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(key)), size)
    ahead = first[row] - (np.arange(len(windows)) - bounds[row])
    h = S.mix(windows ^ S.mix(key.view(S.U)[row] + ahead.astype(S.U)))
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(low[row][order], begins) if len(h) else low
    many = (np.bincount(group)[group] > 1) | shared[row][order]
    none = np.iinfo(np.int64).max
    best = np.full(len(h), none)
    best[order] = np.where(many, least[group], none)
    # runs of windows with the same document
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (best[1:] != best[:-1])))) if len(h) else begins
    tail = np.append(head[1:], len(h))[: len(head)] - 1
    head, tail = head[best[head] != none], tail[best[head] != none]
    return row[head], ahead[head], WINDOW - ahead[tail], best[head]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key -> (key, ctx, before, after, low)."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        key, ctx, low = (table.column(c).combine_chunks().to_numpy() for c in ("key", "ctx", "low"))
        shared = table.column("high").combine_chunks().to_numpy() > low
        data, offsets = S.texts_of(table.column("windows").combine_chunks())
        windows = data[offsets[0] : offsets[-1]].view(S.U)
        row, before, after, doc = first_documents(key, low, shared, table.column("first").combine_chunks().to_numpy(), windows, (offsets - offsets[0]) // 8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[row]), pa.array(ctx[row]), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(doc)],
            ["key", "ctx", "before", "after", "low"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < AT_ONCE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield from flush(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
    if held:
        yield from flush(pa.Table.from_batches(held))


def window_documents(walked: DataFrame) -> DataFrame:
    """(key, ctx, before, after, low) for the contexts at branches and ends of paths."""
    contexts = walked.where(F.col("kind") == CONTEXT).groupBy("key", "ctx", "first", "windows").agg(F.min(row_id()).alias("low"), F.max(row_id()).alias("high"))
    least = F.coalesce("low", F.lit(2**63 - 1)).alias("low")
    dealt = contexts.select("key", "ctx", least, F.coalesce("high", F.lit(-(2**63))).alias("high"), "first", "windows").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "key long, ctx long, before int, after int, low long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rhash, spans): word ranges of each document that start in a smaller document, too."""
    walked = walk(docs, SPEC, id_col, text_col)
    return spans_of(walked, window_documents(walked))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (text)."""
    spans = repeated_spans(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), whole_text(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, stop = covered(b.column(2))
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            total, gone, kept = [], [], []
            for i, t in enumerate(b.column(1)):
                words = (t.as_buffer().to_pybytes() if t.as_buffer() else b"").split()
                a, z = first[i], first[i + 1]
                total.append(len(words))
                gone.append(int((stop[a:z] - start[a:z]).sum()))
                cuts = [0, *np.column_stack((start[a:z], stop[a:z])).ravel().tolist(), len(words)]
                kept.append(b" ".join(w for j in range(0, len(cuts), 2) for w in words[cuts[j] : cuts[j + 1]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    joined = rows.join(spans, ["rid", "rhash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
