"""Suffix-array deduplication: all repeats of at least ``window`` bytes.

A sparse enhanced suffix array holds the right contexts of the anchors (see
``repeats``): rows are dealt by anchor key and sorted by context, which is the
suffix order among suffixes that begin with the same anchor. A stack scan of
the common-prefix lengths yields the interval tree. At every interval the left
contexts are tested for diversity: the intervals of their own common lengths
give the maximal repeat groups (left length + right length >= window) with all
their places, not only neighbouring ones. Equal contexts are collapsed to one
row with a count before the shuffle, so a passage or text that very many
documents share is one suffix.

Texts are whole UTF-8 byte strings; null and empty ones have no repeats.
Matches do not cross documents; overlaps and repeats inside one document count,
and strings are judged on the input. Rows that repeat an id and a text are
places of their own. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import row_id, row_key, whole_text
from textloom.llm.repeats import CONTEXT, Spec, covered, spans_of, walk

WINDOW = 200
SPEC = Spec(WINDOW, 32, "byte", across=False)
#: For whole groups every context is compared.
GROUPS = replace(SPEC, compact=False)
#: Groups of more distinct contexts than this are swept by split lengths instead.
MOST_SCANNED = 4096


def common(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the rows of two padded matrices, up to *least*."""
    same = a == b
    stop = np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))
    return np.minimum(stop, least)


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    at = offsets[:-1, None] + np.arange(width)
    out = np.append(data, np.uint8(0))[np.minimum(at, len(data))]
    return out * (np.arange(width) < lengths[:, None]), lengths


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals; lcp[i] is between i-1 and i."""
    stack = [(-1, 0)]
    for i in range(1, len(lcp) + 1):
        cur = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack[-1][0] > cur:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if stack[-1][0] < cur:
            stack.append((cur, first))


def left_order(lefts: np.ndarray, left_len: np.ndarray) -> np.ndarray:
    """Members by their (reversed) left contexts; of equal padded rows the shorter first."""
    rows = [x.tobytes() for x in lefts]
    return np.array(sorted(range(len(rows)), key=lambda i: (rows[i], left_len[i])))


def scan_group(lcp: list[int], lefts: np.ndarray, left_len: np.ndarray, window: int, groups: list | None = None) -> list[tuple[int, int, int]]:
    """(member, before, after) spans of one key's members, in suffix order.

    *groups* gets the maximal repeats (before, after, members).
    """
    m = len(lcp)
    order = left_order(lefts, left_len)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    near = np.zeros(m, np.int64)
    near[1:] = common(lefts[order[1:]], lefts[order[:-1]], np.minimum(left_len[order[1:]], left_len[order[:-1]]))
    best = np.full(m, -1)
    out: list[tuple[int, int, int]] = []
    for depth, first, last in intervals(lcp):
        r = np.sort(rank[first : last + 1])
        # common left lengths of neighbours in the interval's own left order
        shared = np.minimum.reduceat(near, np.column_stack((r[:-1] + 1, np.minimum(r[1:] + 1, m - 1))).ravel())[::2]
        shared = np.where(r[1:] == m - 1, np.minimum(shared, near[m - 1]), shared)
        if shared.max() + depth < window:
            continue
        longest = np.maximum(np.append(shared, -1), np.append(-1, shared))
        who = order[r]
        gain = (longest > best[who]) & (longest + depth >= window)
        out += [(int(i), int(l), depth) for i, l in zip(who[gain], longest[gain], strict=True)]
        best[who] = np.maximum(best[who], longest)
        if groups is not None:
            inner = [x for x in lcp[first + 1 : last + 1]]
            child = np.concatenate(([0], np.cumsum(np.array(inner) == depth)))
            for before, a, z in intervals([0, *shared.tolist()]):
                members = who[a : z + 1]
                if before + depth >= window and len(set(child[members - first].tolist())) > 1:
                    groups.append((before, depth, sorted(members.tolist())))
    return out


def sweep_group(lcp: np.ndarray, lefts: np.ndarray, left_len: np.ndarray, right_len: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """The same spans by trying every split of the window; linear in the members for each split."""
    m = len(lcp)
    order = left_order(lefts, left_len)
    near = np.zeros(m, np.int64)
    near[1:] = common(lefts[order[1:]], lefts[order[:-1]], np.minimum(left_len[order[1:]], left_len[order[:-1]]))
    hit = np.zeros((m, lefts.shape[1] + 1), bool)
    for o in range(lefts.shape[1] + 1):
        by_right = np.cumsum(lcp < window - o)
        by_left = np.empty(m, np.int64)
        by_left[order] = np.cumsum(near < o)
        able = np.flatnonzero((left_len >= o) & (right_len >= window - o))
        _, back, n = np.unique(by_right[able] * (m + 1) + by_left[able], return_inverse=True, return_counts=True)
        hit[able, o] = n[back] > 1
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return [(int(i), int(h) - 1, window - int(lo)) for i, lo, h in zip(who, low, high, strict=True)]


def scan_sorted(batches: Iterator[pa.RecordBatch], window: int = WINDOW, anchor: int = SPEC.k) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by (key, right) -> ranges (key, ctx, before, after). Holds one key's rows at most."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        key, ctx, n = (table.column(c).combine_chunks().to_numpy() for c in ("key", "ctx", "n"))
        right, right_len = padded(table.column("right").combine_chunks(), window)
        left, left_len = padded(table.column("left").combine_chunks(), window - anchor)
        lcp = np.zeros(len(key), np.int64)
        lcp[1:] = common(right[1:], right[:-1], np.minimum(right_len[1:], right_len[:-1]))
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(begins[1:], len(key))
        found = [np.column_stack((np.flatnonzero(n > 1), left_len[n > 1], right_len[n > 1]))]
        two = begins[ends - begins == 2]
        if len(two):
            l = common(left[two], left[two + 1], np.minimum(left_len[two], left_len[two + 1]))
            r = lcp[two + 1]
            good = l + r >= window
            found += [np.column_stack((two[good] + i, l[good], r[good])) for i in (0, 1)]
        for a, z in zip(begins[ends - begins > 2], ends[ends - begins > 2], strict=True):
            if z - a > MOST_SCANNED:
                got = sweep_group(np.concatenate(([0], lcp[a + 1 : z])), left[a:z], left_len[a:z], right_len[a:z], window)
            else:
                got = scan_group([0, *lcp[a + 1 : z].tolist()], left[a:z], left_len[a:z], window)
            if got:
                found.append(np.array(got, np.int64) + np.array([a, 0, 0]))
        all_ = np.concatenate(found)
        if len(all_):
            i = all_[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(ctx[i]), pa.array(all_[:, 1].astype(np.int32)), pa.array(all_[:, 2].astype(np.int32))], ["key", "ctx", "before", "after"])

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index("key")).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut or (held and held[-1].column(b.schema.get_field_index("key"))[-1].as_py() != keys[0]):
            yield from flush(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
    if held:
        yield from flush(pa.Table.from_batches(held))


def grouped_sorted(batches: Iterator[pa.RecordBatch], window: int = WINDOW, anchor: int = SPEC.k) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by (key, right) -> a row (key, ctx, nth, before, after) for each member of the key's nth group."""

    def of_key(table: pa.Table) -> pa.RecordBatch:
        key, ctx, n = (table.column(c).combine_chunks().to_numpy() for c in ("key", "ctx", "n"))
        right, right_len = padded(table.column("right").combine_chunks(), window)
        left, left_len = padded(table.column("left").combine_chunks(), window - anchor)
        lcp = np.zeros(len(key), np.int64)
        lcp[1:] = common(right[1:], right[:-1], np.minimum(right_len[1:], right_len[:-1]))
        groups: list[tuple[int, int, list[int]]] = []
        if len(key) > 1:
            scan_group(lcp.tolist(), left, left_len, window, groups)
        # a context with several places is a group as a whole, if it is not in one of that extent
        whole = {(before, after, i) for before, after, members in groups for i in members}
        groups += [(int(left_len[i]), int(right_len[i]), [i]) for i in np.flatnonzero(n > 1).tolist() if (left_len[i], right_len[i], i) not in whole]
        at = np.array([i for _, _, members in groups for i in members], np.int64)
        each = [len(members) for _, _, members in groups]
        columns = [np.repeat(np.array([g[j] for g in groups], np.int32), each) for j in (0, 1)]
        arrays = [key[at], ctx[at], np.repeat(np.arange(len(groups), dtype=np.int32), each), *columns]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "ctx", "nth", "before", "after"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(0)[-1].as_py() != keys[a]:
                yield of_key(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield of_key(pa.Table.from_batches(held))


def maximal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The repeats around each anchor with all their places: key, nth, doc_id, start, length (bytes).

    (key, nth) names a group. A group is maximal within the anchor's context (up
    to ``window`` bytes from the anchor on, and as many as can be in one window
    with it before): its members do not all go on alike on either side there. A
    longer repeat shows as a group at each of its anchors.
    """
    walked = walk(docs, GROUPS, id_col, text_col)
    found = _suffixes(walked).mapInArrow(grouped_sorted, "key long, ctx long, nth int, before int, after int")
    members = walked.where(F.col("kind") == CONTEXT).select("rid", "rhash", "start", "key", "ctx")
    start = (F.col("start") - F.col("before")).alias("start")
    return members.join(found, ["key", "ctx"]).select("key", "nth", row_id().alias(id_col), start, (F.col("before") + F.col("after")).alias("length"))


def _suffixes(walked: DataFrame) -> DataFrame:
    """(key, ctx, n, left, right) dealt by key, in suffix order."""
    suffixes = walked.where(F.col("kind") == CONTEXT).groupBy("key", "ctx", "left", "right").agg(F.count(F.lit(1)).alias("n"))
    return suffixes.select("key", "ctx", "n", "left", "right").repartition("key").sortWithinPartitions("key", "right")


def repeat_ranges(walked: DataFrame) -> DataFrame:
    """(key, ctx, before, after, low): how far around an anchor a context is repeated."""
    out = _suffixes(walked).mapInArrow(scan_sorted, "key long, ctx long, before int, after int")
    return out.withColumn("low", F.lit(None).cast("long"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rhash, spans): byte ranges of each document that are covered by repeats."""
    walked = walk(docs, SPEC, id_col, text_col)
    return spans_of(walked, repeat_ranges(walked))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans."""
    spans = repeated_spans(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), whole_text(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.as_buffer() else b"" for t in b.column(1)]
            row, start, stop = covered(b.column(2))
            first = np.searchsorted(row, np.arange(len(texts) + 1))
            kept, gone = [], []
            for i, t in enumerate(texts):
                a, z = first[i], first[i + 1]
                gone.append(int((stop[a:z] - start[a:z]).sum()))
                cuts = [0, *np.column_stack((start[a:z], stop[a:z])).ravel().tolist(), len(t)]
                kept.append(t if a == z else b"".join(t[cuts[j] : cuts[j + 1]] for j in range(0, len(cuts), 2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(np.diff(first)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    joined = rows.join(spans, ["rid", "rhash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
