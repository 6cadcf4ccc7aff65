"""Anchored repeats: the shared front end of the two substring deduplications.

Every window of ``window`` symbols has one anchor, the k-gram of least hash in
it (leftmost of equals), so two equal windows have equal anchors at the same
place, and only about 2 of ``window - k`` positions need to be compared.

1. ``edges``: one row per anchor with its hash ``key`` and the hash of the
   symbols through the next and the previous anchor (``link``, ``plink``).
2. ``nodes``: per key, over all documents, the number of places and the
   smallest and largest document, and whether all places go on (or come from)
   the same link. Counted before the shuffle, so a frequent key costs a row
   per task.
3. ``walk``: in each document, runs of anchors joined by such single links are
   compacted to paths. What is forced around an anchor stands at every place of
   its key, so windows inside need no further look. Only where a context (all
   windows of an anchor) is wider, at branches and ends, is it sent on. Without
   ``compact`` every context of a repeated anchor is, and there are no links.

Texts are cut out of the documents only after the small keys have met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import symbols as S
from textloom.llm.common import materialise, release, row_id, row_key, whole_text

PLACE, CONTEXT = 0, 1
WALK = "kind int, rid long, rhash long, start int, stop int, key long, ctx long, left binary, right binary, first int, windows binary"


@dataclass(frozen=True)
class Spec:
    window: int
    k: int
    unit: str  # "byte" or "word"
    #: Repeats count only between documents, for the larger id of the two.
    across: bool
    #: Whether runs of single links are settled without their contexts.
    compact: bool = True

    @property
    def edge_columns(self) -> list[str]:
        return ["rid", "rhash", "nth", "key", *(["link", "plink"] if self.compact else [])]

    def sequence(self, data: np.ndarray, offsets: np.ndarray) -> S.Sequence:
        return S.as_bytes(data, offsets) if self.unit == "byte" else S.as_words(data, offsets)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(id_col, text_col), whole_text(text_col).alias("text"))


def _anchored(spec: Spec, seq: S.Sequence):
    """Anchors with their document's index and link hashes (valid where ``linked``)."""
    pos, low, high, key = S.window_anchors(seq, spec.window, spec.k)
    doc = np.searchsorted(seq.bounds, pos, "right") - 1
    linked = np.zeros(len(pos), bool)
    link = np.zeros(len(pos), S.U)
    if len(pos) and spec.compact:
        linked[:-1] = doc[1:] == doc[:-1]
        at = np.flatnonzero(linked)
        link[at] = S.Spans(seq.symbols).hash(pos[at], pos[at + 1] + spec.k)
    return pos, low, high, key, doc, linked, link


def edges(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, rhash, nth, key, link, plink), one row per anchor; no links without ``compact``.

    Where a document begins or ends, the link is a value of that place alone,
    which no other place shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = S.texts_of(b.column(2))
            name = S.mix(b.column(0).to_numpy().view(S.U) ^ S.mix(b.column(1).to_numpy().view(S.U)))
            for first, last in S.chunks(offsets):
                seq = spec.sequence(data, offsets[first : last + 1])
                pos, _, _, key, doc, linked, link = _anchored(spec, seq)
                if not len(pos):
                    continue
                began = np.searchsorted(doc, doc, "left")
                row = pa.array(doc + first)
                before = np.roll(linked, 1)
                before[0] = False
                nth = np.arange(len(pos)) - began
                own = S.mix(name[doc + first] + nth.astype(S.U))
                arrays = [
                    *(b.column(i).take(row) for i in range(2)),
                    pa.array(nth.astype(np.int32)),
                    pa.array(key.view(np.int64)),
                    pa.array(np.where(linked, link, own).view(np.int64)),
                    pa.array(np.where(before, np.roll(link, 1), ~own).view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(arrays[: len(spec.edge_columns)], spec.edge_columns)

    kinds = ", ".join(f"{c} {'int' if c == 'nth' else 'long'}" for c in spec.edge_columns)
    return _documents(docs, id_col, text_col).mapInArrow(run, kinds)


def nodes(edge_rows: DataFrame, spec: Spec) -> DataFrame:
    """(key, low, ahead, back) of the repeated keys.

    Rows that are equal in all but their place in the cluster count each: a
    repeated row has the links of its copy, and n is 2.
    """
    one = lambda c: F.min(c) == F.max(c) if spec.compact else F.lit(False)
    count, ends = F.count(F.lit(1)).alias("n"), (F.min(row_id()).alias("low"), F.max(row_id()).alias("high"))
    out = edge_rows.groupBy("key").agg(*(ends if spec.across else (count,)), one("link").alias("ahead"), one("plink").alias("back"))
    low = F.col("low") if spec.across else F.lit(0).cast("long").alias("low")
    return out.where("low < high" if spec.across else "n > 1").select("key", low, "ahead", "back")


def walk(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of kind PLACE (a repeated span start:stop of a document) and CONTEXT (to be compared)."""
    edge_rows = materialise(edges(docs, spec, id_col, text_col), "edges")
    # written, so that the join has plain shuffles on both sides and a frequent key is split
    key_rows = materialise(nodes(edge_rows, spec), "nodes")
    found = edge_rows.select("rid", "rhash", "nth", "key").join(key_rows, "key")
    #: At most one entry for each anchor of one document.
    per_doc = found.groupBy("rid", "rhash").agg(F.collect_set(F.struct("nth", "low", F.col("ahead").cast("int").alias("a"), F.col("back").cast("int").alias("b"))).alias("seen"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = S.texts_of(b.column(2))
            seen = b.column(3)
            at = np.asarray(seen.offsets).astype(np.int64)
            fields = seen.values
            nth = np.asarray(fields.field(0))
            low_doc = np.asarray(fields.field(1).fill_null(np.iinfo(np.int64).max))
            ahead, back = (np.asarray(fields.field(i)).astype(bool) for i in (2, 3))
            order = np.where(b.column(1).to_numpy() & 1, np.iinfo(np.int64).min, b.column(0).to_numpy())
            for first, last in S.chunks(offsets):
                yield from _walk_chunk(spec, b, first, spec.sequence(data, offsets[first : last + 1]), at[first : last + 1], nth, low_doc, ahead, back, order)

    joined = _documents(docs, id_col, text_col).join(per_doc, ["rid", "rhash"]).select("rid", "rhash", "text", "seen")
    out = materialise(joined.mapInArrow(run, WALK), "walk")
    del found, per_doc, joined
    release(docs.sparkSession, edge_rows, key_rows)
    return out


def _walk_chunk(spec, b, first, seq, at, nth, low_doc, ahead, back, order):
    pos, lo, hi, key, doc, _, _ = _anchored(spec, seq)
    if not len(pos):
        return
    began = np.searchsorted(doc, np.arange(len(seq.bounds) - 1), "left")
    here = slice(at[0], at[-1])
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spot = began[rows] + nth[here]
    known = np.zeros(len(pos), bool)
    known[spot] = True
    least = np.zeros(len(pos), np.int64)
    least[spot] = low_doc[here]
    forth = np.zeros(len(pos), bool)
    forth[spot] = ahead[here]
    come = np.zeros(len(pos), bool)
    come[spot] = back[here]
    n = len(pos)
    index = np.arange(n)
    # the last anchor that is forced from i on, and the first one back from i
    stop_at = np.where(forth, n, index)
    right = np.minimum.accumulate(stop_at[::-1])[::-1]
    stop_at = np.where(come, -1, index)
    left = np.maximum.accumulate(stop_at)
    reach_right = pos[np.minimum(right, n - 1)] + spec.k
    reach_left = pos[np.maximum(left, 0)]
    interior = known & (reach_left <= lo) & (reach_right >= hi + spec.window)
    base = seq.bounds[doc]
    mine = order[first + doc]
    # what is forced around an anchor is there at every place of its key
    s, e = np.maximum(lo, reach_left), np.minimum(hi + spec.window, reach_right)
    place = known & (e - s >= spec.window)
    bound = np.flatnonzero(place & (least < mine) if spec.across else place)
    if len(bound) and spec.compact:
        # consecutive places that overlap are one span
        s, e = s[bound], e[bound]
        new = np.concatenate(([True], (doc[bound][1:] != doc[bound][:-1]) | (s[1:] > e[:-1])))
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(bound)])) - 1
        d = doc[bound][head]
        yield _rows(b, first + d, PLACE, s[head] - base[bound][head], e[tail] - base[bound][head])
    other = np.flatnonzero(known & ~interior if spec.compact else known)
    if len(other):
        spans = S.Spans(seq.symbols)
        ctx = spans.hash(lo[other], hi[other] + spec.window) ^ S.mix((pos[other] - lo[other]).astype(S.U) + S.U(1))
        p = pos[other] - base[other]
        if spec.unit == "byte":
            i, off = S.ragged(-pos[other] + 1, -lo[other] + 1)
            j, off_r = S.ragged(pos[other], hi[other] + spec.window)
            content = [S.binary(seq.data[-i], off), S.binary(seq.data[j], off_r), None, None]
        else:
            w, off = S.ragged(lo[other], hi[other] + 1)
            content = [None, None, pa.array((pos[other] - lo[other]).astype(np.int32)), S.binary(spans.hash(w, w + spec.window), off)]
        yield _rows(b, first + doc[other], CONTEXT, p, p, key[other], ctx, *content)


def _rows(b, row, kind, start, stop, key=None, ctx=None, left=None, right=None, ahead=None, windows=None) -> pa.RecordBatch:
    n = len(row)
    none = lambda t: pa.nulls(n, t)
    row = pa.array(row)
    arrays = [
        pa.array(np.full(n, kind, np.int32)),
        *(b.column(i).take(row) for i in range(2)),
        pa.array(start.astype(np.int32)),
        pa.array(stop.astype(np.int32)),
        pa.array(key.view(np.int64)) if key is not None else none(pa.int64()),
        pa.array(ctx.view(np.int64)) if ctx is not None else none(pa.int64()),
        left if left is not None else none(pa.binary()),
        right if right is not None else none(pa.binary()),
        ahead if ahead is not None else none(pa.int32()),
        windows if windows is not None else none(pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "rid", "rhash", "start", "stop", "key", "ctx", "left", "right", "first", "windows"])


def spans_of(walked: DataFrame, ranges: DataFrame) -> DataFrame:
    """(rid, rhash, spans): the places, and the members of each context with its ranges.

    *ranges*: (key, ctx, before, after, low) - a place covers start-before to
    start+after, if low is null or smaller than its document.
    """
    places = walked.where(F.col("kind") == PLACE).select("rid", "rhash", "start", "stop")
    members = walked.where(F.col("kind") == CONTEXT).select("rid", "rhash", "start", "key", "ctx")
    met = members.join(ranges, ["key", "ctx"]).where(F.col("low").isNull() | (F.col("low") < row_id()))
    compared = met.select("rid", "rhash", (F.col("start") - F.col("before")).alias("start"), (F.col("start") + F.col("after")).alias("stop"))
    return places.unionByName(compared).groupBy("rid", "rhash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def covered(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the united spans of each row of a list column, in order."""
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths().fill_null(0)))
    start, stop = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    big = int(stop.max()) + 1
    top = np.maximum.accumulate(stop + row * big) - row * big
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > top[:-1])))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(row)])) - 1
    return row[head], start[head], top[tail]
