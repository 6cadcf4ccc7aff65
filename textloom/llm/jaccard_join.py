"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document's set holds the hashes of its distinct shingles. Sets fall into
bands of size. A band hashes the universe of shingles into m segments; if two
sets of sizes s and t have a Jaccard similarity of 3/4 or more, at most
H = (s + t) / 7 shingles are in one of them only. If a probing set spends H + 1
units over its segments - one where the segments must be equal, two where they
may differ in one shingle - some segment is within what was spent on it.

Cost-based allocation: segments without shingles, which nearly all sets share,
are never used. Bands of small sets use few, large segments with two units each
and index every one-deletion neighbour, bands of large sets use many segments
with one unit each and no neighbours. The number of segments of a band is
raised until every set of the data can spend its units. What a set could spend
beyond H + 1 is its spare: once the buckets' sizes are known, it takes back that
many units from its most crowded buckets. Sets that merely share a passage so
probe nowhere, and no pair is lost.

Sets that are equal become one class first. Buckets (segment, content) are
built from packed arrays. In a bucket, members are first compared with one
probe; those that the verified links join into one component need no further
comparison. The others are settled in rounds by pivots (see one_round()): what
sets differ in from a central member is small and mostly rare, and sets that are
linked but not to the pivot must have much of it in common, so the pigeonhole
principle over these rare shingles leaves few pairs. All comparisons are exact
on the sets of 64-bit shingle hashes.

Null, empty and wordless texts have an empty set and link with nothing; their
component is their own id. Repeated rows and ids are fine; a null id is never a
component's smallest. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import symbols as S
from textloom.llm.common import discard, fresh, materialise, release, row_key, whole_text

SHINGLE = 5
RATIO = 1.6
#: Bands whose sets have up to this many shingles index one-deletion neighbours.
SMALL = 24
#: Pairs for each member of a pivot's group that a first round compares one by one.
PAIRS_PER_MEMBER = 64
#: Packed entries that one reducing group holds, about.
GROUP_ENTRIES = 1 << 20
LEAST_GROUPS = 12
CHUNK_BYTES = 1 << 20
#: Bits of a packed entry: band, segment (where neighbours are indexed).
BAND_BITS, SEGMENT_BITS = 6, 4

BUCKET = ["part", "bucket"]
CLASS = ["f1", "f2"]
PIVOT = ["p1", "p2"]
Plan = dict[int, tuple[int, int, int, bool]]  # band -> (least size, largest size, segments, neighbours)


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """100 * intersection >= 75 * union."""
    return 4 * common >= 3 * (a + b - common)


def band_edges(largest: int) -> list[int]:
    """Least sizes of the bands, the last one beyond *largest*."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.floor(out[-1] * RATIO)))
    return out


def first_plan(largest: int) -> Plan:
    edges = band_edges(largest)
    plan = {}
    for i, (low, nxt) in enumerate(zip(edges, edges[1:], strict=False)):
        high = nxt - 1
        small = high <= SMALL
        plan[i] = (low, high, math.ceil(high / 3.5) if small else math.ceil(0.4 * high) + 4, small)
    return plan


def wider(low: int, high: int, m: int, near: bool) -> tuple[int, int, int, bool]:
    """A band with more segments; at last every shingle is its own segment."""
    m = math.ceil(1.5 * m) if m < 1 << 24 else 1 << 62
    return low, high, m, near and m < 1 << SEGMENT_BITS


def shingle_sets(seq: S.Sequence, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's sorted distinct shingles; a shorter text is one shingle."""
    words = np.diff(seq.bounds)
    count = np.where(words == 0, 0, np.maximum(words - n + 1, 1))
    start, _ = S.ragged(seq.bounds[:-1], seq.bounds[:-1] + count)
    doc = np.repeat(np.arange(len(words)), count)
    stop = np.minimum(start + n, seq.bounds[1:][doc])
    h = S.Spans(S.mix(seq.symbols)).hash(start, stop) if len(start) else np.zeros(0, S.U)
    for a, z in zip(*(x.tolist() for x in _ranges(count)), strict=True):
        h[a:z].sort()
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(doc[new], np.arange(len(words) + 1))


def _ranges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stop = np.cumsum(count)
    return stop - count, stop


def sets_of(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) for chunks of a batch's texts."""
    data, offsets = S.texts_of(b.column(column))
    for first, last in S.chunks(offsets, CHUNK_BYTES):
        h, bounds = [], [0]
        for a, z in S.chunks(offsets[first : last + 1]):
            part, at = shingle_sets(S.as_words(data, offsets[first + a : first + z + 1], lower=True))
            h.append(part)
            bounds += (at[1:] + bounds[-1]).tolist()
        yield first, np.concatenate(h), np.array(bounds)


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    out = []
    for level in (5, 6):
        sums = np.zeros(len(h) + 1, S.U)
        np.cumsum(S.mix(h ^ S.LEVELS[level]), out=sums[1:])
        out.append(S.mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def segments(h: np.ndarray, size: np.ndarray, m: int, band: int) -> tuple[np.ndarray, ...]:
    """(set, segment, shingles, content) of the non-empty segments, and each shingle's entry and value."""
    seed = S.mix(np.array([band + 1], S.U))[0]
    x = S.mix(h ^ seed)
    row = np.repeat(np.arange(len(size)), size)
    seg = (x >> S.U(1)) % S.U(m)
    value = S.mix(x + S.LEVELS[7])
    order = np.argsort(row.astype(S.U) * S.U(m) + seg) if m < 1 << 32 else np.lexsort((seg, row))
    r, g, v = row[order], seg[order], value[order]
    head = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])))) if len(r) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(r)))
    content = np.add.reduceat(v, head) if len(head) else v
    return r[head], g[head], count, content, np.repeat(np.arange(len(head)), count), v


def needed(size: np.ndarray, low: int, high: int) -> np.ndarray:
    """Units that a set must spend among the (not larger) sets of a band."""
    return (size + np.minimum(size, high)) // 7 + 1


def in_band(size: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sets that belong to a band or may be similar to a smaller set in it."""
    return np.flatnonzero((size >= low) & (3 * size <= 4 * high) | (size >= low) & (size <= high))


def pick(h: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return h[S.ragged(bounds[rows], bounds[rows + 1])[0]]


def allowances(h: np.ndarray, bounds: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, band, spare): units that each set has beyond those it needs; negative if short of them."""
    size = np.diff(bounds)
    out = [[np.zeros(0, np.int64)] * 3]
    for band, (low, high, m, near) in plan.items():
        rows = in_band(size, low, high)
        if len(rows):
            row, _, count, _, _, _ = segments(pick(h, bounds, rows), size[rows], m, band)
            units = np.bincount(row, np.minimum(count, 2) if near else None, minlength=len(rows)).astype(np.int64)
            out.append([rows, np.full(len(rows), band), units - needed(size[rows], low, high)])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def entries(h: np.ndarray, bounds: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """(key, set, band, segment, indexed) of all entries; every entry is a probe."""
    size = np.diff(bounds)
    out = [[np.zeros(0, S.U), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)]]
    for band, (low, high, m, near) in plan.items():
        rows = in_band(size, low, high)
        if not len(rows):
            continue
        row, seg, count, content, entry, value = segments(pick(h, bounds, rows), size[rows], m, band)
        own = size[rows] <= high
        base = S.mix(seg + S.LEVELS[8] * np.array([band + 1], S.U))
        at = np.full(len(row), band)
        name = seg.astype(np.int64) if near else np.zeros(len(row), np.int64)
        out.append([S.mix(base ^ content), rows[row], at, name, own[row]])
        if near:
            # from two shingles on, also the segment without each one of them
            lone = entry[(count > 1)[entry]]
            rest = content[lone] - value[(count > 1)[entry]]
            out.append([S.mix(base[lone] ^ rest), rows[row[lone]], at[lone], name[lone], own[row[lone]]])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def document_sets(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """(rid, rhash, id, n, f1, f2, bands, spares): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, h, bounds in sets_of(b, 3):
                f1, f2 = fingerprints(h, bounds)
                n = len(bounds) - 1
                row, band, spare = allowances(h, bounds, plan)
                order = np.argsort(row, kind="stable")
                ends = pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int32))) for x in (band, spare)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(first, n) for i in range(3)), pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2), *lists],
                    ["rid", "rhash", "id", "n", "f1", "f2", "bands", "spares"],
                )
                S.trim()

    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "rid long, rhash long, id long, n long, f1 long, f2 long, bands array<int>, spares array<int>")


def planned_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Plan]:
    """document_sets() under a plan in which no set is short of units."""
    longest = docs.agg(F.max(F.octet_length(whole_text(text_col)))).first()[0] or 0
    plan = first_plan(longest // 2 + 1)
    if len(plan) > 1 << BAND_BITS:
        raise ValueError("a text is too long for the number of size bands")
    while True:
        rows = materialise(document_sets(docs, plan, id_col, text_col), "sets")
        spare = F.explode(F.arrays_zip("bands", "spares")).alias("x")
        # at most one row for each band
        short = {r.band for r in rows.select(spare).where("x.spares < 0").select(F.col("x.bands").alias("band")).distinct().collect()}
        if not short:
            return rows, plan
        release(docs.sparkSession, rows)
        plan = {b: wider(*p) if b in short else p for b, p in plan.items()}


def packed_entries(docs: DataFrame, plan: Plan, groups: int, text_col: str) -> DataFrame:
    """(part, words, names): per chunk of documents and group, entries of 16 bytes.

    From its lowest bit a word holds whether the entry is indexed (all probe),
    segment, band, and the rest of its key; keys shortened so only add
    candidates. The name is f1 of the set. Equal sets of a chunk are entered once.
    """
    band_at = 1 + SEGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, bounds in sets_of(b, 0):
                f1, f2 = fingerprints(h, bounds)
                n = np.diff(bounds)
                _, one = np.unique(np.column_stack((f1, f2)), axis=0, return_index=True)
                rows = np.sort(one[n[one] > 0])
                key, who, band, seg, index = entries(pick(h, bounds, rows), np.concatenate(([0], np.cumsum(n[rows]))), plan)
                part = (key % S.U(groups)).astype(np.int64)
                word = (key // S.U(groups)) << S.U(band_at + BAND_BITS) | band.astype(S.U) << S.U(band_at) | seg.astype(S.U) << S.U(1) | index.astype(S.U)
                order = np.argsort(part, kind="stable")
                yield _dealt(part[order], word[order], f1[rows][who[order]])
                S.trim()

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(run, DEALT)


DEALT = "part int, words binary, names binary"


def _dealt(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each part (sorted), with the columns' values as bytes."""
    parts, at = np.unique(part, return_index=True)
    stop = np.append(at[1:], len(part))[: len(at)]
    blobs = [pa.array([c[i:j].tobytes() for i, j in zip(at, stop, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *blobs], ["part", "words", "names", "more", "most"][: 1 + len(blobs)])


def _joined(rows: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    """The concatenated values of a column of bytes."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])


BUCKETS = "part int, bucket long, f1 long, band int, seg long, size int, indexed boolean"


def shared_buckets(packed: DataFrame, plan: Plan) -> DataFrame:
    """Members of the buckets that hold more than one class, with the bucket's size.

    ``seg`` names the segment of the member that the bucket belongs to.
    """
    nears = np.zeros(1 << BAND_BITS, bool)
    nears[[b for b, p in plan.items() if p[3]]] = True

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        word, name = _joined(rows, "words", S.U), _joined(rows, "names")
        # most keys stand alone; only the others are looked at further
        order = np.argsort(word >> S.U(1 + SEGMENT_BITS))
        bucket = (word >> S.U(1 + SEGMENT_BITS))[order]
        twin = np.zeros(len(bucket), bool)
        twin[1:] = bucket[1:] == bucket[:-1]
        twin[:-1] |= twin[1:]
        order, bucket = order[twin], bucket[twin].astype(np.int64)
        word, name = word[order], name[order]
        order = np.lexsort((name, bucket))
        bucket, word, name = bucket[order], word[order], name[order]
        # one row for each class of a bucket
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (name[1:] != name[:-1])
        head = np.flatnonzero(new)
        indexed = np.bitwise_or.reduceat((word & S.U(1)).astype(np.int64), head) > 0 if len(head) else np.zeros(0, bool)
        bucket, word, name = bucket[head], word[head], name[head]
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else head
        count = np.diff(np.append(begin, len(bucket)))
        size = np.repeat(count, count)
        found = np.repeat(np.logical_or.reduceat(indexed, begin), count) if len(begin) else indexed
        i = np.flatnonzero((size > 1) & found)
        band = (word[i] >> S.U(1 + SEGMENT_BITS)).astype(np.int64) & (1 << BAND_BITS) - 1
        seg = (word[i] >> S.U(1)).astype(np.int64) & (1 << SEGMENT_BITS) - 1
        part = key[0].as_py()
        alone = S.mix(bucket[i].view(S.U) ^ S.mix(np.full(len(i), part + 1, S.U))).view(np.int64)
        arrays = [np.full(len(i), part, np.int32), bucket[i], name[i], band.astype(np.int32), np.where(nears[band], seg, alone), size[i].astype(np.int32), indexed[i]]
        out = pa.Table.from_arrays([pa.array(x) for x in arrays], [x.split()[0] for x in BUCKETS.split(", ")])
        del word, name, order, bucket, twin
        S.trim()
        return out

    return packed.groupBy("part").applyInArrow(reduce, BUCKETS)


def allocated(buckets: DataFrame, rows: DataFrame, plan: Plan) -> DataFrame:
    """The buckets with a probe left after every class took its spare units from the most crowded ones."""
    near = [b for b, p in plan.items() if p[3]]
    cost = F.when(F.col("band").isin(near), 2).otherwise(1)
    zipped = rows.where("n > 0").select("f1", F.explode(F.arrays_zip("bands", "spares")).alias("x"))
    spares = zipped.groupBy("f1", F.col("x.bands").alias("band")).agg(F.min("x.spares").alias("spare"))
    crowd = buckets.groupBy("f1", "band", "seg").agg(F.max("size").alias("crowd"))
    spent = F.sum(cost).over(W.partitionBy("f1", "band").orderBy(F.desc("crowd"), "seg").rowsBetween(W.unboundedPreceding, 0))
    kept = crowd.withColumn("spent", spent).join(spares, ["f1", "band"]).where("spent > spare").select("f1", "band", "seg", F.lit(True).alias("probe"))
    flagged = buckets.join(kept, ["f1", "band", "seg"], "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
    used = flagged.where("probe or indexed").select("part", "bucket", "f1", "probe", "indexed")
    live = used.groupBy("part", "bucket").agg(F.bool_or("probe").alias("p"), F.bool_or("indexed").alias("i"), F.count(F.lit(1)).alias("k"))
    left = used.join(live.where("p and i and k > 1").select("part", "bucket"), ["part", "bucket"])
    classes = rows.where("n > 0").groupBy("f1", "f2").agg(F.max("n").alias("n"))
    return left.join(classes, "f1").select("part", "bucket", "f1", "f2", "n", "probe", "indexed")


def distances(pairs: DataFrame, sets: DataFrame, items: str = "items") -> DataFrame:
    """The pairs (a1, a2, b1, b2, ...) with ``d``, the size of the symmetric difference of their *items*.

    A class that *sets* lacks has no items.
    """
    a = sets.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col(items).alias("a_items"))
    b = sets.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col(items).alias("b_items"))
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            apart = []
            for p, q in zip(x.column(len(columns)), x.column(len(columns) + 1), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q) if v.is_valid] or [np.zeros(0, np.uint64)]), kind="stable")
                apart.append(len(both) - 2 * int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(len(columns))), pa.array(apart, pa.int64())], [*columns, "d"])
            S.trim()

    met = pairs.join(b, ["b1", "b2"], "left").join(a, ["a1", "a2"], "left").select(*columns, "a_items", "b_items")
    return met.mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "d"]))


def links_of(apart: DataFrame) -> DataFrame:
    """The linked ones of the pairs with sizes an, bn and distance d: 100 * intersection >= 75 * union."""
    return apart.where("7 * d <= an + bn").select("a1", "a2", "b1", "b2")


def shared_parts(members: DataFrame, sets: DataFrame, groups: int) -> DataFrame:
    """(f1, f2, shared): of each open class's shingles those that a class of another component has too.

    *members* has the classes with their label. Shingles are dealt by hash to
    find the components that hold them, then by class.
    """
    whose = F.xxhash64("label.l1", "label.l2").alias("whose")
    items = sets.join(members.select(*CLASS, whose).distinct(), CLASS).select(*CLASS, "whose", "items")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1 << 10):
                some = b.slice(first, 1 << 10)
                data, offsets = S.texts_of(some.column(3))
                h = data[offsets[0] : offsets[-1]].view(S.U)
                who = np.repeat(np.arange(some.num_rows), np.diff(offsets) // 8)
                part = (h % S.U(groups)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                yield _dealt(part[order], h[order], *(some.column(i).to_numpy()[who[order]] for i in range(3)))
            S.trim()

    def met(key: tuple, rows: pa.Table) -> pa.Table:
        h, f1, f2, whose = _joined(rows, "words", S.U), *(_joined(rows, c) for c in ("names", "more", "most"))
        order = np.lexsort((whose, h))
        h, whose = h[order], whose[order]
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        last = np.append(head[1:], len(h)) - 1
        both = np.repeat(whose[head] != whose[last], np.diff(np.append(head, len(h))))
        h, f1, f2 = h[both], f1[order[both]], f2[order[both]]
        part = f1 % groups
        order = np.argsort(part, kind="stable")
        out = pa.Table.from_batches([_dealt(part[order], h[order], f1[order], f2[order])])
        del h, f1, f2, whose, order
        S.trim()
        return out

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        h, f1, f2 = _joined(rows, "words", S.U), _joined(rows, "names"), _joined(rows, "more")
        order = np.lexsort((h, f2, f1))
        h, f1, f2 = h[order], f1[order], f2[order]
        head = np.flatnonzero(np.concatenate(([True], (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1]))))
        out = pa.Table.from_arrays([pa.array(f1[head]), pa.array(f2[head]), S.binary(h, np.append(head, len(h)))], ["f1", "f2", "shared"])
        S.trim()
        return out

    more = DEALT + ", more binary"
    dealt = items.mapInArrow(deal, more + ", most binary")
    return dealt.groupBy("part").applyInArrow(met, more).groupBy("part").applyInArrow(gather, "f1 long, f2 long, shared binary")


def deltas(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows (p1, p2, f1, f2, ...) with ``delta``: the shingles that only one of p' and the class's x' has, sorted."""
    columns = members.columns
    kinds = dict(members.select(*columns).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, q in zip(b.column(len(columns)), b.column(len(columns) + 1), strict=True):
                h = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q) if v.is_valid] or [np.zeros(0, np.uint64)]), kind="stable")
                alone = np.ones(len(h), bool)
                alone[1:] &= h[1:] != h[:-1]
                alone[:-1] &= h[:-1] != h[1:]
                out.append(h[alone].tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(out, pa.binary())], [*columns, "delta"])
            S.trim()

    side = lambda t, c: parts.select(F.col("f1").alias(f"{t}1"), F.col("f2").alias(f"{t}2"), F.col("shared").alias(c))
    met = members.join(side("f", "x_part"), CLASS, "left").join(side("p", "p_part"), PIVOT, "left").select(*columns, "p_part", "x_part")
    return met.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", delta binary")


def tokens(members: DataFrame) -> DataFrame:
    """(p1, p2, f1, f2, token): a row for each shingle of a member's delta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1 << 10):
                some = b.slice(first, 1 << 10)
                data, offsets = S.texts_of(some.column(4))
                h = data[offsets[0] : offsets[-1]].view(np.int64)
                who = np.repeat(np.arange(some.num_rows), np.diff(offsets) // 8)
                yield pa.RecordBatch.from_arrays([*(pa.array(some.column(i).to_numpy()[who]) for i in range(4)), pa.array(h)], [*PIVOT, *CLASS, "token"])
            S.trim()

    return members.select(*PIVOT, *CLASS, "delta").mapInArrow(run, "p1 long, p2 long, f1 long, f2 long, token long")


def one_round(members: DataFrame, labels: DataFrame, sets: DataFrame, groups: int, generous: int) -> tuple[DataFrame, DataFrame]:
    """One round over unsettled buckets: (the members that are not settled yet, written; the labels).

    Let own(x) be the number of shingles of x that no other component has, and
    x' the rest of x. The members of least own of all buckets are the
    central sets; each bucket takes as its pivot p the one, of those that its
    members meet in their buckets, that most sets meet. The members of all
    buckets of one pivot are a group, and each keeps its
    delta, the symmetric difference of p' and x'. With r(x) = 7 * (own(x) +
    |delta(x)|) - n(x), sets x and y of different components are linked if and
    only if

        14 * |delta(x) & delta(y)| >= r(x) + r(y)

    If that holds with no common shingle, both are linked to the member with the
    least r for the same reason: these links are applied first. All others must
    have so many shingles of their deltas in common, which few have. A member
    that needs more than its delta holds leaves. Of the rest each looks only at
    the rarest shingles of its delta, as many as cannot all be missed (if c of m
    must be common, one is among any m - c + 1). Members with such a shingle in
    common are compared; groups in which they would make more than *generous*
    pairs a member wait for a round with another pivot. Pivots are settled.
    """
    spark = members.sparkSession
    parts = materialise(shared_parts(members, sets, groups), "shared")
    own = F.col("n") - F.coalesce(F.floor(F.octet_length("shared") / 8), F.lit(0))
    full = members.join(parts, CLASS, "left").withColumn("own", own).drop("shared")
    central = full.groupBy(*BUCKET).agg(F.min(F.struct("seen", "own", *CLASS)).alias("c")).select(*BUCKET, F.struct("c.f1", "c.f2").alias("p"))
    met = full.join(central, BUCKET).select(*CLASS, "p").distinct()
    known = met.join(met.groupBy("p").agg(F.count(F.lit(1)).alias("k")), "p").groupBy(*CLASS).agg(F.max(F.struct("k", "p")).alias("best"))
    best = full.join(known, CLASS).groupBy(*BUCKET).agg(F.max("best").alias("best"))
    chosen = materialise(best.select(*BUCKET, F.col("best.p.f1").alias("p1"), F.col("best.p.f2").alias("p2")), "pivots")
    group = full.join(chosen, BUCKET).select(*PIVOT, *CLASS, "n", "own").distinct()
    size = F.floor(F.octet_length("delta") / 8)
    group = materialise(deltas(group, parts).withColumn("r", 7 * (F.col("own") + size) - F.col("n")), "deltas")
    least = group.groupBy(*PIVOT).agg(F.min(F.struct("r", *CLASS)).alias("m"))
    sure = group.join(least, PIVOT).where("r + m.r <= 0 and (f1 <> m.f1 or f2 <> m.f2)")
    certain = sure.select(F.col("m.f1").alias("a1"), F.col("m.f2").alias("a2"), F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    # within a group these count as one component at once
    named = labelled(group, labels).join(least, PIVOT)
    named = named.withColumn("label", F.when(F.col("r") + F.col("m.r") <= 0, F.struct(F.col("m.f1").alias("l1"), F.col("m.f2").alias("l2"))).otherwise(F.col("label"))).drop("m")
    low = named.groupBy(*PIVOT, "label").agg(F.min("r").alias("r"))
    lowest = low.groupBy(*PIVOT).agg(F.min(F.struct("r", "label")).alias("one"))
    other = low.join(lowest, PIVOT).groupBy(*PIVOT).agg(F.first("one").alias("one"), F.min(F.when(F.col("label") != F.col("one.label"), F.col("r"))).alias("two"))
    most = F.when(F.col("label") != F.col("one.label"), F.col("one.r")).otherwise(F.col("two"))
    room = lambda partner: size - F.greatest(F.lit(1), F.ceil((F.col("r") + partner) / 14)) + 1
    able = named.join(other, PIVOT).withColumns({"prefix": room(most), "short": F.when(most.isNotNull(), room(F.greatest(most, "r")))}).where("prefix > 0")
    able = materialise(able.withColumn("first", F.col("label") == F.col("one.label")).drop("one", "two"), "able")
    held = tokens(able)
    nth = F.row_number().over(W.partitionBy(*PIVOT, *CLASS).orderBy("k", "token"))
    often = held.groupBy(*PIVOT, "token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    ranked = held.join(often, [*PIVOT, "token"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("nth", nth)
    probes = ranked.join(able.select(*PIVOT, *CLASS, "prefix", "short", "label", "n", "r"), [*PIVOT, *CLASS]).where("nth <= prefix and k > 1")
    probes = materialise(probes.select(*PIVOT, "token", *CLASS, "label", "n", "r", (F.col("nth") <= F.col("short")).alias("few")), "probes")
    met = probes.groupBy(*PIVOT, "token", "label").agg(F.count(F.lit(1)).alias("k"), F.count_if("few").alias("few")).groupBy(*PIVOT, "token")
    pairs = met.agg((F.sum("k") * F.sum("few") - F.sum(F.col("k") * F.col("few"))).cast("double").alias("pairs")).groupBy(*PIVOT).agg(F.sum("pairs").alias("pairs"))
    many = able.groupBy(*PIVOT).agg(F.count(F.lit(1)).alias("k")).join(pairs, PIVOT).where(F.col("pairs") > generous * F.col("k")).select(*PIVOT)
    many = materialise(many, "many")
    found = links_of(distances(candidates(probes.join(many, PIVOT, "left_anti")), sets))
    last = relabelled(labels, materialise(certain.union(found).distinct(), "verified"))
    left = able.join(many, PIVOT).select(*PIVOT, *CLASS, "first")
    columns = [*BUCKET, *CLASS, "n", "probe", "indexed"]
    open_ = full.select(*columns).join(chosen, BUCKET).where("f1 <> p1 or f2 <> p2").join(left, [*PIVOT, *CLASS])
    open_ = materialise(open_.select(*columns, F.col("first").alias("seen")), "open")
    discard(spark, parts, chosen, group, able, probes, many)
    return open_, last


def candidates(probes: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2, an, bn): members of different components with a shingle of their prefixes in common."""
    columns = (("f1", "1"), ("f2", "2"), ("n", "n"), ("label", "l"), ("r", "r"))
    side = lambda t: probes.where("few or 'b' = '" + t + "'").select(*PIVOT, "token", *(F.col(c).alias(f"{t}{x}") for c, x in columns))
    ahead = "(ar < br or ar = br and (a1 < b1 or a1 = b1 and a2 < b2))"
    met = side("a").join(side("b"), [*PIVOT, "token"]).where(f"al <> bl and {ahead} and 4 * least(an, bn) >= 3 * greatest(an, bn)")
    return met.select("a1", "a2", "b1", "b2", "an", "bn").distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after the written *links*; both tables go if they are not the result."""
    spark = labels.sparkSession
    out = components(labels, links) if links.limit(1).count() else labels
    discard(spark, links, *([labels] if out is not labels else []))
    return out


def settled(buckets: DataFrame, labels: DataFrame, sets: DataFrame, groups: int) -> DataFrame:
    """The labels after all links between members of one bucket are applied, in rounds."""
    spark = buckets.sparkSession
    members, generous = buckets.withColumn("seen", F.lit(False)), PAIRS_PER_MEMBER
    while True:
        open_ = materialise(unresolved(members, labels), "unresolved")
        if generous > PAIRS_PER_MEMBER:
            discard(spark, members)
        if not open_.limit(1).count():
            discard(spark, open_)
            return labels
        members, labels = one_round(open_, labels, sets, groups, generous)
        release(spark, open_)
        generous *= 8


def class_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(f1, f2, items): the sorted shingle hashes of one document (rid, rhash) of each wanted class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, h, bounds in sets_of(b, 2):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), S.binary(h, bounds)], ["f1", "f2", "items"])
                S.trim()

    rows = docs.select(*row_key(id_col, text_col), whole_text(text_col).alias("text"))
    return rows.join(wanted, ["rid", "rhash"]).select("f1", "f2", "text").mapInArrow(run, "f1 long, f2 long, items binary").dropDuplicates(["f1", "f2"])


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(f1, f2, l1, l2) with links (a1, a2, b1, b2) applied: each label becomes the least one of its component.

    Labels of linked classes are joined by taking the least neighbour's label
    and following it (pointer jumping); each round is a written table.
    """
    spark = labels.sparkSession
    name = lambda t, c: F.struct(F.col(f"{t}1"), F.col(f"{t}2")).alias(c)
    at = labels.select(name("f", "node"), name("l", "label"))
    ends = links.select(name("a", "a"), name("b", "b"))
    edge = ends.join(at.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    edge = materialise(edge.where("x <> y").select("x", "y").distinct(), "links")
    points = materialise(edge.select(F.col("x").alias("node")).union(edge.select("y")).distinct().select("node", F.col("node").alias("top")), "points")
    old: list[DataFrame] = []
    while True:
        both = edge.union(edge.select("y", "x"))
        near = both.join(points.select(F.col("node").alias("y"), "top"), "y").groupBy(F.col("x").alias("node")).agg(F.min("top").alias("near"))
        # hooking a root onto a smaller neighbouring root, then jumping
        low = points.join(near, "node").select("node", "top", F.least("top", "near").alias("low"))
        hook = low.groupBy(F.col("top").alias("node")).agg(F.min("low").alias("hooked"))
        step = points.join(hook.select(F.col("node").alias("top"), "hooked"), "top").select("node", F.col("hooked").alias("top"))
        jump = step.select(F.col("node").alias("top"), F.col("top").alias("over"))
        nxt = materialise(step.join(jump, "top", "left").select("node", F.coalesce("over", "top").alias("top")), "points")
        same = nxt.join(points.withColumnRenamed("top", "was"), "node").where("top <> was").limit(1).count() == 0
        old.append(points)
        points = nxt
        if same:
            break
    out = at.join(points.select(F.col("node").alias("label"), "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = materialise(out.select(F.col("node.*"), F.col("label")).toDF("f1", "f2", "label").select("f1", "f2", F.col("label").getField(at.schema["label"].dataType.fieldNames()[0]).alias("l1"), F.col("label").getField(at.schema["label"].dataType.fieldNames()[1]).alias("l2")), "labels")
    discard(spark, *old, points, edge)
    return out


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id; with *keys* also rid, rhash and the component's label l1, l2 (null for an empty set)."""
    spark = docs.sparkSession
    rows, plan = planned_sets(docs, id_col, text_col)
    total = rows.agg(F.sum("n")).first()[0] or 0
    groups = max(LEAST_GROUPS, math.ceil(total / GROUP_ENTRIES))
    shared = materialise(shared_buckets(packed_entries(docs, plan, groups, text_col), plan), "shared")
    release(spark)
    buckets = materialise(allocated(shared, rows, plan), "buckets")
    release(spark, shared)
    classes = rows.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.min(F.struct("rid", "rhash")).alias("row"))
    wanted = buckets.select("f1", "f2").distinct().join(classes, ["f1", "f2"]).select("f1", "f2", "row.*")
    sets = materialise(class_sets(docs, wanted, id_col, text_col), "items")
    release(spark)
    labels = materialise(sets.select("f1", "f2", F.col("f1").alias("l1"), F.col("f2").alias("l2")), "labels")
    # most buckets are settled by one pivot; a class that is in many meets the least of their pivots
    first = materialise(links_of(distances(pivots(buckets), sets)), "verified")
    after = components(labels, first)
    release(spark, labels, first)
    labels = settled(buckets, after, sets, groups)
    release(spark, buckets, sets)
    whole = labels.select("f1", "f2", F.struct("l1", "l2").alias("label")).join(classes.select("f1", "f2", "id"), ["f1", "f2"], "right")
    whole = whole.withColumn("label", F.coalesce("label", F.struct(F.col("f1").alias("l1"), F.col("f2").alias("l2"))))
    least = whole.groupBy("label").agg(F.min("id").alias("component_id"))
    ids = whole.select("f1", "f2", "label").join(least, "label").select("f1", "f2", "component_id", "label.l1", "label.l2")
    names = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles")]
    more = ["rid", "rhash", "l1", "l2"] if keys else []
    full = rows.where("n > 0").join(ids, ["f1", "f2"]).select(*names, "component_id", *more)
    none = rows.where("n = 0").withColumns({c: F.lit(None).cast(ids.schema[c].dataType) for c in ("l1", "l2")})
    none = none.select(*names, F.col("id").alias("component_id"), *more)
    return full.union(none)


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(*CLASS, F.struct("l1", "l2").alias("label")), CLASS)


def unresolved(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with labels of the buckets that hold more than one component."""
    named = labelled(buckets, labels)
    mixed = named.groupBy(*BUCKET).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select(*BUCKET)
    return named.join(mixed, BUCKET)


def pivots(members: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2, an, bn): each class with the least probe of its buckets that its size lets it link to."""
    chosen = members.where("probe").groupBy(*BUCKET).agg(F.min(F.struct("f1", "f2", "n")).alias("p"))
    met = members.join(chosen, BUCKET).where("(f1 <> p.f1 or f2 <> p.f2) and 4 * least(n, p.n) >= 3 * greatest(n, p.n)")
    least = met.groupBy(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("n").alias("bn")).agg(F.min("p").alias("p"))
    return least.select(F.col("p.f1").alias("a1"), F.col("p.f2").alias("a2"), "b1", "b2", F.col("p.n").alias("an"), "bn")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each_component: bool = False) -> DataFrame:
    """*docs* with one document of each component, with all columns it had.

    The row with the component's smallest id stays (of several with that id, one).
    Components that share their smallest id keep one row together, or with
    *each_component* a row each.
    Rows with an empty set, and those of components without any id, all stay but
    for exact repeats of a row.
    """
    found = join_components(docs, id_col, text_col, keys=True)
    grouped = found.where("n_shingles > 0 and doc_id = component_id").groupBy(*(("l1", "l2") if each_component else ("rid",))).agg(F.min(F.struct("rid", "rhash")).alias("row")).select("row.*")
    single = found.where("n_shingles = 0 or component_id is null").select("rid", "rhash").distinct()
    names = fresh(docs, "rid", "rhash", "nth")
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(row_key(id_col, text_col), names[:2], strict=True)))
    kept = keyed.join(grouped.union(single).toDF(*names[:2]), names[:2], "left_semi")
    nth = F.row_number().over(W.partitionBy(*names[:2]).orderBy(*names[:2]))
    return kept.withColumn(names[2], nth).where(F.col(names[2]) == 1).select(*docs.columns)
