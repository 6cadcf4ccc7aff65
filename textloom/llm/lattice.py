"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has the characters as nodes and the pieces of the vocabulary
(with byte pieces for characters it lacks) as edges. Its segmentations have the
probabilities of a unigram model: a piece of frequency rank r weighs
-theta * log(r + 2.7), normalised over all segmentations by a backward pass.

Perturbed A-star search: the largest Gumbel-perturbed log probability of the
whole lattice is drawn first, then the segmentation that attains it. Taking it
out splits the rest by the first node at which a segmentation departs from it;
the largest value of each part is a Gumbel variable truncated at the value of
the whole. Parts wait in a frontier, the greatest is expanded next, and so the
k emitted segmentations are distinct and in order of their perturbed values -
a sample of size k without replacement. The value that comes next in the
frontier is the threshold for their inclusion probabilities.

Random numbers depend only on the seed, the row's id and text, the sample and
the node, never on how rows are batched. Pieces do not cross the start of a run
of word marks or a line feed (none of such vocabularies does), so each distinct
word's lattice is built once a chunk.

An empty or null text has one segmentation, the empty one. A text with fewer
than k segmentations gives as many rows as it has. A word mark in a text cannot
be told from a space, so it is decoded as one, and ``round_trip`` is false for
such a text. Very long texts are whole units of a chunk of their own. Rows that repeat an id and a text get equal samples. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import symbols as S
from textloom.llm.common import row_key, whole_text

MARK = "▁"
_MARK = MARK.encode()
CHUNK_BYTES = 3 << 17
THETA = 1.0
SEED = 17
SLOT_BITS = 21
#: No standard Gumbel number made of uniform() is larger.
MOST = 38.0
#: Edges that a worker keeps between chunks (21 bytes each).
EDGES_HELD = 6_000_000
#: Units whose lattices are built together; it bounds the working memory.
BUILT_AT_ONCE = 1 << 14


class Vocabulary:
    """Pieces, byte pieces and weights of a SentencePiece model file."""

    def __init__(self, model_file: str, theta: float = THETA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.size = sp.get_piece_size()
        ids = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model must have all byte pieces")
        pieces = [sp.id_to_piece(i) for i in ids]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("pieces must not cross the start of a word or a line feed")
        self.longest = max(map(len, pieces))
        # frequency ranks: by score, ties by id
        rank = {i: r for r, i in enumerate(sorted(ids, key=lambda i: (-sp.get_score(i), i)))}
        weight = np.array([-theta * np.log(rank[i] + 2.7) for i in ids])
        self.byte_weight = float(-theta * np.log(n + 2.7))
        h, heads = hashes_of(pieces)
        order = np.argsort(h)
        self.hashes, self.ids, self.weights = h[order], np.array(ids)[order], weight[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("pieces must be distinct")
        self.starts = np.zeros(1 << SLOT_BITS, bool)
        self.starts[(heads >> S.U(64 - SLOT_BITS)).astype(np.int64)] = True
        # slot of a hash's upper bits -> first piece there; pieces of one slot are neighbours
        slot = (self.hashes >> S.U(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.crowd = int(np.bincount(slot).max(initial=1))
        texts: list[bytes] = [b""] * n
        for i in ids:
            texts[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for byte, i in enumerate(self.byte_ids):
            texts[i] = bytes([byte])
        self.text_bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        spot = self.slots[(h >> S.U(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        maybe = np.flatnonzero(spot >= 0)
        out = np.full(len(h), -1, np.int64)
        for step in range(self.crowd):
            at = np.minimum(spot[maybe] + step, len(self.hashes) - 1)
            hit = self.hashes[at] == h[maybe]
            out[maybe[hit]] = at[hit]
            maybe = maybe[~hit]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of a sequence of ids, without the space that encoding puts in front."""
        return self.decoded(ids, np.array([0, len(ids)]))[0][1:]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, list[int]]:
        """The bytes of several sequences, each with the space in front, and their bounds."""
        at, ends = S.ragged(self.text_bounds[ids], self.text_bounds[ids + 1])
        return self.text[at].tobytes(), ends[bounds].tolist()


def hashes_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each piece, and those of all its beginnings."""
    sizes = np.array([len(p) for p in pieces])
    code = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(S.U)
    at = np.cumsum(sizes) - sizes
    h, heads = np.zeros(len(pieces), S.U), []
    for i in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > i)
        h[live] = h[live] * S.LEVELS[10] + (code[at[live] + i] + S.U(1)) * S.LEVELS[11]
        heads.append(S.mix(h[live]))
    return S.mix(h), np.concatenate(heads) if heads else h


@lru_cache(maxsize=2)
def vocabulary(model_file: str, theta: float = THETA) -> Vocabulary:
    """The vocabulary of a model file, read once in a process."""
    return Vocabulary(model_file, theta)


@lru_cache(maxsize=1)
def unit_table(model_file: str, theta: float) -> Table:
    """The lattices that a worker has built so far, kept from task to task within EDGES_HELD."""
    return Table(vocabulary(model_file, theta))


def forget() -> None:
    """Drop a worker's vocabulary and lattices."""
    vocabulary.cache_clear()
    unit_table.cache_clear()


S.HELD["lattice"] = forget


@dataclass
class Lattice:
    """Edges of the lattices of distinct units; node i of a unit is its i-th character.

    ``first[node]:first[node+1]`` are a node's edges, likeliest first, with the
    cumulative probabilities ``upto``. ``piece`` is -1 - code point for bytes.
    """

    first: np.ndarray
    length: np.ndarray
    piece: np.ndarray
    log_p: np.ndarray
    upto: np.ndarray
    base: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def build(code: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> Lattice:
    """The lattices of units of so many code points each."""
    base = np.concatenate(([0], np.cumsum(sizes)))
    n = len(code)
    rest = np.repeat(base[1:], sizes) - np.arange(n)
    src, size, piece, weight, nth = [], [], [], [], []
    degree = np.zeros(n, np.int64)
    at, h = np.arange(n), np.zeros(n, S.U)
    single = np.zeros(n, bool)
    for ell in range(1, vocab.longest + 1):
        ok = rest[at] >= ell
        at, h = at[ok], h[ok]
        if not len(at):
            break
        h = h * S.LEVELS[10] + (code[at + ell - 1] + S.U(1)) * S.LEVELS[11]
        m = S.mix(h)
        # only what begins some piece can grow to one
        alive = np.flatnonzero(vocab.starts[(m >> S.U(64 - SLOT_BITS)).astype(np.int64)])
        at, h, m = at[alive], h[alive], m[alive]
        spot = vocab.find(m)
        hit = np.flatnonzero(spot >= 0)
        where, spot = at[hit], spot[hit]
        if ell == 1:
            single[where] = True
            # a character without a piece has an edge of its bytes
            degree[:] = 1
        nth.append(degree[where] if ell > 1 else np.zeros(len(where), np.int64))
        if ell > 1:
            degree[where] += 1
        src.append(where)
        size.append(np.full(len(where), ell))
        piece.append(vocab.ids[spot])
        weight.append(vocab.weights[spot])
    lone = np.flatnonzero(~single)
    c = code[lone].astype(np.int64)
    src.append(lone)
    size.append(np.ones(len(lone), np.int64))
    piece.append(-1 - c)
    weight.append(vocab.byte_weight * utf8_length(c))
    nth.append(np.zeros(len(lone), np.int64))
    src, size, piece, weight, nth = (np.concatenate(x) for x in (src, size, piece, weight, nth))
    # backward pass: nodes by their distance to the unit's end, all units at once, and their edges by length
    node = np.argsort(rest, kind="stable")
    begin = np.empty(n, np.int64)
    begin[node] = np.cumsum(degree[node]) - degree[node]
    order = np.empty(len(src), np.int64)
    order[begin[src] + nth] = np.arange(len(src))
    src, size, piece, weight = src[order], size[order], piece[order], weight[order]
    far = rest[src]
    final = size == far
    end = np.where(final, n, src + size)
    beta = np.zeros(n + 1)
    cuts = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1])))
    head = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
    count = np.diff(np.append(head, len(src)))
    at_cut = np.searchsorted(head, np.append(cuts, len(src)))
    for i, a in enumerate(cuts.tolist()):
        h, c = head[at_cut[i] : at_cut[i + 1]], count[at_cut[i] : at_cut[i + 1]]
        z = int(h[-1] + c[-1])
        score = weight[a:z] + beta[end[a:z]]
        top = np.maximum.reduceat(score, h - a)
        beta[src[h]] = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, c)), h - a))
    log_p = np.minimum(weight + beta[end] - beta[src], 0.0)
    # a node's edges together, likeliest first; equal ones by length
    rough = np.minimum(-log_p * (1 << 16), (1 << 22) - 1).astype(S.U)
    order = np.argsort((src.astype(S.U) << S.U(30)) | (rough << S.U(8)) | size.astype(S.U))
    src, size, piece, log_p = src[order], size[order], piece[order], log_p[order]
    first = np.searchsorted(src, np.arange(n + 1))
    p = np.exp(log_p)
    # cumulative sums of each node on its own, in a fixed order
    upto = p.copy()
    deg = np.diff(first)
    nth = np.arange(len(src)) - first[src]
    for j in range(1, int(deg.max(initial=1))):
        k = np.flatnonzero(nth == j)
        upto[k] += upto[k - 1]
    return Lattice(first, size.astype(np.int8), piece.astype(np.int32), log_p, upto, base)


class Table:
    """Lattices of the units met so far; over EDGES_HELD edges the least used half goes.

    Most units are rare, so those that come again in many chunks are not built again.
    What a unit's lattice is does not depend on the others, so neither do results.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.names = np.zeros(0, S.U)
        self.places = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int32)
        self.nodes = self.edges = 0
        self.first = np.zeros(1, np.int64)
        self.length, self.piece = np.zeros(0, np.int8), np.zeros(0, np.int32)
        self.log_p, self.upto = np.zeros(0), np.zeros(0)

    def shrink(self, most: int) -> None:
        """Keep the most used units, the newest of equals, with up to *most* edges together; the arrays stay to be filled again."""
        order = np.argsort(self.places)
        start = self.places[order]
        stop = np.append(start[1:], self.nodes)[: len(start)]
        held = self.first[stop] - self.first[start]
        rank = np.lexsort((-start, -self.uses[order]))
        kept = np.sort(rank[np.cumsum(held[rank]) <= most])
        node, ends = S.ragged(start[kept], stop[kept])
        edge, _ = S.ragged(self.first[start[kept]], self.first[stop[kept]])
        upto = np.cumsum(self.first[node + 1] - self.first[node])
        for name in ("length", "piece", "log_p", "upto"):
            values = getattr(self, name)
            values[: len(edge)] = values[edge]
        self.nodes, self.edges = len(node), len(edge)
        self.first[0], self.first[1 : len(node) + 1] = 0, upto
        self.names, self.places, self.uses = self.names[order[kept]], ends[:-1], self.uses[order[kept]] // 2
        order = np.argsort(self.names)
        self.names, self.places, self.uses = self.names[order], self.places[order], self.uses[order]

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            grown = np.empty(max(at + len(values), len(held) * 5 // 4), held.dtype)
            grown[:at] = held[:at]
            setattr(self, name, held := grown)
        held[at : at + len(values)] = values

    def nodes_of(self, names: np.ndarray, code_of) -> np.ndarray:
        """First node of each named unit; *code_of* gives (code points, sizes) of those at some indices."""
        if self.edges > EDGES_HELD:
            self.shrink(EDGES_HELD // 2)
        spot = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        known = self.names[spot] == names if len(self.names) else np.zeros(len(names), bool)
        out = np.empty(len(names), np.int64)
        out[known] = self.places[spot[known]]
        self.uses[spot[known]] += 1
        new = np.flatnonzero(~known)
        for i in range(0, len(new), BUILT_AT_ONCE):
            some = new[i : i + BUILT_AT_ONCE]
            code, sizes = code_of(some)
            lat = build(code, sizes, self.vocab)
            out[some] = self.nodes + lat.base[:-1]
            self._put("first", self.nodes, lat.first + self.edges)
            for name in ("length", "piece", "log_p", "upto"):
                self._put(name, self.edges, getattr(lat, name))
            self.nodes, self.edges = self.nodes + len(code), self.edges + len(lat.piece)
        if len(new):
            both = np.concatenate((self.names, names[new]))
            order = np.argsort(both)
            self.names, self.places = both[order], np.concatenate((self.places, out[new]))[order]
            self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int32)))[order]
        return out


def utf8_length(c: np.ndarray) -> np.ndarray:
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


def uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) named by a 64-bit seed and a place."""
    return unit(S.mix(seed + (at.astype(S.U) + S.U(1)) * S.LEVELS[12]))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit values as numbers in (0, 1)."""
    return ((x >> S.U(11)).astype(np.float64) + 0.5) * 2.0**-53


def salt(i: int) -> np.uint64:
    return S.mix(np.array([i + 1], S.U) * S.LEVELS[13])[0]


class Chunk:
    """Texts of a chunk over one table of unit lattices; positions count characters of all of them."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray, table: Table) -> None:
        self.vocab, self.seeds, self.lattice = table.vocab, seeds, table
        marked = [b" " + (t.replace(_MARK, b" ") if _MARK in t else t) if t else t for t in texts]
        data = np.frombuffer(b"".join(marked), np.uint8)
        ends = np.cumsum([len(t) for t in marked])
        space, line = data == 32, data == 10
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins |= line
        begins[1:] |= line[:-1]
        heads = np.concatenate(([0], ends[:-1]))
        begins[heads[heads < ends]] = True
        at = np.flatnonzero(begins)
        stop = np.append(at[1:], len(data))
        name = S.Spans(S.BYTE_HASH[data]).hash(at, stop)
        order = np.argsort(name)
        sorted_ = name[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        one = order[new]
        kinds = np.empty(len(order), np.int64)
        kinds[order] = np.cumsum(new) - 1
        head = (data & 0xC0) != 0x80
        letters = np.add.reduceat(head, at).astype(np.int64) if len(at) else at

        def code_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, _ = S.ragged(at[one[which]], stop[one[which]])
            code = np.frombuffer(data[i].tobytes().decode().encode("utf-32-le"), np.uint32).astype(S.U)
            return np.where(code == 32, S.U(ord(MARK)), code), letters[one[which]]

        base = table.nodes_of(sorted_[new], code_of)
        self.start = np.concatenate(([0], np.cumsum(letters)))
        self.units = np.searchsorted(at, np.concatenate(([0], ends)))
        self.bounds = self.start[self.units]
        n = self.start[-1]
        self.node = np.arange(n) + np.repeat(base[kinds] - self.start[:-1], letters)
        self.stop = np.repeat(self.start[1:].astype(np.int32), letters)
        self.text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.bounds))

    def draw(self, at: np.ndarray, chosen: np.ndarray, sample: int) -> None:
        """Follow random edges from the nodes *at* to the ends of their units."""
        lat = self.lattice
        # uniform() of a text's seed and a place in it, with what depends on the text alone summed up
        seeds = (self.seeds ^ salt(2 * sample)) + (S.U(1) - self.bounds[:-1].astype(S.U)) * S.LEVELS[12]
        while len(at):
            node = self.node[at]
            edge, last = lat.first[node], lat.first[node + 1] - 1
            u = unit(S.mix(seeds[self.text_of[at]] + at.astype(S.U) * S.LEVELS[12]))
            open_ = np.flatnonzero(edge < last)
            while len(open_):
                open_ = open_[u[open_] > lat.upto[edge[open_]]]
                edge[open_] += 1
                open_ = open_[edge[open_] < last[open_]]
            chosen[at] = edge
            at = at + lat.length[edge]
            inside = at < self.stop[at - 1]
            at = at[inside]

    def parts(self, path: np.ndarray, edges: np.ndarray, first: np.ndarray, stop: np.ndarray, before: np.ndarray, value: np.ndarray, docs: np.ndarray, extra: dict, sample: int, want: int, width: int = 384) -> list[list[tuple[float, int]]]:
        """Per text, the *want* largest (value, index into path) of the parts that depart from its path.

        Index i stands for the segmentations that agree before path[i] and take
        another edge there. No Gumbel number drawn here exceeds MOST, and the
        mass of a part falls along the path, so a part far behind the want-th
        best need not be drawn; where that is not certain, more nodes are.
        """
        out: list[list[tuple[float, int]]] = [[] for _ in docs]
        todo = np.arange(len(docs))
        while len(todo):
            d, f, z = docs[todo], first[todo], stop[todo]
            at = f[:, None] + np.arange(width)
            real = at < z[:, None]
            at = np.minimum(at, max(len(path) - 1, 0))
            lp = np.where(real, self.lattice.log_p[edges[at]], 0.0) if len(path) else np.zeros(at.shape)
            ahead = before[todo][:, None] + np.cumsum(lp, axis=1)
            gone = np.exp(lp)
            free = real & (gone < 1)
            for i in range(len(todo)):
                if (more := extra.get(int(d[i]))) is not None:
                    gone[i, 0] += more[0]
                    free[i, 0] = more[1]
            u = uniform(self.seeds[d][:, None] ^ salt(2 * sample + 1), path[at] - self.bounds[d][:, None]) if len(path) else np.full(at.shape, 0.5)
            with np.errstate(divide="ignore"):
                mass = ahead - lp + np.where(free, np.log(np.maximum(1.0 - gone, 0.0)), -np.inf)
                drawn = mass - np.log(-np.log(u))
            # the largest few, the first of equals; truncation keeps their order
            rows, best, most = np.arange(len(todo)), [], []
            for _ in range(min(want, width)):
                best.append(drawn.argmax(axis=1))
                most.append(drawn[rows, best[-1]])
                drawn[rows, best[-1]] = -np.inf
            top = -np.logaddexp(-value[d][:, None], -np.column_stack(most))
            least = top[:, -1] if len(best) == want else np.full(len(todo), -np.inf)
            sure = (f + width >= z) | (ahead[:, -1] + MOST < least)
            spots = np.take_along_axis(at, np.column_stack(best), axis=1).tolist()
            for i, values in enumerate(top.tolist()):
                if sure[i]:
                    out[todo[i]] = [(v, j) for v, j in zip(values, spots[i], strict=True) if v > -np.inf]
            todo, width = todo[~sure], 2 * width
        return out

    def samples(self, k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per sample: (texts, sample, edges, their bounds, log probability, perturbed value, log inclusion probability)."""
        lat, n = self.lattice, len(self.bounds) - 1
        chosen = np.full(self.start[-1], -1, np.int32)
        self.draw(self.start[:-1], chosen, 0)
        value = -np.log(-np.log(uniform(self.seeds, np.full(n, 2**40))))
        frontier: list[list] = [[] for _ in range(n)]
        branch = np.full(n, -1)  # where a text's current sample departs
        banned: list[frozenset[int]] = [frozenset()] * n
        live = np.arange(n)
        emitted: list[tuple] = []
        for sample in range(k):
            alive = np.zeros(n, bool)
            alive[live] = True
            path = np.flatnonzero(chosen >= 0)
            path = path[alive[self.text_of[path]]]
            edges = chosen[path]
            at = np.searchsorted(path, self.bounds)
            lp = np.append(lat.log_p[edges], 0.0)
            sums = np.where(at[1:] > at[:-1], np.add.reduceat(lp, at[:-1]), 0.0)
            emitted.append((live, edges, np.append(at[live], len(path)), sums[live], value[live], path, at))
            first = np.maximum(np.searchsorted(path, self.bounds[:-1] + np.maximum(branch - self.bounds[:-1], 0)), at[:-1])[live]
            before = np.array([lp[a:f].sum() for a, f in zip(at[live].tolist(), first.tolist(), strict=True)])
            extra = {}
            for d in live[branch[live] >= 0].tolist():
                node = self.node[branch[d]]
                others = sum(np.exp(lat.log_p[e]) for e in sorted(banned[d]))
                extra[d] = (others, len(banned[d]) + 1 < lat.first[node + 1] - lat.first[node])
            found = self.parts(path, edges, first, at[1:][live], before, value, live, extra, sample, k + 1 - sample)
            follow = []
            for d, parts in zip(live.tolist(), found, strict=True):
                for v, i in parts:
                    spot = int(path[i])
                    ban = frozenset([int(edges[i])]) | (banned[d] if spot == branch[d] else frozenset())
                    heapq.heappush(frontier[d], (-v, sample, spot, ban))
                if sample + 1 < k and frontier[d]:
                    follow.append((d, *heapq.heappop(frontier[d])))
            if not follow:
                break
            # the next sample of each text: its source path up to the branch, another edge there, the rest anew
            starts = []
            for d, v, of, spot, ban in follow:
                a, z = self.bounds[d], self.bounds[d + 1]
                _, edges, _, _, _, path, at = emitted[of]
                keep = at[d] + int(np.searchsorted(path[at[d] : at[d + 1]], spot))
                chosen[a:z] = -1
                chosen[path[at[d] : keep]] = edges[at[d] : keep]
                node = self.node[spot]
                free = np.array([e for e in range(lat.first[node], lat.first[node + 1]) if e not in ban])
                p = np.cumsum(np.exp(lat.log_p[free]))
                u = uniform(self.seeds[d : d + 1] ^ salt(2 * sample + 2), np.array([spot - a]))[0]
                edge = free[min(int(np.searchsorted(p, u * p[-1])), len(free) - 1)]
                chosen[spot] = edge
                value[d], branch[d], banned[d] = -v, spot, ban
                here = spot + int(lat.length[edge])
                if here < self.stop[spot]:
                    starts.append(np.array([here]))
                own = self.start[self.units[d] : self.units[d + 1]]
                starts.append(own[np.searchsorted(own, spot, "right") :])
            live = np.array([x[0] for x in follow])
            self.draw(np.concatenate(starts), chosen, sample + 1)
        bar = np.array([-f[0][0] if f else -np.inf for f in frontier])
        for s, (live, edges, bounds, lp, v, _, _) in enumerate(emitted):
            # log(1 - exp(-exp(lp - bar)))
            above = np.minimum(lp - bar[live], 50.0)
            with np.errstate(divide="ignore"):
                inside = np.where(above > -30, np.log(-np.expm1(-np.exp(above))), above)
            yield live, s, edges, bounds, lp, v, np.where(bar[live] == -np.inf, 0.0, inside)

    def ids(self, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the edges, and their bounds: characters without a piece become bytes."""
        piece = self.lattice.piece[edges].astype(np.int64)
        raw = np.flatnonzero(piece < 0)
        if not len(raw):
            return piece, bounds
        code = -1 - piece[raw]
        piece[raw] = self.vocab.byte_ids[np.minimum(code, 127)]
        wide = raw[code > 127]
        if not len(wide):
            return piece, bounds
        size = np.ones(len(piece), np.int64)
        size[wide] = utf8_length(code[code > 127])
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(piece, size)
        for i, c in zip(wide.tolist(), code[code > 127].tolist(), strict=True):
            out[ends[i] : ends[i + 1]] = self.vocab.byte_ids[list(chr(c).encode())]
        return out, ends[bounds]


OUT = "sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids_sha256 string, round_trip boolean"


def encode_samples(docs: DataFrame, model_file: str, k: int = 2, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Up to *k* rows per input row: doc_id, sample (from 1), n_pieces, log_prob, perturbed,
    log_inclusion, ids_sha256 (little-endian 32-bit ids), round_trip (decoding gives the text) and ids,
    then the columns *carry* of the input.
    """
    if k < 1:
        raise ValueError("k must be positive")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = vocabulary(model_file, theta), unit_table(model_file, theta)
        for b in batches:
            data, offsets = S.texts_of(b.column(3))
            seeds = S.mix(b.column(1).to_numpy().view(S.U) + S.U(seed)) ^ S.mix(b.column(2).to_numpy().view(S.U))
            for first, last in S.chunks(offsets, CHUNK_BYTES):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
                chunk = Chunk(texts, seeds[first:last], table)
                for docs_, s, edges, bounds, lp, v, inside in chunk.samples(k):
                    ids, bounds = chunk.ids(edges, bounds)
                    packed = memoryview(ids.astype("<i4").tobytes())
                    text, cut = vocab.decoded(ids, bounds)
                    ends = bounds.tolist()
                    digest = [hashlib.sha256(packed[4 * i : 4 * j]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)]
                    same = [text[i:j] == (b" " + t if t else b"") for i, j, t in zip(cut, cut[1:], (texts[d] for d in docs_.tolist()), strict=False)]
                    n = len(docs_)
                    arrays = [b.column(0).take(pa.array(docs_ + first)), pa.array(np.full(n, s + 1, np.int32)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(lp), pa.array(v), pa.array(inside), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
                    names = ["doc_id", *(x.split()[0] for x in OUT.split(", "))]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    arrays += [b.column(4 + i).take(pa.array(docs_ + first)) for i in range(len(carry))]
                    names += carry
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    del ids, packed, text, arrays
                del chunk
                S.trim("lattice")

    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), whole_text(text_col).alias("text"), *carry)
    more = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carry)
    return rows.mapInArrow(run, f"doc_id {kind}, {OUT}" + (", ids array<int>" if with_ids else "") + more)


def decode_ids(encoded: DataFrame, model_file: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """*encoded* with the text that a list of piece ids stands for in column *out*.

    The space that encoding puts in front is taken off; no ids give an empty
    text, a null list, or one with an id that is null or not in the vocabulary,
    gives null. Bytes that are not UTF-8 together become replacement characters.
    """
    if out in encoded.columns:
        raise ValueError(f"there is a column {out} already")
    kinds = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    where = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file, THETA)
        for b in batches:
            texts: list[str | None] = []
            for x in b.column(where):
                ids = x.as_py()
                if ids is None or any(i is None or not 0 <= i < vocab.size for i in ids):
                    texts.append(None)
                else:
                    texts.append(vocab.decode(np.array(ids, np.int64)).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return encoded.mapInArrow(run, f"{kinds}, `{out}` string")
