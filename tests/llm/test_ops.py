"""Operators against brute force, on fixtures with nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import debruijn_dedup, exact_dedup, jaccard_join, mixing, quality, secret_scan, sharding, suffix_repeats, topk_search
from textloom.llm import symbols as S

#: Columns whose names clash with those that operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, key string, norm string, slot string, rid string, spans string, n string, label string"


def frame(spark, rows, sources=("src0", "src1", "src7", "zzz", None)):
    full = [(d, t, "en", sources[i % len(sources)], len(t or ""), "k", "n", "s", "r", "p", "x", "l") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, CLASH).repartition(3)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def same(df, want):
    assert rows_of(df) == sorted(map(repr, want))


def odd_rows(rnd, texts):
    """Texts with ids that are null, repeated or negative, and rows that repeat."""
    rows = [(rnd.choice([i, i, i, i // 2, -i, None]), t) for i, t in enumerate(texts)]
    return rows + [(None, None), (5001, None), (5002, ""), (5003, " \n\t"), rows[0], rows[0], rows[1]]


def passages(rnd, words, lengths=(150, 700)):
    return [" ".join(rnd.choice(words) for _ in range(200))[: rnd.randint(*lengths)] for _ in range(8)]


# op1


def brute_bytes(rows, w=200):
    seen, texts = Counter(), [(t or "").encode() for _, t in rows]
    for b in texts:
        seen.update(b[i : i + w] for i in range(len(b) - w + 1))
    out = []
    for (d, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_repeats(spark, seed):
    rnd = random.Random(seed)
    chars = lambda n: "".join(rnd.choice("abcdé \n\0") for _ in range(n))
    pool = [chars(rnd.randint(150, 700)) for _ in range(8)]
    texts = []
    for _ in range(120):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            a, q = rnd.randint(0, len(p) // 2), rnd.randint(0, len(p))
            t += rnd.choice([p[a:], p[:q] + "X" + p[q:], "ab" * rnd.randint(1, 250), "z" * rnd.randint(1, 400), chars(rnd.randint(1, 300))])
        texts.append(t.replace("\0", "0"))
    texts.append(chars(60_000).replace("\0", "0") + pool[0].replace("\0", "0"))
    rows = odd_rows(rnd, texts)
    same(suffix_repeats.remove_repeats(frame(spark, rows)).drop("kept"), brute_bytes(rows))


def test_scan_and_sweep_agree():
    rnd = random.Random(5)
    for _ in range(60):
        m = rnd.randint(2, 12)
        lefts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6))) for _ in range(m)]
        rights = sorted(b"K" + bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 6))) for _ in range(m))
        left = np.zeros((m, 6), np.uint8)
        right = np.zeros((m, 10), np.uint8)
        for i in range(m):
            left[i, : len(lefts[i])] = list(lefts[i])
            right[i, : len(rights[i])] = list(rights[i])
        ll, rl = np.array(list(map(len, lefts))), np.array(list(map(len, rights)))
        lcp = np.zeros(m, np.int64)
        lcp[1:] = suffix_repeats.common(right[1:], right[:-1], np.minimum(rl[1:], rl[:-1]))
        groups = []
        spans = suffix_repeats.scan_group(lcp.tolist(), left, ll, 7, groups)
        sweep = suffix_repeats.sweep_group(lcp, left, ll, rl, 7)
        cover = lambda found: {(i, p) for i, a, z in found for p in range(-a, z)}
        assert cover(spans) == cover(sweep)
        for before, after, members in groups:
            assert before + after >= 7 and len(members) > 1
            assert len({(lefts[i][:before], rights[i][:after]) for i in members}) == 1
            # maximal: no longer common string on either side, and all places are there
            assert len({lefts[i][before : before + 1] for i in members}) > 1 or any(len(lefts[i]) == before for i in members)
            alike = [i for i in range(m) if lefts[i][:before] == lefts[members[0]][:before] and rights[i][:after] == rights[members[0]][:after] and ll[i] >= before]
            assert alike == members


def test_maximal_groups(spark):
    """Every group is a repeat with all its places, and all repeated bytes are in groups."""
    rnd = random.Random(8)
    pool = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(200, 500))) for _ in range(4)]
    texts = [rnd.choice(pool)[: rnd.randint(150, 500)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 80))) + rnd.choice(["", pool[0]]) for _ in range(40)]
    groups = defaultdict(list)
    for r in suffix_repeats.maximal_groups(frame(spark, list(enumerate(texts)))).collect():
        groups[r.key, r.nth].append((r.doc_id, r.start, r.length))
    hit = [bytearray(len(t)) for t in texts]
    for places in groups.values():
        assert len({texts[d][s : s + n] for d, s, n in places}) == 1 and len(set(places)) == len(places) > 1 and places[0][2] >= 200
        string = texts[places[0][0]][places[0][1] : places[0][1] + places[0][2]]
        assert len(places) == sum(t.startswith(string, i) for t in texts for i in range(len(t)))
        for d, s, n in places:
            hit[d][s : s + n] = b"\1" * n
    assert [sum(h) for h in hit] == [x[2] for x in brute_bytes(list(enumerate(texts)))] and groups


# op2


def brute_words(rows, w=50):
    low, texts = {}, [(t or "").encode().split() for _, t in rows]
    for (d, _), x in zip(rows, texts, strict=True):
        for i in range(len(x) - w + 1):
            if d is not None:
                k = tuple(x[i : i + w])
                low[k] = min(low.get(k, d), d)
    out = []
    for (d, _), x in zip(rows, texts, strict=True):
        gone = [0] * len(x)
        for i in range(len(x) - w + 1):
            if d is not None and low[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [1] * w
        out.append((d, len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_debruijn(spark, seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "é", "dd", "e", "Ff"]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    pool = [some(rnd.randint(40, 200)) for _ in range(10)]
    texts = []
    for _ in range(150):
        t = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            a, q = rnd.randint(0, len(p) // 2), rnd.randint(0, len(p))
            t += rnd.choice([p[a:], p[:q] + ["X"] + p[q:], ["ab", "c"] * rnd.randint(1, 60), ["z"] * rnd.randint(1, 90), some(rnd.randint(1, 90))])
        texts.append(rnd.choice([" ", "\n", " \t"]).join(t))
    texts.append(" ".join(some(20_000) + pool[0]))
    rows = odd_rows(rnd, texts)
    same(debruijn_dedup.remove_repeats(frame(spark, rows)).drop("kept"), brute_words(rows))


# op3


def test_topk(spark):
    rnd = random.Random(4)
    vec = lambda: [rnd.choice([-0.5, 0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(6)]
    rows = [(i, vec()) for i in range(400)] + [(401, None), (402, [1.0, None]), (403, [math.nan] * 6), (404, [math.inf] * 6), (405, []), (None, vec())]
    rows += [(20, rows[20][1]), (40, [9.0] * 6), (1001, rows[3][1]), (1000, [1e9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("chunk", F.lit(1))
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            z = [math.floor(64 * x) for x in v]
            good[i] = min(good.get(i, z), z)
    want = []
    for q in (i for i in good if i % 20 == 0):
        s = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q))[:20]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    same(topk_search.search(df), want)
    assert topk_search.search(df.where("false")).count() == 0
    q = np.array([[9, 0], [0, 9]])
    v = np.array([[i // 256, 0] for i in range(4096)])
    *_, done = topk_search.search_blocks(np.array([-1, -2]), q, np.arange(4096), v, 20)
    assert done < 2 * 16  # blocks below the k-th score are not scored


def test_topk_wide(spark):
    """Large finite components: exact where 64 bits hold the score, the nearest 64-bit integer beyond."""
    rows = [(20, [1e7, 1.0]), (1, [1e7, 0.0]), (2, [-1e7, 0.0]), (3, [1e15, 0.0]), (40, [1e15, 0.0])]
    out = {(r.query_id, r.vec_id): r.score for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out[20, 1] == 640_000_000**2 and out[20, 2] == -(640_000_000**2)
    assert out[40, 3] == 2**63 - 1 and out[40, 2] == -(2**63) and len(out) == 8


# op5


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 5)
    monkeypatch.setattr(exact_dedup, "HOT_LIST", 10)
    rnd = random.Random(1)
    texts = [rnd.choice(["a  b", "a b", "a\tb ", "b", "long " * 9000, "é x", f"u{i}"]) for i in range(300)]
    rows = odd_rows(rnd, texts)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    kept = Counter()
    for r in out:
        mine = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == min((d for d in mine if d is not None), default=None) and r.group_size == len(mine)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert len(out) == len(rows) and set(kept.values()) == {1}
    left = exact_dedup.drop_copies(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in CLASH.split(", ")] and left.count() == len(groups)


# op6


def test_quality(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(500):
        good = rnd.random() < 0.7
        words = [word() for _ in range(rnd.randint(5, 200))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    rows += [(None, None), (None, "abc"), (900, ""), (901, "x" * 200_000), rows[0]]
    lab = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), labels[0]], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    out = quality.classify(df, lab).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)
    truth = dict((i, y) for i, y, _ in labels)
    held = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    again = {r.doc_id: r.score for r in quality.classify(df.withColumn("source", F.lit("q")), lab).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out if r.doc_id is not None)
    bad = {r.doc_id for r in out if not r.predicted and r.doc_id is not None}
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and not bad & {r.doc_id for r in kept.collect()}
    assert {round(r.score, 6) for r in quality.classify(df, lab.where("quality = 1")).collect()} != {0.0}
    assert quality.classify(df.where("false"), lab).count() == 0


def test_discriminant_by_brute_force(spark):
    """Scores against the two Gaussian densities written out, without factors."""
    rnd = random.Random(21)
    rows = [(i, " ".join(rnd.choice(["ab", "cde", "X!", "9 9"]) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    truth = {i: int(t.count("X!") < 8) for i, t in rows}
    lab = spark.createDataFrame([(i, y, 0) for i, y in truth.items()], "doc_id long, quality int, toxic int")
    x = {i: np.array(quality.statistics(t.encode())) for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    parts = [np.array([x[i] for i in train if truth[i] == y]) for y in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = (len(parts[0]) * cov[0] + len(parts[1]) * cov[1]) / len(train)
    logs = []
    for p, c in zip(parts, cov, strict=True):
        c = (1 - quality.SHRINK_POOLED) * c + quality.SHRINK_POOLED * pooled
        c = (1 - quality.SHRINK_DIAGONAL) * c + quality.SHRINK_DIAGONAL * np.diag(np.diag(c)) + quality.FLOOR * np.eye(len(c))
        inverse, det, mean = np.linalg.inv(c), np.linalg.slogdet(c)[1], p.mean(axis=0)
        logs.append(lambda v, i=inverse, d=det, m=mean, n=len(p): math.log(n) - 0.5 * (d + (v - m) @ i @ (v - m)))
    for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), lab).collect():
        gap = min(max(logs[0](x[r.doc_id]) - logs[1](x[r.doc_id]), -700), 700)
        assert abs(r.score - 1 / (1 + math.exp(gap))) < 1e-5


# op7


def shingles(t):
    w = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in holds[x] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_rows(rnd, n):
    vocab = [f"w{i}" for i in range(500)]
    base = [[rnd.choice(vocab) for _ in range(int(2 ** rnd.uniform(0, 9)))] for _ in range(max(4, n // 12))]
    shared = [rnd.choice(vocab) for _ in range(40)]
    texts = []
    for _ in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rnd.randrange(len(w) + 1)
            if rnd.random() < 0.5 and i < len(w):
                w[i] = rnd.choice(vocab)
            else:
                w.insert(i, rnd.choice(vocab))
        if rnd.random() < 0.25:
            w = shared + w
        texts.append(" ".join(w).upper() if rnd.random() < 0.3 else "\n".join(w))
    return odd_rows(rnd, texts)


def test_jaccard(spark):
    rnd = random.Random(6)
    rows = near_rows(rnd, 500)
    same(jaccard_join.join_components(frame(spark, rows)), brute_components(rows))
    kept = jaccard_join.drop_near_copies(frame(spark, rows))
    want = {c for _, n, c in brute_components(rows) if n and c is not None}
    got = Counter(r.doc_id for r in kept.collect() if (r.text or "").strip() and r.doc_id is not None)
    assert set(got) == want and set(got.values()) == {1}


def test_near_copies_of_one_id(spark):
    """Components that have their least id in common all keep a document."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(7, text("a")), (8, text("a") + " more"), (7, text("b")), (7, text("b") + " more"), (9, text("b")), (7, text("c")), (9, text("d")), (7, ""), (None, text("c"))]
    kept = jaccard_join.drop_near_copies(frame(spark, rows), each_component=True).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in kept) == [(7, ""), (7, "a0"), (7, "b0"), (7, "c0"), (9, "d0")]


def test_jaccard_pigeonhole():
    """Any two similar sets meet in a bucket that the larger one may not give up."""
    rnd = np.random.default_rng(3)
    for _ in range(40):
        size = int(2 ** rnd.uniform(0, 9))
        a = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rnd.random(len(a)) > rnd.uniform(0, 0.2)], rnd.integers(0, 2**63, int(rnd.integers(0, size // 6 + 2)), dtype=np.uint64))))
        if not len(b) or not jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        plan = jaccard_join.first_plan(2000)
        h, bounds = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        while (short := {int(x) for x, s in zip(*jaccard_join.allowances(h, bounds, plan)[1:], strict=True) if s < 0}):
            plan = {k: jaccard_join.wider(*p) if k in short else p for k, p in plan.items()}
        key, who, band, seg, index = jaccard_join.entries(h, bounds, plan)
        big = 0 if len(a) >= len(b) else 1
        low = set(key[(who == 1 - big) & index].tolist())
        shared = [(int(x), int(y), k) for x, y, k in zip(band[who == big], seg[who == big], key[who == big].tolist(), strict=True) if k in low]
        home = next(x for x, p in plan.items() if p[0] <= min(len(a), len(b)) <= p[1])
        spare = next(int(s) for r, x, s in zip(*jaccard_join.allowances(h, bounds, plan), strict=True) if r == big and x == home)
        mine = [x for x in shared if x[0] == home]
        units = 2 * len({s for _, s, _ in mine}) if plan[home][3] else len(mine)
        assert units > spare


# op8


def test_sharding(spark, tmp_path):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    less = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != 6)
    assert moved < 0.25 * 1009
    heavy = Counter(sharding.fill_table(names, 1009, [3, 1, 1, 1, 1, 1, 1]))
    assert abs(heavy[0] - 3 * heavy[1]) <= 3
    for bad in ((names, 1000, None), ([], 1009, None), (["a", "a"], 1009, None), (names, 1009, [0] * 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)
    df = frame(spark, odd_rows(random.Random(1), ["t"] * 50))
    out = sharding.assign_shards(df, names, 1009).collect()
    for r in out:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, table[slot])
    assert len(out) == 57 and sharding.assign_shards(df.where("false"), names, 1009).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), names, 1009)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 57 and {r.shard for r in back.collect()} == {r.shard for r in out}
    clash = df.withColumn("shard", F.lit("mine")).withColumn("_slot", F.lit(1))
    sharding.write_shards(clash, str(tmp_path / "clash"), names, 1009)
    again = spark.read.parquet(str(tmp_path / "clash"))
    assert {r.shard for r in again.collect()} == {"mine"} and {r._shard for r in again.collect()} == {r.shard for r in out}


# op9


def test_schedule_lag():
    for weights in ({"a": 1}, {"a": 1, "b": 1}, {"a": 5, **{f"s{i}": 1 for i in range(5)}}, {"a": 0.61, "b": 0.29, "c": 0.07, "d": 0.03}):
        shares = mixing.quotas(weights, 200)
        assert sum(shares.values()) == 200
        done = Counter()
        for t, (name, j, slot, release, due) in enumerate(mixing.schedule(shares)):
            assert slot == t and release <= slot < due and j == done[name]
            done[name] += 1
            assert all(abs(done[n] - s * (t + 1) / 200) < 1 for n, s in shares.items())
        assert done == Counter(shares)
    for bad in ({}, {"a": 0}, {"a": -1}, {"a": math.inf}):
        with pytest.raises(ValueError):
            mixing.quotas(bad)


def test_mix(spark):
    rnd = random.Random(8)
    rows = odd_rows(rnd, [f"t{i}" for i in range(700)])
    df = frame(spark, rows)
    out = mixing.mix(df, {"src0": 3, "src1": 1}, 2.0, block_rows=4, resolution=32).collect()
    assert len(out) == len(rows)
    shares = mixing.quotas({"src0": 3, "src1": 1, "*": 2.0}, 32)
    at = {(c, j): (slot, r, d) for c, j, slot, r, d in mixing.schedule(shares)}
    for name in shares:
        mine = sorted((r for r in out if r["class"] == name), key=lambda r: (r.slot, r.row_in_block))
        digest = [hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest() for r in mine]
        assert digest == sorted(digest)
        for i, r in enumerate(mine):
            assert (r.block, r.row_in_block) == divmod(i, 4)
            slot, release, due = at[name, r.block % shares[name]]
            shift = 32 * (r.block // shares[name])
            assert (r.slot, r.release, r.deadline) == (slot + shift, release + shift, due + shift)
    assert all((r["class"] == "*") == (r.source not in ("src0", "src1")) for r in out)
    stream = mixing.mixed_stream(df, {"src0": 3, "src1": 1})
    assert stream.columns == df.columns and stream.count() == len(rows)
    assert mixing.mix(df.where("false"), {"src0": 1}).count() == 0


def test_mix_each_source(spark):
    rnd = random.Random(12)
    names = ["src0", "src1", "a", "b", "c", "*", None]
    rows = [(i, "t", "en", rnd.choice([*names, "a", "a", "a"]), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = mixing.mix(df, {"src0": 3, "src1": 1}, 2.0, block_rows=4, resolution=64, each_source=True).collect()
    assert len(out) == len(rows) and {(r.source, r["class"]) for r in out} == {(n, "**" if n is None else n) for n in names}
    shares = mixing.quotas({"src0": 3, "src1": 1, **dict.fromkeys(["a", "b", "c", "*", "**"], 2.0 / 5)}, 64)
    blocks = {}
    for r in out:
        blocks.setdefault((r["class"], r.block), set()).add((r.slot, r.release, r.deadline))
        assert r.release == r.block * 64 // shares[r["class"]] and r.deadline == -(-(r.block + 1) * 64 // shares[r["class"]])
        assert r.release <= r.slot < r.deadline
    assert all(len(s) == 1 for s in blocks.values()) and len({s for s in map(frozenset, blocks.values())}) == len(blocks)
    for name in shares:
        mine = sorted((r for r in out if r["class"] == name), key=lambda r: (r.slot, r.row_in_block))
        assert [(r.block, r.row_in_block) for r in mine] == [divmod(i, 4) for i in range(len(mine))]
        assert [r.doc_id for r in mine] == sorted((r.doc_id for r in mine), key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
    assert mixing.mix(df.where("false"), {}, each_source=True).count() == 0


# op10


def brute_secrets(text, rules):
    spans = []
    for k, r in enumerate(rules):
        flags = re.IGNORECASE | re.ASCII if r.pattern.startswith("(?i)") else re.ASCII
        for m in re.finditer(r.pattern.removeprefix("(?i)"), text or "", flags):
            if len(m[r.group]) >= r.least:
                spans.append((m.start(), k, m.end(), r.kind))
    return sorted(spans)


def test_secrets(spark):
    rnd = random.Random(9)
    bits = ["password", "PassWd", "secret:", "token", "api_key", "apikey", "=", " : ", '"', "'", "abcdef12", "x", "é", "𐎀", " ", "\n", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "0123456789abcdef" * 3, "token=token: zzzzzzzzzz", "ghp_" + "a1" * 20, "xoxb-123456789012", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghij.eyJabcdefghij.abcdefghij"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(300)] + ["pad " * 30_000 + "secret=abcdefgh1"]
    rows = odd_rows(rnd, texts)
    want = []
    base = [r.kind for r in secret_scan.RULES if r.base]
    for d, t in rows:
        s = brute_secrets(t, secret_scan.RULES)
        say = lambda x: ",".join(f"{k}:{a}:{z}" for a, _, z, k in x)
        want.append((d, *(sum(x[3] == k for x in s) for k in base), hashlib.sha256(say([x for x in s if x[3] in base]).encode()).hexdigest(), say(s)))
    same(secret_scan.scan_digest(frame(spark, rows)), want)


def test_runs_by_their_least_length(spark):
    rules = (secret_scan.Rule("hex", "[0-9a-f]+", 0, 16), secret_scan.Rule("access", "AKIA[A-Z0-9]+", 0, 8))
    assert secret_scan.run_pattern(secret_scan.RULES[2]) == "[0-9a-f]{32,}" and secret_scan.run_pattern(rules[1]) == "AKIA[A-Z0-9]{4,}"
    texts = ["f" * 15, "x" + "0a" * 8 + "x", "AKIAB", "AKIAAKIA", "AKIAAKIAAKIA abc " + "d" * 40]
    out = {r.doc_id: [(s.start, s.rank, s.stop, s.kind) for s in r.spans] for r in secret_scan.scan(frame(spark, list(enumerate(texts))), rules).collect()}
    assert out == {i: brute_secrets(t, rules) for i, t in enumerate(texts)}


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert q["hex"] == secret_scan.ANY and q["access"] == frozenset([frozenset({"aki", "kia"})])
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and len(q["assign"]) == 6
    rnd = random.Random(1)
    for r in secret_scan.RULES[:4]:
        for _ in range(20):
            text = "".join(rnd.choice(["api_key", "apikey=", "secret: abcdefgh", "AKIA0000", "-----BEGIN PRIVATE KEY-----", "x"]) for _ in range(5))
            if re.search(r.pattern, text):
                held = {text.lower()[i : i + 3] for i in range(len(text))}
                assert any(c <= held for c in q[r.kind])


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("false")
    for run in (suffix_repeats.remove_repeats, debruijn_dedup.remove_repeats, exact_dedup.exact_dedup, exact_dedup.drop_copies, secret_scan.scan_digest):
        assert run(none).count() == 0


# kernels


def test_words_and_anchors():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \t\n\x0b\x1cé ") for _ in range(rnd.randint(0, 40))).encode() for _ in range(200)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    seq = S.as_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        a, z = seq.bounds[i], seq.bounds[i + 1]
        assert [seq.data[x:y].tobytes() for x, y in zip(seq.at[a:z], seq.end[a:z], strict=True)] == t.split()
    raw = bytes(rnd.choice(b"abc") for _ in range(5000))
    seq = S.as_bytes(np.frombuffer(raw, np.uint8), np.array([0, 1500, 1510, 5000]))
    pos, low, high, _ = S.window_anchors(seq, 40, 8)
    starts = [s for a, z in zip(low, high, strict=True) for s in range(a, z + 1)]
    assert starts == [i for a, z in ((0, 1500), (1510, 5000)) for i in range(a, z - 39)]
    place = {s: p - s for p, a, z in zip(pos, low, high, strict=True) for s in range(a, z + 1)}
    by = {}
    for s, o in place.items():
        assert by.setdefault(raw[s : s + 40], o) == o


def test_jaccard_one_group(spark):
    """A large group of near copies around the threshold, with a passage that many other texts share."""
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(120)]
    texts = []
    for _ in range(500):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab[:40])
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [rnd.choice(vocab) for _ in range(rnd.randint(1, 40))]) for _ in range(150)]
    rows = list(enumerate(texts))
    same(jaccard_join.join_components(frame(spark, rows)), brute_components(rows))


def test_jaccard_clash_and_empty(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (4, None)]
    df = frame(spark, rows).withColumn("__rid", F.lit(1)).withColumn("_rid", F.lit(2))
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert jaccard_join.join_components(df.where("false")).count() == 0
    assert jaccard_join.drop_near_copies(df.where("false")).count() == 0
