"""Sampled segmentations against the enumerated distribution; the pipeline against its stages."""

import math
from collections import Counter

import numpy as np
import pytest

from textloom.llm import lattice
from textloom.llm import symbols as S
from textloom.llm.queries import MODEL_FILE
from tests.llm.test_ops import CLASH, frame, near_rows

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocab():
    return lattice.Vocabulary(MODEL_FILE)


def enumerate_all(text, vocab):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    weight = {int(i): w for i, w in zip(vocab.ids, vocab.weights, strict=True)}
    ids = {sp.id_to_piece(i): i for i in weight}
    s = lattice.MARK + text.replace(" ", lattice.MARK)

    def rest(i):
        if i == len(s):
            yield (), 0.0
            return
        for j in range(i + 1, min(len(s), i + vocab.longest) + 1):
            if s[i:j] in ids:
                for r, x in rest(j):
                    yield (ids[s[i:j]], *r), x + weight[ids[s[i:j]]]
        if s[i] not in ids:
            raw = s[i].encode()
            for r, x in rest(i + 1):
                yield (*(int(vocab.byte_ids[b]) for b in raw), *r), x + vocab.byte_weight * len(raw)

    found = dict(rest(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


@pytest.mark.parametrize("text", ["ab c", "a  b", "the\n𐎀é", "x"])
def test_distribution(vocab, text):
    want = enumerate_all(text, vocab)
    n, k = 6000, 3
    chunk = lattice.Chunk([text.encode()] * n, S.mix(np.arange(n).astype(np.uint64)), lattice.Table(vocab))
    got, inside = [[] for _ in range(n)], [Counter(), 0]
    for docs, _, edges, bounds, lp, value, inc in chunk.samples(k):
        ids, ends = chunk.ids(edges, bounds)
        for i, d in enumerate(docs.tolist()):
            seg = tuple(ids[ends[i] : ends[i + 1]].tolist())
            assert abs(lp[i] - want[seg]) < 1e-9 and inc[i] <= 0
            got[d].append((seg, value[i]))
            inside[0][seg] += math.exp(-inc[i])
    for g in got:
        assert len({s for s, _ in g}) == len(g) == min(k, len(want))
        assert [v for _, v in g] == sorted((v for _, v in g), reverse=True)
    first = Counter(g[0][0] for g in got)
    assert max(abs(first[s] / n - math.exp(p)) for s, p in want.items()) < 0.03
    if len(want) > 1:
        second = Counter(g[1][0] for g in got)
        for s, p in want.items():
            expect = sum(math.exp(q + p) / (1 - math.exp(q)) for r, q in want.items() if r != s)
            assert abs(second[s] / n - expect) < 0.03


def test_inclusion_weights_are_unbiased(vocab):
    want = enumerate_all("hello", vocab)
    n = 4000
    chunk = lattice.Chunk([b"hello"] * n, S.mix(np.arange(n).astype(np.uint64)), lattice.Table(vocab))
    total = sum(float(np.exp(lp - inc).sum()) for _, _, _, _, lp, _, inc in chunk.samples(3)) / n
    assert abs(total - 1) < 0.05 and len(want) > 3


def test_rows(spark, vocab):
    texts = ["", None, "a", "hello world", "hello world", "x\n\ny  z ▁", "𐎀" * 50, "no" * 40_000, " lead", "tail "]
    rows = [*enumerate(texts), (None, "hello"), (3, "hello world")]
    df = frame(spark, rows)
    out = lattice.encode_samples(df, MODEL_FILE, 2).collect()
    marked = {i for i, t in rows if lattice.MARK in (t or "")}
    assert marked and all(r.round_trip == (r.doc_id not in marked) for r in out)
    count = Counter(r.doc_id for r in out)
    assert count[0] == count[1] == 1 and count[3] == 4 and count[None] == 2
    by = {}
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        assert vocab.decode(np.array(r.ids, np.int64)) == text.replace(lattice.MARK, " ").encode()
        assert by.setdefault((r.doc_id, r.sample), r.ids) == r.ids
    again = lattice.encode_samples(df.repartition(1).orderBy("text"), MODEL_FILE, 2).collect()
    assert {(r.doc_id, r.sample, r.ids_sha256) for r in again} == {(r.doc_id, r.sample, r.ids_sha256) for r in out}
    other = lattice.encode_samples(df, MODEL_FILE, 2, seed=5).collect()
    assert {r.ids_sha256 for r in other} != {r.ids_sha256 for r in out}
    assert lattice.encode_samples(df.where("false"), MODEL_FILE).count() == 0


def test_decode(spark):
    texts = ["", "a", "hello  world \n x", "𐎀é", " lead", "tail ", None]
    df = frame(spark, list(enumerate(texts)))
    encoded = lattice.encode_samples(df, MODEL_FILE, 2).select("doc_id", "sample", "ids")
    back = lattice.decode_ids(encoded, MODEL_FILE)
    assert back.columns == ["doc_id", "sample", "ids", "text"]
    assert all(r.text == (texts[r.doc_id] or "") for r in back.collect())
    odd = spark.createDataFrame([(1, None), (2, [5, None]), (3, [10**6]), (4, [-1]), (5, [])], "k int, ids array<int>")
    assert {r.k: r.text for r in lattice.decode_ids(odd, MODEL_FILE).collect()} == {1: None, 2: None, 3: None, 4: None, 5: ""}
    assert lattice.decode_ids(odd.where("false"), MODEL_FILE).count() == 0
    with pytest.raises(ValueError):
        lattice.decode_ids(back, MODEL_FILE)


def test_pipeline_of_nothing(spark, tmp_path):
    """The pipeline over empty tables and over rows of nulls."""
    import corpus_pipeline

    docs = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("nulls", [(None,) * 5, (None,) * 5, (1, None, None, None, None)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, docs).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert len(out) == (0 if not rows else 1) and all(r.n_pieces == 0 for r in out)


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline

    rnd = random.Random(11)
    rows = [(d, t) for d, t in near_rows(rnd, 150)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    junk = spark.createDataFrame([(70_000 + i, " ".join(["BUY!!"] * rnd.randint(9, 60)) + " %%% $$$" * i, "en", "src1", 9) for i in range(40)], docs.schema)
    labels = [(d, 1, 0) for d, _ in rows if d is not None] + [(70_000 + i, 0, 0) for i in range(40)]
    docs.union(junk).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cur = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, cur, str(tmp_path))
        if n < 4:
            assert out.columns == cur.columns
        out.write.parquet(str(tmp_path / f"s{n}"))
        cur = spark.read.parquet(str(tmp_path / f"s{n}"))
        kept.append(cur.count())
    assert kept[0] < len(rows) + 40 and kept[1] < kept[0] and kept[2] < kept[1] and kept[2] == kept[3] == kept[4]
    assert cur.where("doc_id >= 70000").count() < 5
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.ids_sha256) for r in run.collect()} == {(r.doc_id, r.ids_sha256) for r in cur.collect()}
    assert CLASH


def test_pipeline_order(spark, tmp_path):
    """Positions after the reread are the ranks of the schedule, though the reader packs files otherwise."""
    import corpus_pipeline
    from textloom.llm import mixing
    from textloom.llm.queries import REST_WEIGHT, WEIGHTS

    rows = [(i, "a b " * (1 + i % 97), "en", [f"src{i % 20}", None, "src0"][min(i % 31, 2)], 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stages = dict(corpus_pipeline.STAGES)
        stages["mixing sources to target weights"](spark, docs, "").write.parquet(str(tmp_path / "mixed"))
        mixed = spark.read.parquet(str(tmp_path / "mixed"))
        assert len(mixed.inputFiles()) > 1
        out = stages["SentencePiece encoding"](spark, mixed, "").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    plan = mixing.mix(docs, WEIGHTS, REST_WEIGHT, each_source=True).orderBy("slot", "row_in_block").collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == [r.doc_id for r in plan]
    assert sorted(r.position for r in out) == list(range(len(rows)))
    empty = docs.where("false")
    stages["mixing sources to target weights"](spark, empty, "").write.parquet(str(tmp_path / "none"))
    assert stages["SentencePiece encoding"](spark, spark.read.parquet(str(tmp_path / "none")), "").count() == 0


def test_query_returns_the_encodings(spark, tmp_path):
    import hashlib

    from textloom.llm import queries

    frame(spark, [(1, "hello world"), (2, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op4_sentencepiece_sampling(spark, str(tmp_path)).collect()
    assert len(out) == 3 and all(len(r.ids) == r.n_pieces for r in out)
    assert all(hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256 for r in out)


def test_rare_units_go_first(vocab, monkeypatch):
    """A full table keeps the units that come again; results are those of a table that is never full."""
    texts = [f"the {i * 7919}x of".encode() for i in range(60)]
    built = []
    build = lattice.build
    monkeypatch.setattr(lattice, "build", lambda code, sizes, v: built.append("".join(map(chr, code.tolist()))) or build(code, sizes, v))
    found = []
    for held in (6_000_000, 150):
        monkeypatch.setattr(lattice, "EDGES_HELD", held)
        table, out = lattice.Table(vocab), []
        built.clear()
        for i in range(0, 60, 3):
            for live, s, edges, bounds, *values in (chunk := lattice.Chunk(texts[i : i + 3], np.arange(3, dtype=S.U), table)).samples(2):
                ids, bounds = chunk.ids(edges, bounds)
                out.append((live.tolist(), s, ids.tolist(), bounds.tolist(), *(v.tolist() for v in values)))
        found.append(out)
    assert found[0] == found[1]
    assert sum(b.count("▁the") for b in built) == 1 and len("".join(built)) > 150


def test_other_operators_drop_the_lattices():
    """What the sampling keeps in a worker goes when a task of another operator trims its memory."""
    table = lattice.unit_table(MODEL_FILE, lattice.THETA)
    S.trim("lattice")
    assert lattice.unit_table(MODEL_FILE, lattice.THETA) is table
    S.trim()
    assert lattice.unit_table.cache_info().currsize == lattice.vocabulary.cache_info().currsize == 0
