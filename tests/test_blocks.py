"""Blocks of postings, and what the index shuffles, reads and sends."""

import random

import numpy as np
import pyarrow as pa
import pytest

from textloom import queries as Q
from textloom.functions.analysis import analyze_text, term_vectors, with_tokens
from textloom.operators import blocks as K
from textloom.operators import index as X
from textloom.operators.index import Index
from textloom.streaming import sink


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wanted(docs):
    return {(t, i): [p for p, w in enumerate(ws) if w == t] for i, ws in docs.items() for t in set(ws)}


@pytest.mark.parametrize("chunk", [7, 1 << 21])
def test_blocks_round_trip(monkeypatch, chunk):
    """Any 64-bit ids, empty and null lists, frequent terms, chunks of many sizes."""
    monkeypatch.setattr(K, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(K, "CHUNK_BYTES", chunk)
    r = random.Random(5)
    ids = [-(2**63), 2**63 - 1, -1, 0, *r.sample(range(-(2**40), 2**40), 150)]
    docs = {i: ["a"] * r.randint(0, 400) + [r.choice("abcd") for _ in range(r.randint(0, 9))] for i in ids} | {7: None, 8: []}
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "tokens": t} for i, t in docs.items()], pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    made = pa.Table.from_batches(K._from_tokens(iter([batch.slice(0, 60), batch.slice(60)])))
    docs[7] = []
    terms = made.filter(made["term"].is_valid()).select(["term", "doc_id", "block"]).combine_chunks()
    back = [x for b in K._to_postings(iter(terms.to_batches())) for x in b.to_pylist()]
    assert {(x["term"], x["doc_id"]): x["positions"] for x in back} == wanted(docs) and len(back) == len(wanted(docs))
    assert all(x["tf"] == len(x["positions"]) for x in back)
    long = made.filter(made["lengths"].is_valid()).select(["doc_id", "lengths"]).combine_chunks()
    assert {x["doc_id"]: x["dl"] for b in K._to_lengths(iter(long.to_batches())) for x in b.to_pylist()} == {i: len(t) for i, t in docs.items()}
    again = pa.RecordBatch.from_pylist([{k: x[k] for k in ("term", "doc_id", "positions")} for x in r.sample(back, len(back))], pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))]))
    terms = pa.Table.from_batches(K._from_postings(iter([again]))).select(["term", "doc_id", "block"]).combine_chunks()
    assert {(x["term"], x["doc_id"]): x["positions"] for b in K._to_postings(iter(terms.to_batches())) for x in b.to_pylist()} == wanted(docs)
    if chunk > 7:
        assert terms.num_rows < len(back) / 8


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**63, 2**64 - 1], np.uint64)
    data, at = K.varints(values)
    back, ends = K.from_varints(data)
    assert (back == values).all() and (ends + 1 == at[1:]).all() and at[0] == 0


def test_vectors_without_shuffle(spark):
    rows = [(i, "a b a" if i % 2 else "c") for i in range(40)] + [(50, None), (51, "")]
    found = term_vectors(with_tokens(spark.createDataFrame(rows, "doc_id long, text string")))
    assert "Exchange" not in plan(found)
    assert {(r.term, r.doc_id): r.positions for r in found.collect()} == wanted({i: analyze_text(t or "") for i, t in rows})
    twice = term_vectors(with_tokens(spark.createDataFrame([(1, "a b"), (1, "b b"), (2, "b"), (None, "x"), (None, "x y")], "doc_id long, text string")))
    assert sorted((r.doc_id or 0, r.term, r.tf, r.positions) for r in twice.collect()) == [(0, "x", 2, [0, 0]), (0, "y", 1, [1]), (1, "a", 1, [0]), (1, "b", 3, [0, 1, 1]), (2, "b", 1, [0])]


def test_tokens_once(spark):
    found = with_tokens(spark.createDataFrame([("a",)], "text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1 and plan(found).count("regexp_extract_all") == 1


def test_append_reads_once(spark, tmp_path):
    """The texts of a first append are read and analysed once."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    spark.createDataFrame([(i, "a b a") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t")).mapInArrow(count, "doc_id long, text string")
    index = Index.create(spark, str(tmp_path / "ix"))
    index.append(docs)
    assert read.value == 50 and index.count("a") == 50
    name = index.manifest()["segments"][0]["name"]
    assert sorted(index.folder._fs.listStatus(index.folder._path(f"{index.path}/{name}"))[i].getPath().getName() for i in range(3)) == ["dictionary", "docs", "postings"]
    with pytest.raises(Exception, match="no id"):
        index.append(spark.createDataFrame([(None, "a")], "doc_id long, text string"))


def test_postings_are_differences(spark, tmp_path):
    """Where a Parquet dictionary of ids overflows, a posting has still not a whole id; all postings are read back."""
    import pyarrow.parquet as pq

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.dictionary.page.size", "1024")
    try:
        index = Index.create(spark, str(tmp_path / "ix"))
        index.append(spark.range(0, 8000, 2).selectExpr("id AS doc_id", "'a b a' AS text"))
        index.append(spark.createDataFrame([(-(2**63), "ä a"), (2**63 - 1, "a")], "doc_id long, text string"))
    finally:
        conf.unset("parquet.dictionary.page.size")
    name = index.manifest()["segments"][0]["name"]
    groups = [m.row_group(i) for f in (tmp_path / "ix" / name / "postings").glob("*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 8000
    assert sum(g.column(1).total_uncompressed_size for g in groups) < 2 * 8000
    docs = {i: ["a", "b", "a"] for i in range(0, 8000, 2)} | {-(2**63): ["ä", "a"], 2**63 - 1: ["a"]}
    assert {(r.term, r.doc_id): r.positions for r in index.postings().collect()} == wanted(docs)


def test_hidden_are_sent(spark, tmp_path, monkeypatch):
    """A bounded number of hidden documents does not shuffle the postings; more give the same."""
    index = Index.create(spark, str(tmp_path / "ix"))
    index.append(spark.createDataFrame([(i, "a b" if i % 3 else "b") for i in range(30)], "doc_id long, text string"))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long"))
    index.append(spark.createDataFrame([(1, "z"), (0, "a")], "doc_id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = {i for i in range(3, 30, 2) if i % 3} | {0}
        for sent in (2_000_000, 0):
            monkeypatch.setattr(X, "HIDDEN_SENT", sent)
            assert ("BroadcastHashJoin" in plan(index.postings())) == bool(sent)
            assert {r.doc_id for r in index.search("a").collect()} == want
        old = X.Snapshot(index, {k: v for k, v in index.manifest().items() if k != "hidden"})
        assert {r.doc_id for r in old.search("a").collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(index.manifest()["hidden"].values()) == 16
    index.compact()
    assert index.manifest()["hidden"] == {} and {r.doc_id for r in index.search("a").collect()} == want


def test_stream_of_distinct_ids(spark, tmp_path, monkeypatch):
    """A batch whose ids are distinct is not shuffled; of repeated ids the greatest text is kept."""
    plans = []
    put = Index.append
    monkeypatch.setattr(sink.Index, "append", lambda self, docs, *a, **k: plans.append(plan(docs)) or put(self, docs, *a, **k))
    for name, rows in (("one", [(1, "a"), (2, "b")]), ("two", [(1, "a"), (1, "z"), (2, None)])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name))
        index = Index.create(spark, str(tmp_path / f"ix{name}"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / name))
        sink.append_stream(stream, index, str(tmp_path / f"cp{name}")).trigger(availableNow=True).start().awaitTermination()
        assert {r.doc_id for r in index.search("z" if name == "two" else "a OR b").collect()} == ({1} if name == "two" else {1, 2})
    assert "Aggregate" not in plans[0] and "Aggregate" in plans[1]


def test_index_vs_scan_analyses_once(spark, tmp_path):
    """The scans of all queries share one analysis; queries without a hit have a row."""
    spark.createDataFrame([(0, "the of"), (1, "of the"), (2, None), (3, "und")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = Q.index_vs_scan(spark, str(tmp_path))
    assert plan(found).count("regexp_extract_all") == 1
    assert {r.query: r[1:] for r in found.collect()} == {"match_term": (2, 2, 0), "match_phrase": (1, 1, 0), "match_nested": (2, 2, 0), "match_prefix_not": (0, 0, 0)}
