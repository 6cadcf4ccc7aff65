"""Scan, postings, index, counts, ranking and streaming on small fixtures."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions.analysis import analyze_text, invalid_vectors, term_vectors, with_tokens
from textloom.functions.registration import register
from textloom.operators import bitmaps as B
from textloom.operators import postings as P
from textloom.operators.index import Index, Options
from textloom.operators.ranking import Bm25, Statistics, rank
from textloom.plans.predicate import matches, text_matches
from textloom.plans.query import parse_query, simplify
from textloom.streaming.sink import append_stream

G4 = ["", "a", "b", "c", "a b", "b a", "a a", "a b c", "alphabet", None]
# Ids that each query matches.
GOLDEN = {
    "a AND b": {4, 5, 7}, "a OR b": {1, 2, 4, 5, 6, 7}, "a OR (a AND c)": {1, 4, 5, 6, 7}, "(a OR b) AND (b OR c)": {2, 4, 5, 7}, '"a b"': {4, 7},
    '"a a"': {6}, "NOT a": {0, 2, 3, 8}, "a AND NOT b": {1, 6}, "a* AND NOT b": {1, 6, 8}, "a AND missing": set(), "": set(), 'NOT ""': set(range(9)),
}
UNICODE = ["alpha beta can't 32.3", "ALPHA BETA a_b a:b a.b", "CAFÉ café Σ ς K", "Straße STRASSE ẞ ß", "", None, "alpha " + "gamma " * 400, "µ ﬁ 日本語 x"]


@pytest.fixture(scope="module")
def g4(spark):
    return spark.createDataFrame(list(enumerate(G4)), "doc_id long, text string")


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_golden_scan_and_postings(g4):
    rows, docs = P.build_postings(g4)
    rows, docs = rows.cache(), docs.cache()
    for query, want in GOLDEN.items():
        assert ids(g4.where(matches("text", query))) == want, query
        assert ids(P.search(rows, docs, simplify(parse_query(query).root))) == want, query
    assert g4.where("doc_id = 9").select(matches("text", "NOT a").alias("m")).first().m is None


def test_unicode_paths_agree(spark):
    df = spark.createDataFrame(list(enumerate(UNICODE)), "doc_id long, text string")
    found = {r.doc_id: r.tokens for r in with_tokens(df).collect()}
    assert found == {i: None if t is None else analyze_text(t) for i, t in enumerate(UNICODE)}
    assert ids(df.where(matches("text", '"CAFÉ café"'))) == {2}


def test_ascii_pairs_have_one_analysis(spark):
    chars = [chr(c) for c in range(1, 128)]
    texts = [f"x{a}{b}y" for a in chars for b in chars]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in with_tokens(df).collect():
        assert r.tokens == analyze_text(texts[r.doc_id]), repr(texts[r.doc_id])


def test_document_limit(spark):
    df = spark.createDataFrame([(1, "a" * (1 << 20) + " b")], "doc_id long, text string")
    with pytest.raises(Exception, match="document bytes"):
        with_tokens(df).collect()


def test_random_queries(spark):
    r = random.Random(7)
    words = ["a", "b", "ab", "c", "delta", "x", "y"]
    docs = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(120)]

    def query(depth):
        k = r.random()
        if depth == 0 or k < 0.35:
            return r.choice([r.choice(words), r.choice(words)[0] + "*", '"' + " ".join(r.choice(words) for _ in range(r.randint(1, 3))) + '"'])
        if k < 0.5:
            return f"NOT ({query(depth - 1)})"
        return f"({query(depth - 1)}) {r.choice(['AND', 'OR'])} ({query(depth - 1)})"

    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows, lengths = P.build_postings(df)
    rows, lengths = rows.cache(), lengths.cache()
    for _ in range(12):
        q = query(3)
        root = parse_query(q).root
        want = {i for i, t in enumerate(docs) if text_matches(t.split(), root)}
        assert ids(P.search(rows, lengths, simplify(root))) == want, q
        assert ids(df.where(matches("text", q))) == want, q


def test_vectors_and_algebra(spark, g4):
    rows, docs = P.build_postings(g4)
    assert invalid_vectors(rows, docs).count() == 0
    assert invalid_vectors(rows.where("term <> 'a'"), docs).count() == 5
    a, b = P.of_term(rows, "a"), P.of_term(rows, "b")
    assert ids(P.both(a, b)) == {4, 5, 7} and ids(P.either(a, b)) == {1, 2, 4, 5, 6, 7}
    assert ids(P.without(a, b)) == {1, 6} and ids(P.complement(docs, a)) == {0, 2, 3, 8}
    assert ids(P.phrase_by_join(rows, ("a", "b", "c"))) == {7}
    assert P.expand_prefix(P.dictionary(rows), "a") == ["a", "alphabet"]
    with pytest.raises(ValueError):
        P.expand_prefix(P.dictionary(rows), "a", limit=1)
    bits = B.term_bitmaps(rows)
    assert [f(bits, ["a", "b"]).first().n for f in (B.count_all_of, B.count_any_of)] == [3, 6]
    assert B.count_without(bits, "a", "b").first().n == 2 and B.count_all_of(bits, ["a", "zz"]).first().n == 0


def test_lifecycle(spark, g4, tmp_path):
    index = Index.create(spark, str(tmp_path / "ix"))
    assert index.append(g4, batch="one") == index.append(g4, batch="one") == 1
    more = spark.createDataFrame([(20, "a b"), (21, "zulu")], "doc_id long, text string")
    index.append(more)

    def state(live):
        for query in ("a AND b", "NOT a", '"a b"', "a* AND NOT b"):
            want = {i for i, t in live.items() if t is not None and text_matches(analyze_text(t), parse_query(query).root)}
            for use_cover in (False, True):
                index.options = Options(use_cover=use_cover)
                source = spark.createDataFrame(list(live.items()), "doc_id long, text string")
                assert ids(index.search(query, source)) == want, query
                assert index.count(query, source) == len(want)

    live = dict(enumerate(G4)) | {20: "a b", 21: "zulu"}
    state(live)
    assert index.count("a") == 6 and index.explain("a")["count_from_dictionary"]
    index.delete(spark.createDataFrame([(4,), (99,)], "doc_id long"))
    del live[4]
    state(live)
    assert index.count("a") == 5
    index.update(spark.createDataFrame([(21, "a a")], "doc_id long, text string"))
    live[21] = "a a"
    state(live)
    done = index.compact()
    assert (done.segments_before, done.segments_after) == (3, 1) and done.removed == 2
    assert index.vacuum() and len(index.manifest()["segments"]) == 1
    state(live)
    assert index.compact(small=5).segments_after == 1


def test_empty_index(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "empty"))
    assert index.search("a").count() == 0 and index.count("NOT a") == 0
    assert index.rank("a").count() == 0 and index.statistics().first().average_length == 1.0


def bm25(docs, terms, n=None, avg=None, df=None):
    n = n or len(docs)
    avg = avg or (sum(map(len, docs.values())) / n or 1.0)
    out = {}
    for i, t in docs.items():
        s = 0.0
        for w in sorted(terms):
            tf = t.count(w)
            d = df[w] if df else sum(w in x for x in docs.values())
            s += math.log1p((n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        out[i] = s
    return out


def test_ranking(spark):
    r = random.Random(3)
    docs = {i: [r.choice(["a", "b", "c", "delta"]) for _ in range(r.randint(0, 12))] for i in range(90)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    rows, lengths = P.build_postings(df)
    rows, lengths = rows.cache(), lengths.cache()
    for query, terms in (("a", {"a"}), ("a OR delta", {"a", "delta"}), ('"a b"', {"a", "b"}), ("NOT NOT a", {"a"}), ("de*", {"delta"}), ("NOT a", set())):
        scores = bm25(docs, terms)
        hits = [i for i, t in docs.items() if text_matches(t, parse_query(query).root)]
        want = sorted(hits, key=lambda i: (-scores[i], i))[3:11]
        got = rank(rows, lengths, query, limit=8, offset=3).collect()
        assert [x.doc_id for x in got] == want
        assert all(abs(x.score - scores[x.doc_id]) < 1e-12 for x in got)
    odd = rank(rows, lengths, "a", 5, eligible=df.where("doc_id % 2 = 1")).collect()
    assert all(x.doc_id % 2 for x in odd) and len(odd) == 5
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    r1, d1 = P.build_postings(one)
    fresh = Statistics(0, 0, {})
    assert abs(rank(r1, d1, "a", statistics=fresh).first().score - math.log(2)) < 1e-12
    for bad in (dict(k1=0), dict(k1=math.inf), dict(b=-0.1), dict(b=1.1)):
        with pytest.raises(ValueError):
            Bm25(**bad)
    with pytest.raises(ValueError):
        Statistics(1, 1, {"a": 2})


def test_sql_functions(spark, g4):
    register(spark)
    g4.createOrReplaceTempView("g4")
    assert {r.doc_id for r in spark.sql("SELECT doc_id FROM g4 WHERE search_match(text, 'a AND NOT b')").collect()} == {1, 6}
    row = spark.sql("SELECT query_valid(parse_query('a OR b')) AS v, query_valid(X'00') AS w, tokenize('Foo bar') AS t").first()
    assert (row.v, row.w, row.t) == (True, False, ["foo", "bar"])
    assert [(r.pos, r.term) for r in spark.sql("SELECT * FROM tokenize_table('b A')").collect()] == [(0, "b"), (1, "a")]


def test_counts_fixture(spark):
    rows = [(i, "beta" if i % 5 == 0 else "alpha alpha beta") for i in range(2400)] + [(9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.where(matches("text", "alpha")).count() == 1920
    assert df.where(matches("text", "alpha AND beta")).count() == 1920
    assert df.where(matches("text", "beta")).count() == 2400
    assert df.where(matches("text", "alpha") & (F.col("doc_id") >= 2000)).count() == 320


def test_streaming_append(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(str(src))
    index = Index.create(spark, str(tmp_path / "ix"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    for _ in range(2):
        append_stream(stream, index, str(tmp_path / "cp"), merge_at=2).trigger(availableNow=True).start().awaitTermination()
        if index.manifest()["next"] == 2:
            spark.createDataFrame([(3, "a d")], "doc_id long, text string").write.mode("append").parquet(str(src))
    assert ids(index.search("a")) == {1, 3} and len(index.manifest()["segments"]) == 1


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert not any(re.match("op\\d", n) for n in __import__("textloom.queries", fromlist=["x"]).queries())


def test_appended_again(spark, tmp_path):
    """A document that comes again replaces its older version, in one commit, however often."""
    index = Index.create(spark, str(tmp_path / "ix"))
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.append(docs((1, "alpha beta"), (2, "beta")))
    before = index.generation()
    index.append(docs((1, "gamma delta"), (3, "x"), (2, None)))
    assert index.generation() == before + 1
    assert ids(index.search("alpha AND gamma")) == set() and ids(index.search("NOT zz")) == {1, 3}
    assert index.count("NOT zz") == 2 and index.count("beta") == 0 and index.count("gamma") == 1
    assert index.explain("gamma")["count_fallback"] == "documents are hidden"
    assert index.compact().documents == 2 and index.explain("gamma")["count_fallback"] is None
    with pytest.raises(ValueError, match="repeat an id"):
        index.append(docs((7, "a"), (7, "b")))
    assert index.count("NOT zz") == 2
    with pytest.raises(ValueError, match="source"):
        Index(spark, index.path, Options(use_index=False)).search("a")


def test_snapshot_and_writers(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "ix"))
    index.append(spark.createDataFrame([(i, "a" if i % 2 else "a b") for i in range(10)], "doc_id long, text string"))
    view = index.snapshot()
    index.delete(spark.createDataFrame([(i,) for i in range(5)], "doc_id long"))
    assert ids(view.search("a")) == set(range(10)) and ids(index.search("a")) == set(range(5, 10)) and view.count("a") == 10
    # a second writer of the same generation fails and leaves everything as it was
    with pytest.raises(RuntimeError, match="committed first"):
        index._commit(view.manifest, index.generation())
    assert ids(index.search("a")) == set(range(5, 10))
    assert not index.vacuum(grace_seconds=3600) and len(index.vacuum()) == 2


def test_merge_by_tiers(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "ix"))
    live = {}
    for i, size in enumerate((40, 1, 2, 30, 3)):
        rows = {100 * i + j: "a b" if j % 2 else "b" for j in range(size)}
        live |= rows
        index.append(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    index.delete(spark.createDataFrame([(200,), (3,)], "doc_id long"))
    del live[200], live[3]
    done = index.merge(at_least=4, most=3)
    assert (done.segments_before, done.segments_after, done.documents, done.removed) == (5, 3, 5, 1)
    assert sorted(s["documents"] for s in index.manifest()["segments"]) == [5, 30, 40]
    assert ids(index.search("b")) == set(live) and ids(index.search("a")) == {d for d, t in live.items() if "a" in t}
    assert index.merge(at_least=4).segments_after == 3
    index.append(spark.createDataFrame([(3, "a again")], "doc_id long, text string"))
    assert 3 in ids(index.search("again"))


def test_limits_on_every_path(spark):
    long = spark.createDataFrame([("a " * (1 << 20),), ("é" * (3 << 19) + " 日",)], "text string")
    for row in range(2):
        one = spark.createDataFrame([long.collect()[row]], "text string")
        for run in (lambda d: with_tokens(d), lambda d: d.where(matches("text", "a")), lambda d: d.where(matches("text", "NOT a"))):
            with pytest.raises(Exception, match="document bytes"):
                run(one).collect()
    with pytest.raises(ValueError, match="tokens"):
        with_tokens(spark.createDataFrame([("a", 1)], "text string, Tokens int"))


def test_analysis_scans_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "日本")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    found = with_tokens(spark.read.parquet(str(tmp_path / "t")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and len(found.collect()) == 2
    both = spark.read.parquet(str(tmp_path / "t")).where(matches("text", "a") & matches("text", "NOT b"))
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and ids(both) == {1}


def test_bitmaps_of_any_id(spark):
    some = [-(2**40), -32769, -32768, -5, -1, 0, 1, 3, 32767, 32768, 2**40]
    rows = spark.createDataFrame([(t, d) for d in some for t in (["x", "y"] if d % 2 else ["x"])], "term string, doc_id long")
    bits = B.term_bitmaps(rows)
    odd = sum(d % 2 for d in some)
    assert B.count_any_of(bits, ["x"]).first().n == len(some) and B.count_all_of(bits, ["x", "y"]).first().n == odd
    assert B.count_without(bits, "x", "y").first().n == len(some) - odd


def test_version(spark):
    from textloom import VERSION

    register(spark)
    assert spark.sql("SELECT textloom_version() AS v").first().v == VERSION
