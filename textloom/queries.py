"""The catalogue: one query for each operator over the documents table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.analysis import WORD, padded, term_vectors, with_tokens
from textloom.operators import bitmaps as B
from textloom.operators import postings as P
from textloom.operators.index import Index, Options
from textloom.operators.ranking import Statistics
from textloom.plans.predicate import as_query, matches, over_norm
from textloom.plans.query import cover_of, simplify
from textloom.sources.tables import scratch_path, table, union_all

#: Predicates by name: the query, and its SQL over n (the padded tokens).
PREDICATES = {
    "match_term": ("the", "contains(n, ' the ')"),
    "match_prefix": ("eau*", "contains(n, ' eau')"),
    "match_phrase": ('"of the"', "contains(n, ' of the ')"),
    "match_phrase_repeat": ('"the the"', "contains(n, ' the the ')"),
    "match_and": ("the AND in", "contains(n, ' the ') AND contains(n, ' in ')"),
    "match_or": ("und OR que", "contains(n, ' und ') OR contains(n, ' que ')"),
    "match_not": ("NOT the", "NOT contains(n, ' the ')"),
    "match_nested": ('(the OR und) AND NOT ("of the" OR sttind)', "(contains(n, ' the ') OR contains(n, ' und ')) AND NOT (contains(n, ' of the ') OR contains(n, ' sttind '))"),
    "match_prefix_not": ("th* AND NOT the", "contains(n, ' th') AND NOT contains(n, ' the ')"),
    "match_empty": ("", "false"),
    "match_not_empty": ('NOT ""', "true"),
    "match_case_folded": ('"OF The"', "contains(n, ' of the ')"),
}
RANKS = {
    "bm25_term": dict(query="the"),
    "bm25_or_topk": dict(query="the OR of", limit=25),
    "bm25_prefix": dict(query="retr*", limit=20),
    "bm25_phrase": dict(query='"of the"', limit=15),
    "bm25_offset": dict(query="the AND in", limit=10, offset=7),
    "bm25_filtered": dict(query="the OR und", limit=12),
    "bm25_zero_score_not": dict(query="NOT the", limit=10),
    "bm25_double_not": dict(query="NOT NOT und", limit=10),
    "bm25_supplied_statistics": dict(query="the", limit=10, statistics=Statistics(500_000, 200_000_000, {"the": 1_000})),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return P.build_postings(documents(spark, sf_dir))


def match_query(source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = simplify(as_query(source).root)
        rows = with_tokens(documents(spark, sf_dir)).select("doc_id", padded(F.col("tokens")).alias("norm"))
        return rows.where(over_norm(root, F.col("norm"))).select("doc_id")

    return run


_INDEXES: dict[tuple[str, str], Index] = {}


def shared_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's documents, built once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key], _ = new_index(spark, sf_dir)
    return _INDEXES[key]


def index_query(source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shared_index(spark, sf_dir).search(source)

    return run


def rank_query(name: str, query: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        eligible = documents(spark, sf_dir).where("lang = 'en'") if name == "bm25_filtered" else None
        out = shared_index(spark, sf_dir).rank(query, eligible=eligible, **options)
        return out.select("doc_id", F.round("score", 9).alias("score"))

    return run


def tokenize_docs(spark, sf_dir):
    return with_tokens(documents(spark, sf_dir)).select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def doc_length(spark, sf_dir):
    return with_tokens(documents(spark, sf_dir)).select("doc_id", F.size("tokens").alias("dl"), padded(F.col("tokens")).alias("norm"))


def term_vectors_query(spark, sf_dir):
    rows = term_vectors(with_tokens(documents(spark, sf_dir)).select("doc_id", "tokens"))
    return rows.select("doc_id", "term", "tf", F.array_join("positions", ",").alias("positions"))


def doc_freq(spark, sf_dir):
    return P.dictionary(built(spark, sf_dir)[0])


def stats(spark, sf_dir):
    return P.corpus_stats(built(spark, sf_dir)[1]).withColumn("average_length", F.round("average_length", 9))


def multi_key_and(spark, sf_dir):
    return documents(spark, sf_dir).where(matches("text", "the") & matches("text", "NOT of")).select("doc_id")


def residual_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(matches("text", "the OR und") & (F.col("lang") == "en") & (F.col("doc_id") > 100)).select("doc_id", "lang")


def counts(spark, sf_dir):
    """Counts over one predicate: plain, distinct, filtered, and ids in order."""
    hits = documents(spark, sf_dir).where(matches("text", "the AND in"))
    return hits.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("source").alias("sources"),
        F.count_if(F.col("lang") == "en").alias("english"),
        F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("ids"),
    )


def count_by_source(spark, sf_dir):
    return documents(spark, sf_dir).where(matches("text", "the AND NOT of")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def postings_and(spark, sf_dir):
    rows, _ = built(spark, sf_dir)
    return P.both(P.of_term(rows, "the"), P.of_term(rows, "in"))


def postings_or(spark, sf_dir):
    rows, _ = built(spark, sf_dir)
    return P.either(P.of_term(rows, "und"), P.of_term(rows, "que"))


def postings_andnot(spark, sf_dir):
    rows, _ = built(spark, sf_dir)
    return P.without(P.of_term(rows, "the"), P.of_term(rows, "in"))


def postings_not(spark, sf_dir):
    rows, docs = built(spark, sf_dir)
    return P.complement(docs, P.of_term(rows, "the"))


def phrase_positional_join(spark, sf_dir):
    return P.phrase_by_join(built(spark, sf_dir)[0], ("of", "the"))


def prefix_dictionary(spark, sf_dir):
    words = P.dictionary(built(spark, sf_dir)[0])
    return words.where(F.startswith("term", F.lit("retr")))


def cover_candidates(spark, sf_dir):
    rows, docs = built(spark, sf_dir)
    cover = cover_of(simplify(as_query("sttind AND (the OR of)").root))
    return P.candidates(rows, docs, cover.kind, cover.terms)


def bitmap_counts(spark, sf_dir):
    bits = B.term_bitmaps(built(spark, sf_dir)[0].where(F.col("term").isin("the", "in")))
    named = [("and", B.count_all_of(bits, ["the", "in"])), ("or", B.count_any_of(bits, ["the", "in"])), ("andnot", B.count_without(bits, "the", "in"))]
    out = [df.select(F.lit(k).alias("op"), F.col("n").cast("long").alias("n")) for k, df in named]
    return out[0].union(out[1]).union(out[2])


def new_index(spark: SparkSession, sf_dir: str, options: Options | None = None) -> tuple[Index, DataFrame]:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = Index.create(spark, scratch_path(spark, "index"), options)
    index.append(docs)
    return index, docs


def index_vs_scan(spark, sf_dir):
    """Ids by the index and by the scan for several queries, and whether they agree."""
    index, docs = new_index(spark, sf_dir)
    names = ("match_term", "match_phrase", "match_nested", "match_prefix_not")
    a = union_all([index.search(PREDICATES[n][0]).select(F.lit(n).alias("query"), "doc_id", F.lit(1).alias("by_index")) for n in names])
    # one analysis of the texts serves the scans of all queries
    rows = with_tokens(docs).select("doc_id", padded(F.col("tokens")).alias("norm"))
    held = [F.when(over_norm(simplify(as_query(PREDICATES[n][0]).root), F.col("norm")), F.lit(n)) for n in names]
    b = rows.select("doc_id", F.explode(F.array_compact(F.array(*held))).alias("query")).withColumn("by_scan", F.lit(1))
    both = a.join(b, ["query", "doc_id"], "full").groupBy("query").agg(F.count("by_index").alias("by_index"), F.count("by_scan").alias("by_scan"), F.count_if(F.col("by_index").isNull() | F.col("by_scan").isNull()).alias("differ"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("by_index", "by_scan", "differ")]
    return spark.createDataFrame([(n,) for n in names], "query string").join(both, "query", "left").select("query", *zero)


def count_term(spark, sf_dir):
    index, _ = new_index(spark, sf_dir)
    return spark.createDataFrame([(q, index.count(q)) for q in ("the", "sttind", "missingword", "the AND in", "NOT the")], "query string, n long")


def delete_then_search(spark, sf_dir):
    index, docs = new_index(spark, sf_dir)
    index.delete(docs.where("doc_id % 3 = 0"))
    return index.search("the OR NOT in")


def update_then_search(spark, sf_dir):
    index, docs = new_index(spark, sf_dir)
    index.update(docs.where("doc_id % 5 = 0").select("doc_id", F.lit("zulu the zulu").alias("text")))
    return index.search('"zulu the" OR in')


def compact_then_search(spark, sf_dir):
    index, docs = new_index(spark, sf_dir)
    index.delete(docs.where("doc_id % 4 = 1"))
    index.append(docs.where("doc_id % 4 = 1").select("doc_id", F.concat(F.lit("zulu "), "text").alias("text")))
    index.compact()
    index.vacuum()
    return index.search("zulu AND the").withColumn("segments", F.lit(len(index.manifest()["segments"])))


def append_then_rank(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = Index.create(spark, scratch_path(spark, "index"))
    index.append(docs.where("doc_id % 2 = 0"))
    index.append(docs.where("doc_id % 2 = 1"))
    return index.rank("the AND in", limit=20).select("doc_id", F.round("score", 9).alias("score"))


def reappend_then_search(spark, sf_dir):
    """Documents that are appended again replace their older versions."""
    index, docs = new_index(spark, sf_dir)
    index.append(docs.where("doc_id % 3 = 0").select("doc_id", F.lit("zulu once").alias("text")))
    index.append(docs.where("doc_id % 6 = 0").select("doc_id", F.lit("zulu twice").alias("text")))
    return index.search('"zulu twice" OR (the AND NOT zulu) OR NOT in')


def update_in_one_commit(spark, sf_dir):
    index, docs = new_index(spark, sf_dir)
    before = index.generation()
    index.update(docs.where("doc_id % 5 = 0").select("doc_id", F.lit("zulu").alias("text")))
    return index.search("zulu").withColumn("commits", F.lit(index.generation() - before))


def merge_then_search(spark, sf_dir):
    """Six segments of different sizes, one with deletions; the four smallest are merged."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = Index.create(spark, scratch_path(spark, "index"))
    for i in range(5):
        index.append(docs.where(f"doc_id % 16 = {i}"))
    index.append(docs.where("doc_id % 16 > 4"))
    index.delete(docs.where("doc_id % 16 = 2 AND doc_id % 3 = 0"))
    index.merge(at_least=4, most=4)
    return index.search("the OR NOT in").withColumn("segments", F.lit(len(index.manifest()["segments"])))


def snapshot_during_commit(spark, sf_dir):
    """A snapshot keeps answering as of its generation while commits go on."""
    index, docs = new_index(spark, sf_dir)
    view = index.snapshot()
    index.delete(docs.where("doc_id % 2 = 0"))
    old, new = view.search("the").select(F.lit("old").alias("view"), "doc_id"), index.search("the").select(F.lit("new").alias("view"), "doc_id")
    return old.union(new)


def stream_then_search(spark, sf_dir):
    """The documents through the streaming sink, then a search."""
    from textloom.streaming.sink import append_stream

    folder = scratch_path(spark, "stream")
    index = Index.create(spark, f"{folder}/index")
    # a pattern, as a stream from a plain path must be of a folder
    stream = spark.readStream.schema(documents(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parque[t]")
    append_stream(stream.select("doc_id", "text"), index, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return index.search("the AND NOT of")


def null_on_null(spark, sf_dir):
    """How often a predicate is true, false and null where every seventh text is null and every eighth empty."""
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("text"))
    hit = documents(spark, sf_dir).select(matches(text, "NOT the").alias("hit"))
    return hit.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def corpus_search(name: str, id_cols: list[str], source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).where(matches("text", source)).select(*id_cols)

    return run


def search_join_labels(spark, sf_dir):
    """Matches joined with another table, as any relation."""
    hits = documents(spark, sf_dir).where(matches("text", "the OR der")).select("doc_id", "lang")
    return hits.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


def top_per_lang(spark, sf_dir):
    """The three documents of each language with most occurrences of a term."""
    from pyspark.sql import Window

    rows, _ = built(spark, sf_dir)
    hits = rows.where("term = 'en'").select("doc_id", "tf").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("tf"), "doc_id"))
    return hits.withColumn("nth", nth).where("nth <= 3").select("lang", "doc_id", "tf", "nth")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        tokenize_docs, doc_length, doc_freq, multi_key_and, residual_filter, counts, count_by_source, postings_and, postings_or,
        postings_andnot, postings_not, phrase_positional_join, prefix_dictionary, cover_candidates, bitmap_counts, index_vs_scan,
        reappend_then_search, update_in_one_commit, merge_then_search, snapshot_during_commit, stream_then_search, null_on_null,
        count_term, delete_then_search, update_then_search, compact_then_search, append_then_rank, search_join_labels, top_per_lang,
    )
    out = {name: match_query(q) for name, (q, _) in PREDICATES.items()}
    out |= {f"index_{name}": index_query(q) for name, (q, _) in PREDICATES.items()}
    out |= {name: rank_query(name, **options) for name, options in RANKS.items()}
    out |= {f.__name__: f for f in plain}
    out |= {"term_vectors": term_vectors_query, "corpus_stats": stats}
    out |= {"search_conversations": corpus_search("conversations", ["conv_id", "turn"], "the AND NOT of"), "search_benchmark": corpus_search("benchmark", ["item_id"], '"of the" OR th*')}
    return out


# SQL

def _tokens(name: str = "documents", columns: str = "doc_id, lang, source") -> str:
    rx = WORD.replace("'", "''")
    return f"t AS (SELECT {columns}, regexp_extract_all(lower(text), '{rx}') AS w FROM {name} WHERE text IS NOT NULL), d AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS n FROM t)"


_FLAT = "f AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t), p AS (SELECT doc_id, term, count(*) AS tf FROM f GROUP BY ALL), s AS (SELECT count(*) AS n, CASE WHEN sum(len(w)) > 0 THEN sum(len(w)) / count(*) ELSE 1.0 END AS avg FROM t), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
_SCORE = "ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / s.avg))"


def _rank_sql(match: str, terms: str, limit: int, offset: int = 0, eligible: str = "true") -> str:
    return f"""WITH {_tokens()}, {_FLAT},
sc AS (SELECT p.doc_id, sum({_SCORE}) AS score FROM p JOIN df USING (term) JOIN t ON t.doc_id = p.doc_id CROSS JOIN s WHERE {terms} GROUP BY p.doc_id)
SELECT d.doc_id, round(coalesce(score, 0), 9) AS score FROM d LEFT JOIN sc USING (doc_id) WHERE ({match}) AND {eligible}
ORDER BY round(coalesce(score, 0), 9) DESC, d.doc_id LIMIT {limit} OFFSET {offset}"""


def oracle_sql() -> dict[str, str]:
    has = lambda x: f"contains(n, ' {x} ')"
    t, flat = _tokens(), f"WITH {_tokens()}, {_FLAT}"
    out = {}
    for name, (_, where) in PREDICATES.items():
        out[name] = out[f"index_{name}"] = f"WITH {t} SELECT doc_id FROM d WHERE {where}"
    out |= {
        "bm25_term": _rank_sql(has("the"), "term = 'the'", 10),
        "bm25_or_topk": _rank_sql(f"{has('the')} OR {has('of')}", "term IN ('the', 'of')", 25),
        "bm25_prefix": _rank_sql("contains(n, ' retr')", "starts_with(term, 'retr')", 20),
        "bm25_phrase": _rank_sql(has("of the"), "term IN ('the', 'of')", 15),
        "bm25_offset": _rank_sql(f"{has('the')} AND {has('in')}", "term IN ('the', 'in')", 10, 7),
        "bm25_filtered": _rank_sql(f"{has('the')} OR {has('und')}", "term IN ('the', 'und')", 12, 0, "lang = 'en'"),
        "bm25_zero_score_not": _rank_sql(f"NOT {has('the')}", "false", 10),
        "bm25_double_not": _rank_sql(has("und"), "term = 'und'", 10),
        "bm25_supplied_statistics": f"WITH {t} SELECT doc_id, round(ln(1 + 499000.5 / 1000.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / 400.0)), 9) AS score FROM (SELECT *, len(list_filter(w, lambda x: x = 'the')) AS tf FROM d) WHERE tf > 0 ORDER BY score DESC, doc_id LIMIT 10",
        "reappend_then_search": f"WITH {t} SELECT doc_id FROM d WHERE CASE WHEN doc_id % 3 = 0 THEN true ELSE {has('the')} OR NOT {has('in')} END",
        "update_in_one_commit": "SELECT doc_id, CAST(1 AS INT) AS commits FROM documents WHERE doc_id % 5 = 0",
        "merge_then_search": f"WITH {t} SELECT doc_id, CAST(3 AS INT) AS segments FROM d WHERE NOT (doc_id % 16 = 2 AND doc_id % 3 = 0) AND ({has('the')} OR NOT {has('in')})",
        "snapshot_during_commit": f"WITH {t} SELECT 'old' AS view, doc_id FROM d WHERE {has('the')} UNION ALL SELECT 'new', doc_id FROM d WHERE doc_id % 2 <> 0 AND {has('the')}",
        "stream_then_search": f"WITH {t} SELECT doc_id FROM d WHERE {has('the')} AND NOT {has('of')}",
        "null_on_null": f"WITH {t} SELECT CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN true ELSE NOT {has('the')} END AS hit, count(*) AS n FROM d GROUP BY hit",
        "append_then_rank": _rank_sql(f"{has('the')} AND {has('in')}", "term IN ('the', 'in')", 20),
        "tokenize_docs": f"{flat} SELECT doc_id, CAST(pos AS INT) AS pos, term FROM f",
        "doc_length": f"WITH {t} SELECT doc_id, CAST(len(w) AS INT) AS dl, n AS norm FROM d",
        "term_vectors": f"{flat} SELECT doc_id, term, CAST(count(*) AS INT) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM f GROUP BY doc_id, term",
        "doc_freq": f"{flat} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term",
        "corpus_stats": f"{flat} SELECT count(*) AS documents, CAST(sum(len(w)) AS BIGINT) AS total_length, round(sum(len(w)) / count(*), 9) AS average_length FROM t",
        "multi_key_and": f"WITH {t} SELECT doc_id FROM d WHERE {has('the')} AND NOT {has('of')}",
        "residual_filter": f"WITH {t} SELECT doc_id, lang FROM d WHERE ({has('the')} OR {has('und')}) AND lang = 'en' AND doc_id > 100",
        "counts": f"WITH {t} SELECT count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS english, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM d WHERE {has('the')} AND {has('in')}",
        "count_by_source": f"WITH {t} SELECT source, count(*) AS n FROM d WHERE {has('the')} AND NOT {has('of')} GROUP BY source",
        "postings_and": f"{flat} SELECT doc_id FROM p WHERE term = 'the' INTERSECT SELECT doc_id FROM p WHERE term = 'in'",
        "postings_or": f"{flat} SELECT doc_id FROM p WHERE term = 'und' UNION SELECT doc_id FROM p WHERE term = 'que'",
        "postings_andnot": f"{flat} SELECT doc_id FROM p WHERE term = 'the' EXCEPT SELECT doc_id FROM p WHERE term = 'in'",
        "postings_not": f"{flat} SELECT doc_id FROM t EXCEPT SELECT doc_id FROM p WHERE term = 'the'",
        "phrase_positional_join": f"{flat} SELECT DISTINCT a.doc_id FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'",
        "prefix_dictionary": f"{flat} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p WHERE starts_with(term, 'retr') GROUP BY term",
        "cover_candidates": f"{flat} SELECT DISTINCT doc_id FROM p WHERE term = 'sttind'",
        "bitmap_counts": f"WITH {t} SELECT 'and' AS op, count(*) AS n FROM d WHERE {has('the')} AND {has('in')} UNION ALL SELECT 'or', count(*) FROM d WHERE {has('the')} OR {has('in')} UNION ALL SELECT 'andnot', count(*) FROM d WHERE {has('the')} AND NOT {has('in')}",
        "index_vs_scan": f"WITH {t} " + " UNION ALL ".join(f"SELECT '{k}' AS query, count(*) AS by_index, count(*) AS by_scan, CAST(0 AS BIGINT) AS differ FROM d WHERE {PREDICATES[k][1]}" for k in ("match_term", "match_phrase", "match_nested", "match_prefix_not")),
        "count_term": f"WITH {t} SELECT q AS query, CAST(n AS BIGINT) AS n FROM (SELECT 'the' AS q, count(*) FILTER ({has('the')}) AS n FROM d UNION ALL SELECT 'sttind', count(*) FILTER ({has('sttind')}) FROM d UNION ALL SELECT 'missingword', 0 UNION ALL SELECT 'the AND in', count(*) FILTER ({has('the')} AND {has('in')}) FROM d UNION ALL SELECT 'NOT the', count(*) FILTER (NOT {has('the')}) FROM d)",
        "delete_then_search": f"WITH {t} SELECT doc_id FROM d WHERE doc_id % 3 <> 0 AND ({has('the')} OR NOT {has('in')})",
        "update_then_search": f"WITH {t} SELECT doc_id FROM d WHERE doc_id % 5 = 0 OR {has('in')}",
        "compact_then_search": f"WITH {t} SELECT doc_id, CAST(1 AS INT) AS segments FROM d WHERE doc_id % 4 = 1 AND {has('the')}",
        "search_conversations": f"WITH {_tokens('conversations', 'conv_id, turn')} SELECT conv_id, turn FROM d WHERE {has('the')} AND NOT {has('of')}",
        "search_benchmark": f"WITH {_tokens('benchmark', 'item_id')} SELECT item_id FROM d WHERE {has('of the')} OR contains(n, ' th')",
        "search_join_labels": f"WITH {t} SELECT lang, quality, count(*) AS n FROM d JOIN labels USING (doc_id) WHERE {has('the')} OR {has('der')} GROUP BY lang, quality",
        "top_per_lang": f"{flat} SELECT lang, doc_id, CAST(tf AS INT) AS tf, CAST(nth AS INT) AS nth FROM (SELECT t.lang, p.doc_id, tf, row_number() OVER (PARTITION BY t.lang ORDER BY tf DESC, p.doc_id) AS nth FROM p JOIN t USING (doc_id) WHERE term = 'en') WHERE nth <= 3",
    }
    return out
