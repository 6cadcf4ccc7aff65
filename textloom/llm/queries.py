"""The thin queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from textloom.llm import debruijn_dedup, exact_dedup, jaccard_join, lattice, mixing, quality, secret_scan, sharding, suffix_repeats, topk_search
from textloom.llm.common import read_table

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: Target weights of the mix; any other source shares REST_WEIGHT.
WEIGHTS = {f"src{i}": w for i, w in enumerate((4, 8, 6, 6, 5, 5, 4, 4, 3, 3))}
REST_WEIGHT = 16.0
#: The tokenizer's model file and the number of sampled segmentations.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2


def op1_suffix_array_dedup(spark, sf_dir):
    return suffix_repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op2_substring_dedup(spark, sf_dir):
    return debruijn_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op3_topk_search(spark, sf_dir):
    return topk_search.search(read_table(spark, sf_dir, "embeddings"))


def op4_sentencepiece_sampling(spark, sf_dir):
    return lattice.encode_samples(read_table(spark, sf_dir, "documents"), MODEL_FILE, SAMPLES)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.join_components(read_table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), SHARDS)


def op9_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"), WEIGHTS, REST_WEIGHT)


def op9_mixing_by_source(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"), WEIGHTS, REST_WEIGHT, each_source=True)


def op10_secret_scan(spark, sf_dir):
    return secret_scan.scan_digest(read_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = (
        op1_suffix_array_dedup, op2_substring_dedup, op3_topk_search, op4_sentencepiece_sampling, op5_exact_dedup,
        op6_quality_classifier, op7_jaccard_join, op8_sharding, op9_mixing, op9_mixing_by_source, op10_secret_scan, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql():
    return {
        "op1_suffix_array_dedup": SQL1,
        "op2_substring_dedup": SQL2,
        "op3_topk_search": SQL3,
        "op5_exact_dedup": SQL5,
        "op7_jaccard_join": SQL7,
        "op8_sharding": SQL8.format(table=",".join(map(str, sharding.fill_table(SHARDS))), size=sharding.TABLE_SIZE),
        "op9_mixing": sql9(),
        "op10_secret_scan": sql10(),
    }


SQL1 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, unnest(range(1, octet_length(b) + 1)) AS pos,
             unnest(list_transform(range(1, octet_length(b) + 1), lambda i: CASE WHEN i + 199 <= octet_length(b) THEN md5(b[i:i + 199]) END)) AS h,
             unnest(list_transform(range(1, octet_length(b) + 1), lambda i: hex(b[i:i]))) AS x FROM d),
f AS (SELECT doc_id, pos, x, CAST(h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS INT) AS hit FROM p),
g AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS begins FROM g)
SELECT d.doc_id, CAST(max(octet_length(d.b)) AS BIGINT) AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, CAST(count(*) FILTER (begins) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(string_agg(x, '' ORDER BY pos) FILTER (gone = 0), ''))) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id
"""

SQL2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos,
             unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END)) AS h FROM d),
f AS (SELECT doc_id, word, pos, CAST(h IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY h) AS INT) AS hit FROM p),
g AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT d.doc_id, CAST(max(len(d.w)) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""

SQL7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS l FROM d),
g AS (SELECT doc_id, len(l) AS n, unnest(l) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (an + bn - k)),
r AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a)
SELECT s.doc_id, CAST(len(l) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(l)
"""

SQL3 = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL5 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

SQL8 = """
WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INT) AS slot FROM documents)
SELECT doc_id, slot, CAST(string_split('{table}', ',')[slot + 1] AS INT) AS shard FROM s
"""


def sql9() -> str:
    shares = mixing.quotas({**WEIGHTS, mixing.REST: REST_WEIGHT})
    plan = ", ".join(f"('{c}', {j}, {at}, {r}, {d})" for c, j, at, r, d in mixing.schedule(shares))
    share = ", ".join(f"('{c}', {n})" for c, n in sorted(shares.items()))
    names = ", ".join(f"'{n}'" for n in WEIGHTS)
    return f"""
WITH plan(class, j, slot_at, release_at, due_at) AS (VALUES {plan}), share(class, n) AS (VALUES {share}),
c AS (SELECT doc_id, source, CASE WHEN source IN ({names}) THEN source ELSE '*' END AS class, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY digest, doc_id, source) - 1 AS nth FROM c),
b AS (SELECT *, nth // {mixing.BLOCK_ROWS} AS block, nth % {mixing.BLOCK_ROWS} AS row_in_block FROM r)
SELECT doc_id, source, b.class, CAST(block AS BIGINT) AS block, CAST(row_in_block AS BIGINT) AS row_in_block,
       CAST(slot_at + block // n * {mixing.RESOLUTION} AS BIGINT) AS slot, CAST(release_at + block // n * {mixing.RESOLUTION} AS BIGINT) AS release,
       CAST(due_at + block // n * {mixing.RESOLUTION} AS BIGINT) AS deadline
FROM b JOIN share ON b.class = share.class JOIN plan ON plan.class = b.class AND plan.j = block % n
"""


def sql10() -> str:
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT key, {i} AS rank, '{r.kind}' AS kind, sum(gap + len) OVER w - len AS start, sum(gap + len) OVER w AS stop, marked FROM (
  SELECT key, unnest(range(1, len(m) + 1)) AS nth, unnest(list_transform(m, lambda x: length(x))) AS len, unnest(list_transform(g, lambda x: length(x))) AS marked,
         unnest(list_transform(s[1:len(m)], lambda x: length(x))) AS gap
  FROM (SELECT key, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d)
) WINDOW w AS (PARTITION BY key ORDER BY nth) QUALIFY marked >= {r.least}""")
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.RULES if r.base)
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    one = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN f USING (key) GROUP BY key, doc_id
"""
