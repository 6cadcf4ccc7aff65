"""Secret scan behind a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean trigram query is derived: a disjunction of
conjunctions of trigrams that every match must hold. Postings (trigram,
document) are built for the trigrams that some rule asks for, conjunctions are
intersected, disjunctions united, and only the candidates are verified with
the regex. A rule without mandatory trigrams is verified on every document.

Matches are leftmost and do not overlap within a kind; those that are too short
are dropped after matching. Spans are in code points, end exclusive.

Null and empty texts have no spans. Rows that share id and text get the same
spans; a null id is handled like any other. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import row_key, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the length of *group* must be at least *least*."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The patterns of the contract, then further public key formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
#: A disjunction over this many exact strings is not followed further.
MOST_STRINGS = 64

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def both(a: Query, b: Query) -> Query:
    return simplest({x | y for x in a for y in b})


def simplest(parts: set[frozenset[str]]) -> Query:
    """Without conjunctions that contain another one, as that one admits more."""
    return frozenset(p for p in parts if not any(q < p for q in parts))


def of_strings(strings: set[str]) -> Query:
    """The trigram query of "one of these strings occurs"."""
    return simplest({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}) if strings else ANY


def trigram_query(pattern: str) -> Query:
    """What every match of *pattern* must hold, in lower case; ANY if nothing.

    Exact strings are kept while a sequence is read and turned into trigrams
    where they end: at a repeat, at a class, or beyond MOST_STRINGS.
    """

    def item(op, value) -> tuple[set[str] | None, Query]:
        """(all exact strings it can be, or None; the query it implies otherwise)"""
        if op is sre.LITERAL:
            return {chr(value).lower()}, ANY
        if op is sre.IN:
            chars = {chr(v).lower() for o, v in value if o is sre.LITERAL}
            small = all(o is sre.LITERAL for o, _ in value) and len(chars) <= 8
            return (chars, ANY) if small else (None, ANY)
        if op is sre.SUBPATTERN:
            return sequence(value[3])
        if op is sre.BRANCH:
            found = [sequence(x) for x in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
                if len(strings) <= MOST_STRINGS:
                    return strings, ANY
            whole: set[frozenset[str]] = set()
            for s, q in found:
                whole |= q if s is None else of_strings(s)
            return None, simplest(whole)
        if op is sre.MAX_REPEAT and value[:2] == (0, 1):
            s, _ = sequence(value[2])
            return (s | {""}, ANY) if s is not None else (None, ANY)
        if op is sre.MAX_REPEAT and value[0] > 0:
            s, q = sequence(value[2])
            return None, q if s is None else of_strings(s)
        return None, ANY

    def sequence(items) -> tuple[set[str] | None, Query]:
        open_, query, exact = {""}, ANY, True
        for op, value in items:
            s, q = item(op, value)
            if s is not None and len(open_) * len(s) <= MOST_STRINGS:
                open_ = {a + b for a in open_ for b in s}
                continue
            query, exact = both(query, of_strings(open_)), False
            if s is None:
                query, open_ = both(query, q), {""}
            else:
                open_ = s
        return (open_, ANY) if exact else (None, both(query, of_strings(open_)))

    strings, query = sequence(parser.parse(pattern))
    return query if strings is None else of_strings(strings)


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (trigram, rid, rhash) for the given lower-case trigrams."""
    lower = F.lower(whole_text(text_col))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("lower_text"), F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = docs.select(*row_key(id_col, text_col), lower.alias("lower_text"))
    return rows.select("rid", "rhash", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rid, rhash, kinds): documents that satisfy the trigram query of those kinds.

    Every conjunction is an intersection of posting lists: the count of its
    distinct trigrams that a document is listed under equals their number.
    """
    spark = index.sparkSession
    clauses = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if query != ANY:
            clauses += [(rule.kind, k, t, len(c)) for k, c in enumerate(sorted(map(sorted, query))) for t in c]
    wanted = spark.createDataFrame(clauses, "kind string, clause int, trigram string, size long")
    hits = index.distinct().join(F.broadcast(wanted), "trigram").groupBy("rid", "rhash", "kind", "clause", "size").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n = size").groupBy("rid", "rhash").agg(F.collect_set("kind").alias("kinds"))


def found_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rank, stop, kind>> of a rule's matches.

    Positions come from the lengths of the pieces between matches (split) and
    of the matches themselves, summed from the left.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    marked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))),
        marked,
        lambda x, g: F.struct(x.gap.alias("gap"), x.len.alias("len"), F.length(g).alias("marked")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>").alias("out"))
    step = lambda a, x: F.struct(
        (a.at + x.gap + x.len).alias("at"),
        F.when(
            x.marked >= rule.least,
            F.concat(a.out, F.array(F.struct((a.at + x.gap).alias("start"), F.lit(order).alias("rank"), (a.at + x.gap + x.len).alias("stop"), F.lit(rule.kind).alias("kind")))),
        )
        .otherwise(a.out)
        .alias("out"),
    )
    return F.aggregate(lengths, start, step, lambda a: a.out)


def run_pattern(rule: Rule) -> str:
    """The rule's pattern; a word before a greedy run of one class with the run's least length in it.

    A run that is too short has no longer one inside, so short runs need not be listed.
    """
    m = re.fullmatch(r"([A-Za-z0-9]*)(\[[^\]\\]+\])\+", rule.pattern)
    return rule.pattern if m is None or rule.group else f"{m[1]}{m[2]}{{{max(1, rule.least - len(m[1]))},}}"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (start, rank, stop, kind), sorted."""
    needs = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in needs.values() for c in q for t in c})
    found = candidates(postings(docs, trigrams, id_col, text_col), rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), *row_key(id_col, text_col))
    checked = rows.join(found, ["rid", "rhash"], "left")
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        spans = found_spans(F.col("text"), Rule(rule.kind, run_pattern(rule), rule.group, rule.least), order)
        parts.append(spans if needs[rule.kind] == ANY else F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none))
    return checked.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def scan_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans as text."""
    base = [r.kind for r in rules if r.base]
    out = scan(docs, rules)
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
