"""A full-text index in Parquet: segments under numbered manifests.

A segment has postings (sorted by term, so that scans prune row groups), docs
and a dictionary. It is made from blocks of postings (see blocks), which are
written once, sorted, and deleted. A manifest names the live segments and tombstone files; it is
written whole and renamed, so a reader sees a change entirely or not at all, and
segments that no manifest names do not exist. A tombstone (doc_id, upto) hides a
document in segments numbered up to *upto*. Documents that are appended again
replace their older versions in the same commit. Merging rewrites the live rows
of some segments, compaction those of all.

A query reads one manifest (a Snapshot) for all it does, so a commit in between
does not mix generations.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import PROFILE
from textloom.functions.analysis import with_tokens
from textloom.operators import blocks as K
from textloom.operators import postings as P
from textloom.operators.ranking import rank
from textloom.plans.predicate import as_query, matches
from textloom.plans.query import Phrase, Prefix, Query, Term, cover_of, is_exact, simplify
from textloom.sources.tables import Folder, union_all

POSTINGS = "term string, doc_id long, tf int, positions array<int>, seg long"
DOCS = "doc_id long, dl int, seg long"
DICTIONARY = "term string, df long, cf long, seg long"
#: Postings are written as differences of what comes before: a Parquet dictionary of ids overflows where documents
#: are many, and each posting then has a whole id.
COMPACTLY = {"compression": "zstd", "parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("term", "doc_id", "positions.list.element")}
#: Segments that one merge takes, and the number of small ones that calls for it.
MERGE_SEGMENTS = 16
#: Hidden documents up to which they are sent to the executors (some 50 MB); more are joined by a shuffle.
HIDDEN_SENT = 2_000_000


@dataclass(frozen=True)
class Options:
    """Ways of execution; none changes a result."""

    use_index: bool = True
    count_fastpath: bool = True
    use_cover: bool = False


@dataclass
class Maintenance:
    """What a maintenance step did."""

    segments_before: int = 0
    segments_after: int = 0
    documents: int = 0
    removed: int = 0


@dataclass
class Index:
    spark: SparkSession
    path: str
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        self.folder = Folder(self.spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, options: Options | None = None) -> Index:
        index = cls(spark, path, options or Options())
        index._commit({"segments": [], "tombstones": [], "next": 1, "batches": {}}, 0)
        return index

    # manifests

    def generation(self) -> int:
        numbers = [int(n[9:-5]) for n in self.folder.names() if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            raise FileNotFoundError(f"no index at {self.path}")
        return max(numbers)

    def manifest(self) -> dict:
        return self.folder.read_json(f"manifest-{self.generation():010d}.json")

    def _commit(self, manifest: dict, generation: int) -> None:
        manifest = manifest | {"profile": PROFILE, "generation": generation}
        if not self.folder.write_json(f"manifest-{generation:010d}.json", manifest):
            raise RuntimeError("another writer committed first")

    # writing

    def _write_segment(self, blocks: DataFrame, docs: DataFrame | None = None) -> str:
        """A segment of *blocks*; the documents are *docs*, or else those of the blocks."""
        name = f"seg-{uuid.uuid4().hex}"
        base = f"{self.path}/{name}"
        # written first, as sorting in ranges reads its input twice
        blocks.write.option("compression", "zstd").parquet(f"{base}/blocks")
        made = self.spark.read.schema(K.BLOCKS).parquet(f"{base}/blocks")
        K.sorted_postings(made).write.options(**COMPACTLY).parquet(f"{base}/postings")
        (K.lengths(made) if docs is None else docs).write.parquet(f"{base}/docs")
        self.folder.delete(f"{name}/blocks")
        written = self.spark.read.parquet(f"{base}/postings")
        P.dictionary(written).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/dictionary")
        return name

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> int:
        """Add documents as a segment; its number. A named *batch* that is already in does nothing.

        Older versions of the same ids are hidden by the same commit (a null
        text only hides). An id that comes twice in *docs* is an error.
        """
        view = self.snapshot()
        manifest = view.manifest
        if batch is not None and batch in manifest["batches"]:
            return manifest["batches"][batch]
        read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
        seq = manifest["next"]
        name = self._write_segment(K.of_tokens(with_tokens(read).select("doc_id", "tokens")))
        written = self.spark.read.parquet(f"{self.path}/{name}/docs")
        size = written.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
        if size.rows != size.ids:
            self.folder.delete(name)
            raise ValueError(f"{size.rows - size.ids} documents repeat an id")
        dead = {}
        if manifest["segments"]:
            ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
            again = ids.join(view.docs().select("doc_id"), "doc_id", "left_semi")
            dead = self._write_tombstones(again, seq - 1)
        batches = manifest["batches"] | ({batch: seq} if batch is not None else {})
        entry = {"name": name, "seq": seq, "documents": size.rows}
        change = {"segments": [*manifest["segments"], entry], "tombstones": [*manifest["tombstones"], *dead], "hidden": manifest.get("hidden", {}) | dead, "next": seq + 1, "batches": batches}
        self._commit(manifest | change, view.generation + 1)
        return seq

    def _write_tombstones(self, ids: DataFrame, upto: int) -> dict[str, int]:
        """The tombstone files and their rows: one, or none if there are no ids."""
        name = f"dead-{uuid.uuid4().hex}"
        ids.withColumn("upto", F.lit(upto).cast("long")).write.parquet(f"{self.path}/{name}")
        rows = self.spark.read.parquet(f"{self.path}/{name}").count()
        if rows:
            return {name: rows}
        self.folder.delete(name)
        return {}

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Hide documents; ids that are not there do no harm."""
        view = self.snapshot()
        dead = self._write_tombstones(ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), view.manifest["next"] - 1)
        change = {"tombstones": [*view.manifest["tombstones"], *dead], "hidden": view.manifest.get("hidden", {}) | dead}
        self._commit(view.manifest | change, view.generation + 1)

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Replace documents: one commit hides the old versions and adds the new ones."""
        return self.append(docs, id_col, text_col)

    def compact(self, small: int | None = None) -> Maintenance:
        """Rewrite the live rows as one segment and drop the tombstones.

        With *small*: only if there are at least so many segments.
        """
        view = self.snapshot()
        before = len(view.manifest["segments"])
        if before == 0 or (small is not None and before < small):
            return Maintenance(before, before)
        return self._rewrite(view, view.manifest["segments"], [])

    def merge(self, at_least: int = MERGE_SEGMENTS, most: int = MERGE_SEGMENTS) -> Maintenance:
        """If there are *at_least* segments, merge the smallest, up to *most*, into one.

        Segments grow by tiers, so each document is rewritten a logarithmic
        number of times. Tombstones stay for the other segments.
        """
        view = self.snapshot()
        segments = view.manifest["segments"]
        if len(segments) < max(2, at_least):
            return Maintenance(len(segments), len(segments))
        chosen = sorted(segments, key=lambda s: (s["documents"], s["seq"]))[:most]
        return self._rewrite(view, chosen, view.manifest["tombstones"] if len(chosen) < len(segments) else [])

    def _rewrite(self, view: Snapshot, chosen: list[dict], tombstones: list[str]) -> Maintenance:
        """Commit one segment in place of the *chosen*; it has the number of the newest of them."""
        part = Snapshot(self, view.manifest | {"segments": chosen})
        name = self._write_segment(K.of_postings(part.postings()), part.docs().drop("seg"))
        live = self.spark.read.parquet(f"{self.path}/{name}/docs").count()
        names = {s["name"] for s in chosen}
        rest = [s for s in view.manifest["segments"] if s["name"] not in names]
        entry = {"name": name, "seq": max(s["seq"] for s in chosen), "documents": live}
        hidden = {n: rows for n, rows in view.manifest.get("hidden", {}).items() if n in tombstones}
        self._commit(view.manifest | {"segments": sorted([*rest, entry], key=lambda s: s["seq"]), "tombstones": tombstones, "hidden": hidden}, view.generation + 1)
        return Maintenance(len(view.manifest["segments"]), len(rest) + 1, live, sum(s["documents"] for s in chosen) - live)

    def vacuum(self, grace_seconds: float = 0.0) -> list[str]:
        """Delete files that the current manifest does not name.

        With other writers about, *grace_seconds* spares what was changed since:
        segments of a commit under way.
        """
        view = self.snapshot()
        named = {s["name"] for s in view.manifest["segments"]} | set(view.manifest["tombstones"]) | {f"manifest-{view.generation:010d}.json"}
        gone = [n for n in self.folder.names() if n not in named and not n.startswith("_")]
        gone = [n for n in gone if not grace_seconds or self.folder.age_seconds(n) > grace_seconds]
        for n in gone:
            self.folder.delete(n)
        return gone

    # reading: each call sees one generation

    def snapshot(self) -> Snapshot:
        """The index as it is now; commits after this do not change what it reads."""
        return Snapshot(self, self.manifest())

    def docs(self) -> DataFrame:
        return self.snapshot().docs()

    def postings(self) -> DataFrame:
        return self.snapshot().postings()

    def tombstones(self) -> DataFrame | None:
        return self.snapshot().tombstones()

    def dictionary(self) -> DataFrame:
        return self.snapshot().dictionary()

    def statistics(self) -> DataFrame:
        return self.snapshot().statistics()

    def search(self, query: str | Query, source: DataFrame | None = None) -> DataFrame:
        return self.snapshot().search(query, source)

    def count(self, query: str | Query, source: DataFrame | None = None) -> int:
        return self.snapshot().count(query, source)

    def rank(self, query: str | Query, **options) -> DataFrame:
        return self.snapshot().rank(query, **options)

    def explain(self, query: str | Query) -> dict[str, object]:
        return self.snapshot().explain(query)


@dataclass
class Snapshot:
    """One generation of an index."""

    index: Index
    manifest: dict

    def __post_init__(self) -> None:
        self.spark, self.path, self.options = self.index.spark, self.index.path, self.index.options

    @property
    def generation(self) -> int:
        return self.manifest["generation"]

    def _raw(self, kind: str, schema: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{s['name']}/{kind}").withColumn("seg", F.lit(s["seq"]).cast("long")) for s in self.manifest["segments"]]
        return union_all(parts) if parts else self.spark.createDataFrame([], schema)

    def tombstones(self) -> DataFrame | None:
        """(doc_id, upto), or None where nothing is hidden."""
        names = self.manifest["tombstones"]
        if not names:
            return None
        rows = union_all([self.spark.read.parquet(f"{self.path}/{n}") for n in names])
        return rows.groupBy("doc_id").agg(F.max("upto").alias("upto"))

    def _live(self, rows: DataFrame) -> DataFrame:
        dead = self.tombstones()
        if dead is None:
            return rows
        hidden = dead.withColumnRenamed("doc_id", "dead_id")
        known = self.manifest.get("hidden", {})
        if all(n in known for n in self.manifest["tombstones"]) and sum(known[n] for n in self.manifest["tombstones"]) <= HIDDEN_SENT:
            hidden = F.broadcast(hidden)
        return rows.join(hidden, (F.col("doc_id") == F.col("dead_id")) & (F.col("seg") <= F.col("upto")), "left_anti")

    def docs(self) -> DataFrame:
        return self._live(self._raw("docs", DOCS))

    def postings(self) -> DataFrame:
        return self._live(self._raw("postings", POSTINGS))

    def _read(self, root) -> DataFrame:
        """Live postings of a query's leaves; the filter is below the tombstones."""
        raw = self._raw("postings", POSTINGS)
        return self._live(raw.where(P.leaf_rows(root)) if P.leaves(root) else raw)

    def dictionary(self) -> DataFrame:
        """(term, df, cf) over live documents."""
        if self.tombstones() is None:
            return self._raw("dictionary", DICTIONARY).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return P.dictionary(self.postings())

    def statistics(self) -> DataFrame:
        return P.corpus_stats(self.docs())

    def search(self, query: str | Query, source: DataFrame | None = None) -> DataFrame:
        """doc_id of the matches. *source* (doc_id, text) is needed without an index or with covers."""
        root = simplify(as_query(query).root)
        if not self.options.use_index:
            if source is None:
                raise ValueError("a search without the index needs the source table")
            return source.where(matches("text", query)).select("doc_id")
        if self.options.use_cover and source is not None:
            cover = cover_of(root)
            some = P.candidates(self.postings(), self.docs(), cover.kind, cover.terms)
            if is_exact(root) and isinstance(root, Term):
                return some
            return source.join(some, "doc_id", "left_semi").where(matches("text", query)).select("doc_id")
        return P.search(self._read(root), self.docs(), root)

    def _counted_by_dictionary(self, root) -> bool:
        return self.options.count_fastpath and self.options.use_index and isinstance(root, Term) and not self.manifest["tombstones"]

    def count(self, query: str | Query, source: DataFrame | None = None) -> int:
        """Number of matches; for one term from the dictionary if nothing is hidden."""
        root = simplify(as_query(query).root)
        if self._counted_by_dictionary(root):
            return self._raw("dictionary", DICTIONARY).where(F.col("term") == root.term).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first().n
        return self.search(query, source).count()

    def rank(self, query: str | Query, **options) -> DataFrame:
        """BM25 (see operators.ranking.rank); frequencies and prefixes come from the dictionary."""
        return rank(self.postings(), self.docs(), query, words=self.dictionary(), **options)

    def explain(self, query: str | Query) -> dict[str, object]:
        """How a query would run, what it would read, and why not the faster ways."""
        root = simplify(as_query(query).root)
        cover = cover_of(root)
        fast = self._counted_by_dictionary(root)
        why = None
        if not fast:
            why = "not one term" if not isinstance(root, Term) else "documents are hidden" if self.manifest["tombstones"] else "switched off"
        return {
            "segments": len(self.manifest["segments"]),
            "documents_written": sum(s["documents"] for s in self.manifest["segments"]),
            "tombstone_files": len(self.manifest["tombstones"]),
            "generation": self.manifest["generation"],
            "profile": self.manifest["profile"],
            "leaves": len(P.leaves(root)),
            "terms": sum(isinstance(x, Term) for x in P.leaves(root)),
            "prefixes": sum(isinstance(x, Prefix) for x in P.leaves(root)),
            "phrases": sum(isinstance(x, Phrase) for x in P.leaves(root)),
            "cover": cover.kind,
            "cover_terms": list(cover.terms),
            "exact": is_exact(root),
            "recheck": not is_exact(root),
            "reads_universe": P.holds_without(root),
            "reads_index": self.options.use_index,
            "reads_source": not self.options.use_index or self.options.use_cover,
            "count_from_dictionary": fast,
            "count_fallback": why,
        }
