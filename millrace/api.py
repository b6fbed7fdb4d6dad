"""The engine: sources in, indexes as tables, queries out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace import schemas
from millrace.functions import identity
from millrace.operators import cdc, chunking, embed, extract, hybrid, index, routing, search
from millrace.operators.segments import Conflict, SegmentStore
from millrace.sources import folder, registry
from millrace.streaming import jobs

SOURCE_TYPES = ("git", "folder")


class NotFound(LookupError):
    pass


class Engine:
    """Tables lie as Parquet below `root`, a folder that all executors share.

    A table is a folder of versions; a pointer file names the current one, so readers see a whole version or the one before.
    Both indexes are one store of segments, in which a run adds what changed and nothing else is written again."""

    LOCK_SECONDS = 1800
    #: Rows from which vectors get cells and codes; these are made anew when the rows are four times as many.
    CELLS_FROM = 50_000

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[], embed.Embedder] | None = None, dimensions: int = 64, chunker: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.dimensions = embedder, dimensions
        self.chunker = {"strategy": "recursive", "chunk_size_tokens": 512, "overlap_tokens": 50} | (chunker or {})
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.store = SegmentStore(spark, f"{self.root}/index")

    # ---- tables

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/CURRENT"

    def _version(self, name: str) -> str | None:
        try:
            row = self.spark.read.text(self._pointer(name)).first()
        except AnalysisException:
            return None
        return row[0] if row else None

    def read(self, name: str) -> DataFrame | None:
        version = self._version(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}") if version else None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A new version; versions before the one that it replaces are removed."""
        version, before = f"v-{uuid.uuid4().hex}", self._version(name)
        df.write.parquet(f"{self.root}/{name}/{version}")
        out = self._fs.create(self._path(self._pointer(name)), True)
        out.write(bytearray(version.encode()))
        out.close()
        for f in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            own = f.getPath().getName()
            if own.startswith("v-") and own not in (version, before):
                self._fs.delete(f.getPath(), True)
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Files with these rows, beside those of the current version; what lies there is not read. Columns that it lacks are null."""
        version = self._version(name)
        if version is None:
            return self.write(name, df)
        schema = self.read(name).schema
        df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(f"{self.root}/{name}/{version}")
        return self.read(name)

    @contextmanager
    def lock(self, name: str):
        """One holder at a time; a lock older than LOCK_SECONDS is void."""
        path = self._path(f"{self.root}/locks/{name}")
        if self._fs.exists(path):
            age = self.spark.range(1).select(F.unix_timestamp()).first()[0] - self._fs.getFileStatus(path).getModificationTime() / 1000
            if age < self.LOCK_SECONDS:
                raise Conflict(f"{name} is being synchronised")
            void = self._path(f"{self.root}/locks/{name}.void-{uuid.uuid4().hex}")
            if not self._fs.rename(path, void):  # of several that find it void one succeeds
                raise Conflict(f"{name} is being synchronised")
            self._fs.delete(void, False)
        if not self._fs.createNewFile(path):
            raise Conflict(f"{name} is being synchronised")
        try:
            yield
        finally:
            self._fs.delete(path, False)

    # ---- sources

    def sources(self) -> DataFrame:
        held = self.read("sources")
        return held if held is not None else self.spark.createDataFrame([], schemas.SOURCE)

    def add_source(self, kind: str, name: str, **fields) -> str:
        """The id of the new source. ValueError for an unknown type, Conflict for a name that is taken."""
        if kind not in SOURCE_TYPES:
            raise ValueError(f"unknown source type {kind!r}; one of {', '.join(SOURCE_TYPES)}")
        if not self.sources().where(F.col("name") == name).isEmpty():
            raise Conflict(f"there is a source named {name!r}")
        id_ = f"src-{kind if kind == 'git' else 'nas'}-{uuid.uuid4().hex[:6]}"
        row = {f.name: None for f in schemas.SOURCE} | {"source_id": id_, "type": kind, "name": name, "branch": "main", "status": "idle", "indexed_files": 0, "pending_jobs": 0} | fields
        self.write("sources", self.sources().unionByName(self.spark.createDataFrame([row], schemas.SOURCE)))
        return id_

    def _source(self, source_id: str):
        row = self.sources().where(F.col("source_id") == source_id).first()
        if row is None:
            raise NotFound(f"no source {source_id!r}")
        return row

    # ---- ingestion

    def sync(self, source_id: str) -> DataFrame:
        """Compare a source with what it was at the last run and index what changed. The events of the run, without content.

        Only changed files are opened. What fails is kept with its content in the dead-letter table, from which drain()
        tries it again; a file that could not even be read counts as unseen, so the next run opens it again."""
        source = self._source(source_id)
        with self.lock(source_id):
            if source["type"] == "git":
                return self._sync_git(source)
            listing = folder.files(self.spark, source["folder_path"], include=source["file_patterns"] or ())
            empty = self.spark.createDataFrame([], "path string, modified timestamp, size long")
            held = self.read(f"snapshots/{source_id}")
            held = held if held is not None else empty
            current = self.write(f"snapshots-new/{source_id}", listing)
            changes = self.write(f"changes/{source_id}", cdc.snapshot_diff(current, held))
            bodies = cdc.changed_content(changes, folder.contents(self.spark, source["folder_path"], changes.where("operation <> 'delete'")))
            all_ = bodies.unionByName(changes.where("operation = 'delete'"), allowMissingColumns=True)
            events = self._events(source, all_)
            self.ingest(events)
            unread = changes.where("operation <> 'delete'").select("path").join(events.where("content is not null").select("path"), "path", "left_anti")
            self.write(f"snapshots/{source_id}", cdc.next_snapshot(current, held, unread))
        return events.drop("content")

    def _sync_git(self, source) -> DataFrame:
        """One clone and one pass over the history; heads are kept, so that the next run compares with them."""
        name, heads = source["source_id"], self.read(f"heads/{source['source_id']}")
        since = {r["repo"]: r["head"] for r in heads.collect()} if heads is not None else {}  # one row per repository
        registry.register_data_sources(self.spark)
        options = {"repos": source["url"], "branch": source["branch"] or "", "since": json.dumps(since), "include": json.dumps(list(source["file_patterns"] or ()))}
        changes = self.write(f"changes/{name}", self.spark.read.format("git").options(**options).load())
        # of a repository whose old head is gone everything known is void: what its new listing lacks is deleted
        void = changes.where("operation = 'reset'").select("path")
        held = self.store.rows()
        if held is not None and not void.isEmpty():
            mine = held.where(F.col("source_id") == name).select(F.col("document").alias("path")).distinct()
            lost = mine.join(void.withColumnRenamed("path", "__at"), F.startswith(F.col("path"), F.col("__at")), "left_semi").join(changes.select("path"), "path", "left_anti")
            changes = changes.where("operation <> 'reset'").unionByName(lost.withColumn("operation", F.lit("delete")), allowMissingColumns=True)
        else:
            changes = changes.where("operation <> 'reset'")
        found = cdc.split_renames(changes.withColumnRenamed("committed_at", "modified"))
        gone = F.col("operation") == "delete"
        found = found.withColumn("content", F.when(~gone, F.col("content"))).withColumn("content_hash", identity.content_hash(F.col("content")))
        events = self._events(source, found.select("path", "operation", "modified", "size", "content", "content_hash"))
        self.ingest(events)
        new = changes.where("head is not null").select("repo", "head").distinct()
        self.write(f"heads/{name}", new if heads is None else heads.join(new.select("repo"), "repo", "left_anti").unionByName(new))
        return events.drop("content")

    def _events(self, source, changes: DataFrame) -> DataFrame:
        events = cdc.events(changes, source["source_id"], source["type"], F.current_timestamp())
        return self.write(f"events/{source['source_id']}", events.withColumn("event_id", F.col("idempotency_key")))

    #: What the dead-letter table keeps of an event, enough to take it in again.
    _LETTER = ("event_id", "source_id", "source_type", "operation", "path", "modality", "content_hash", "content", "content_modified_at", "depth", "retry_count")

    def ingest(self, events: DataFrame) -> DataFrame:
        """Route events with content, extract, chunk, embed and index, in one commit of the index. Failures go to the dead-letter table, with their events, and are returned.

        What was extracted once from the same bytes, by the same version of an extractor, is taken from the cache. Events
        that go nowhere (images, which no model here embeds, what lies too deep, has no content or no extractor) are
        written to the table `unrouted` with their route. A document that is extracted anew loses its old chunks even if it
        has none now."""
        caps = routing.capabilities(self.spark)
        ready = events.withColumn("content_ref", F.struct(F.lit("path").alias("kind"), F.col("path").alias("path")))
        if "content_mime" not in ready.columns:
            ready = ready.withColumn("content_mime", F.lit(None).cast("string"))
        routed = routing.route(ready, caps)
        aside = routed.where(~F.col("route").isin("delete", "extract"))
        if not aside.isEmpty():
            self.append("unrouted", aside.select("event_id", "source_id", "path", "modality", "operation", "route", "content_hash").withColumn("at", F.current_timestamp()))
        got = self._extracted(routed.where("route = 'extract'"))
        good = got.where("error is null").join(routed.select("event_id", "content_modified_at"), "event_id")
        gone = routed.where("route = 'delete'").select("source_id", "path").unionByName(good.select("source_id", "path"))
        cut = chunking.chunk_extracted(good.select("source_id", "path", "text", "pages", "content_modified_at"), most=self.chunker["chunk_size_tokens"], overlap=self.chunker["overlap_tokens"], strategy=self.chunker["strategy"])
        ok, bad = embed.split_errors(self.write("embedded", self._embedded(cut)))
        unplaced = self.index(ok, gone)
        by_path = [x.select("source_id", identity.base_path(F.col("path")).alias("path"), "error") for x in (bad, unplaced)]
        errors = got.where("error is not null").select("source_id", "path", "error").unionByName(by_path[0]).unionByName(by_path[1])
        errors = errors.groupBy("source_id", "path").agg(F.min("error").alias("error"))
        letters = events.where("operation <> 'delete'").select(*self._LETTER).join(errors, ["source_id", "path"]).withColumn("failed_at", F.current_timestamp())
        return self._letters(events, self.write("failed", letters))

    def _letters(self, events: DataFrame, failed: DataFrame) -> DataFrame:
        """One letter for each document that failed last: those of these events go, the failed ones come. The same content keeps the count of its failures."""
        dead = self.read("dead")
        if dead is None:
            if not failed.isEmpty():
                self.write("dead", failed)
            return failed
        names = events.select("source_id", "path").distinct()
        if failed.isEmpty() and dead.join(names, ["source_id", "path"], "left_semi").isEmpty():
            return failed
        before = dead.groupBy("source_id", "path", "content_hash").agg(F.max("retry_count").alias("__before"))
        new = failed.join(before, ["source_id", "path", "content_hash"], "left").withColumn("retry_count", F.greatest("retry_count", "__before")).select(*dead.columns)
        self.write("dead", dead.join(names, ["source_id", "path"], "left_anti").unionByName(new))
        return failed

    def _extracted(self, files: DataFrame) -> DataFrame:
        keyed = files.withColumn("cache_key", identity.cache_key(F.col("extractor"), F.lit(extract.VERSION), F.col("content_hash")))
        held = self.read("cache")
        known = held.select("cache_key") if held is not None else keyed.select("cache_key").limit(0)
        fresh = extract.extracted(keyed.join(known, "cache_key", "left_anti")).join(keyed.select("event_id", "cache_key"), "event_id")
        out = self.write("extracted", fresh if held is None else fresh.unionByName(keyed.select("event_id", "source_id", "path", "cache_key").join(held, "cache_key")))
        new = out.where("error is null").drop("event_id", "source_id", "path").dropDuplicates(["cache_key"])
        if held is None or not new.join(known, "cache_key", "left_anti").isEmpty():
            self.append("cache", new.join(known, "cache_key", "left_anti"))
        return out.drop("cache_key")

    def drain(self, as_of: Column | None = None) -> dict[str, int]:
        """Take in again what is due in the dead-letter table. How many rows were tried, still wait, and have failed for good."""
        dead = self.read("dead")
        if dead is None:
            return {"again": 0, "waiting": 0, "final": 0}
        again, waiting, final = jobs.drain(dead, as_of if as_of is not None else F.current_timestamp())
        due = self.write("due", again)
        counts = {"again": due.count(), "waiting": waiting.count(), "final": final.count()}
        if counts["again"]:
            self.ingest(due.drop("error", "failed_at"))  # what fails again takes the place of its letter, with the new count
        return counts

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        entries = embed.embed(chunks, self.embedder, "content", self.dimensions)
        return entries.withColumns({"model": F.lit("hashing" if self.embedder is None else "custom"), "modality": F.lit("text"), "repo": F.element_at(F.split("path", "/"), 1), "derived_from": F.lit(""), "snippet": F.col("content")}).drop("content")

    def index(self, entries: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Replace the documents of entries in both indexes, and remove the gone ones, in one commit. Entries of no collection, with an error."""
        points, unknown = index.points(entries)
        self.store.upsert(points, gone)
        head = self.store.compact()
        rows = sum(s["rows"] for s in head["segments"])
        if rows >= self.CELLS_FROM and rows >= 4 * (head["book"] or {"rows": 0})["rows"]:
            self.store.train(self.dimensions)
        return unknown

    # ---- queries

    def _held(self, table: DataFrame | None) -> DataFrame:
        if table is None:
            raise NotFound("nothing is indexed yet")
        return table

    def _vectors(self) -> DataFrame:
        return self._held(self.store.vectors())

    def _now(self, as_of: int | None) -> int:
        return as_of if as_of is not None else self.spark.range(1).select(F.unix_timestamp()).first()[0]

    def search_semantic(self, query: str, modality: str | None = None, repo: str | None = None, path_prefix: str | None = None, top_k: int = 10, score_threshold: float = 0.0, max_age_days: int | None = None, freshness_boost: float = 0.0, as_of: int | None = None, recall: float | None = None) -> DataFrame:
        """The nearest chunks: exactly, or with a recall (such as 0.95) through the cells that hold about this part of them, where the index has some."""
        wanted = schemas.IMAGE_DIMENSIONS if modality == "image" else self.dimensions
        vector = embed.embed_query(query, "text", self.embedder, self.spark, self.dimensions)
        if len(vector) != wanted:
            raise ValueError(f"the query has {len(vector)} dimensions, the {modality or 'text'} index {wanted}")
        options = (top_k, score_threshold, "chunk_id", self._now(as_of), freshness_boost, max_age_days, path_prefix)
        hits = None
        if recall is not None:
            k, threshold, tie, now, boost, age, prefix = options
            hits = self.store.nearest(vector, k, recall, threshold, tie, now, boost, age, prefix, modality=modality, repo=repo)
        if hits is None:
            hits = search.semantic(self._vectors(), vector, *options, modality=modality, repo=repo)
        return search.projected(hits, ("score", "score_final"))

    def search_lexical(self, query: str, repo: str | None = None, path_prefix: str | None = None, modality: str | None = None, limit: int = 20, offset: int = 0, max_age_days: int | None = None, freshness_boost: float = 0.0, as_of: int | None = None, typos: bool = True) -> DataFrame:
        head = self.store.head()  # rows and postings of one commit
        docs = self._held(self.store.lexical(head))
        hits = search.lexical(docs, query, limit, offset, "doc_id", "snippet", typos, self._now(as_of), freshness_boost, max_age_days, path_prefix, index=self.store.index(head), repo=repo, modality=modality)
        return search.projected(hits, ("doc_id", "bm25", "score", "score_final", "highlight"))

    def rag_ask(self, question: str, repos: Sequence[str] | None = None, path_prefix: str | None = None, max_context_chars: int = 6000, top_k: int = 15, semantic_weight: float = 0.7, max_age_days: int | None = None, freshness_boost: float = 0.0, as_of: int | None = None, strict: bool = False) -> dict:
        """The context for a question, the sources used and counts."""
        repo = repos[0] if repos and len(repos) == 1 else None
        now = self._now(as_of)
        sem = self.search_semantic(question, None, repo, path_prefix, top_k, hybrid.THRESHOLD, max_age_days, freshness_boost, now)
        lex = self.search_lexical(question, repo, path_prefix, None, top_k, 0, max_age_days, freshness_boost, now)
        sem = sem.withColumns({"doc_id": identity.lexical_id(F.col("chunk_id")), "pos": F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) - 1})
        lex = lex.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("bm25"), "doc_id")) - 1)
        merged = hybrid.merge(sem, lex, semantic_weight, strict=strict)
        used = hybrid.budgeted(hybrid.best_per_path(hybrid.in_repos(merged, repos)), max_context_chars)
        whole = hybrid.context(used).first()
        counts = merged.agg(F.count_if(F.col("semantic_score") > 0).alias("s"), F.count_if(F.col("lexical_score") > 0).alias("l"), F.count(F.lit(1)).alias("m")).first()
        return {
            "context": whole["context"],
            "sources": [r.asDict() for r in hybrid.sources(used).orderBy("path_rank").drop("path_rank").collect()],  # at most top_k * 2
            "stats": {"semantic_hits": counts["s"], "lexical_hits": counts["l"], "merged_candidates": counts["m"], "sources_in_context": whole["sources_in_context"], "context_chars": whole["context_chars"]},
        }

    def search_images(self, query: Sequence[float], top_k: int = 5, score_threshold: float = 0.2) -> DataFrame:
        """By a vector of the image space."""
        if len(query) != schemas.IMAGE_DIMENSIONS:
            raise ValueError(f"the query has {len(query)} dimensions, the image index {schemas.IMAGE_DIMENSIONS}")
        return search.projected(search.semantic(self._vectors(), query, top_k, score_threshold, modality="image"))

    def list_files(self, source_id: str | None = None, path_prefix: str | None = None, modality: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return index.list_files(self._held(self.store.lexical()), source_id, path_prefix, modality, limit, offset)

    # ---- upkeep

    def purge(self, source_id: str) -> dict[str, int]:
        """Remove a source from both indexes; how many rows each had."""
        self._source(source_id)
        return self.store.purge(source_id)

    def vacuum(self, keep: int = 2) -> int:
        """Remove what earlier commits of the index held, but for the last `keep`."""
        return self.store.vacuum(keep)

    def reindex(self, source_id: str) -> DataFrame:
        """Forget the snapshot of a source and index it anew."""
        self.purge(source_id)
        self.write(f"snapshots/{source_id}", self.spark.createDataFrame([], "path string, modified timestamp, size long"))
        self.write(f"heads/{source_id}", self.spark.createDataFrame([], "repo string, head string"))
        return self.sync(source_id)

    def stats(self) -> dict:
        """Counts of both indexes at one commit, those of the queues, and an error for each store that cannot be read."""
        errors: dict[str, str] = {}

        def tried(name: str, f: Callable[[], dict]) -> dict:
            try:
                return f()
            except Exception as e:
                errors[name] = f"{type(e).__name__}: {e}"[:300]
                return {}

        def counted() -> dict:
            head = self.store.head()
            v, x = self.store.vectors(head), self.store.lexical(head)
            if v is None or x is None:
                return {"text_points": 0, "image_points": 0, "lexical_docs": 0, "total": 0, "last_index_ts": None}
            return index.stats(v, x).first().asDict()

        def queued() -> dict:
            dead = self.read("dead")
            final = F.col("retry_count") >= jobs.MAX_RETRIES
            return {"dead": 0, "final": 0} if dead is None else dead.agg(F.count_if(~final).alias("dead"), F.count_if(final).alias("final")).first().asDict()

        return tried("index", counted) | tried("dead", queued) | {"errors": errors}

    def health(self) -> dict[str, str]:
        head = self.store.head()
        checks = {name: "ok" if there else "missing" for name, there in (("sources", self._version("sources")), ("vectors", any(s["rows"] for s in head["segments"])), ("lexical", any(s["docs"] for s in head["segments"])))}
        state = "healthy" if set(checks.values()) == {"ok"} else "degraded" if "ok" in checks.values() else "empty"
        return {"status": state} | checks


__all__ = ["Conflict", "Engine", "NotFound"]
