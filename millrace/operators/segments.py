"""A document store of immutable segments with merge on read: rows, postings, deletion vectors and a manifest.

A commit adds one segment (the rows of the new chunks, and an inverted index of these alone) and one deletion vector
(the keys of the rows that it replaces or removes), and names all of them in a manifest. Nothing that lies there is
written again, so a commit writes in proportion to what changed. Vectors and texts are columns of the same rows and
postings belong to the same segment, so a reader of a manifest never sees two commits at once.

A row is alive unless a deletion vector of a later commit names its key. Manifests are numbered files that are made
only if they are not there yet (compare and set): of two writers of one number the second starts again from the other's
manifest. (On stores without create-if-absent, writers need a lock of their own; Engine has one per source.)

Compaction is by tiers of size: FAN segments of about one size become one, without what is dead in them; its postings are
counted from the rows that are alive, each of which lies in one place, so that no posting is shuffled. Deletion vectors that no segment is older than are dropped. vacuum() removes
folders that the last manifests do not name."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import identity, ranking
from millrace.operators import index, search
from millrace.operators.vector_index import AGAIN, Codebook, clear, grown, placed

#: Segments of one tier that are merged; tiers grow by this factor.
FAN = 4
#: Words of text whose postings go to one file, about.
FILE_WORDS = 4_000_000
#: Rows of a deletion vector, documents of a commit and words near a query that may be broadcast, or listed in a filter.
BROADCAST_ROWS, LISTED = 200_000, 1000
#: Documents of a part, about; documents that have a word from which it has stored blocks, at least; and parts that are scored before others are left out.
PART_DOCS, FREQUENT, FIRST_PARTS = 2000, 128, 64
#: In a large segment, the part of its documents that have to have a word (one of so many) for it to have stored blocks.
OFTEN = 1000
#: Of rows and postings.
CODEC = "zstd"
POSTINGS = "term string, part long, doc_id string, doc_len int, tf long"
#: Seconds after which a manifest that is not whole was left by a writer that died.
STALE = 600
_EMPTY = {"version": 0, "segments": [], "deletions": [], "docs": 0, "words": 0, "codes": [], "book": None}
#: Recalls for which the number of cells is measured when codes are made; candidates that are scored by their vectors, at most.
RECALLS, CANDIDATES = (0.9, 0.95, 0.99), 2000
_CODED = ("chunk_id", "source_id", "document", "repo", "modality", "path", "content_modified_ts")


class Conflict(ValueError):
    pass


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class SegmentStore:
    """points: rows as index.points() gives them, with `content`; chunk_id is their key, doc_id that of their postings."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path, self._books = spark._jvm.org.apache.hadoop.fs.Path, {}
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    def _numbers(self) -> list[int]:
        base = self._path(f"{self.root}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(base)] if self._fs.exists(base) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def _file(self, version: int):
        return self._path(f"{self.root}/commits/{version:012d}.json")

    def manifest(self, version: int) -> dict | None:
        """None if it is not there, or not whole."""
        if version == 0:
            return dict(_EMPTY)
        if not self._fs.exists(self._file(version)):
            return None
        size = self._fs.getFileStatus(self._file(version)).getLen()
        stream = self._fs.open(self._file(version))
        try:
            text = bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def head(self) -> dict:
        """The last whole manifest."""
        for version in reversed(self._numbers()):
            if (found := self.manifest(version)) is not None:
                return found
        return dict(_EMPTY)

    def _commit(self, make: Callable[[dict], dict | None], tries: int = 8) -> dict:
        """make(head) gives the next manifest (None: nothing to do); it is called again if another writer was first."""
        for _ in range(tries):
            numbers, head = self._numbers(), self.head()
            if numbers and numbers[-1] != head["version"]:  # a writer is at it, or died
                left = self._fs.getFileStatus(self._file(numbers[-1])).getModificationTime() / 1000
                if time.time() - left > STALE:
                    self._fs.delete(self._file(numbers[-1]), False)
                else:
                    time.sleep(0.2)
                continue
            new = make(head)
            if new is None:
                return head
            new["version"] = head["version"] + 1
            try:
                out = self._fs.create(self._file(new["version"]), False)
            except Py4JJavaError as e:
                if "exist" not in str(e.java_exception):
                    raise
                continue
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            return new
        raise Conflict(f"{self.root} is being written by others")

    # ---- reading

    def _of(self, manifest: dict, name: str, segments: list[dict] | None = None, places: bool = False) -> DataFrame | None:
        """All rows of a table, dead ones too, with the number of the commit that wrote them in `__seq`; with places, also their file and their number in it."""
        where = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")] if places else []
        own = [s for s in (manifest["segments"] if segments is None else segments) if name == "rows" or s["docs"]]
        parts = [self.spark.read.parquet(f"{self.root}/segments/{s['id']}/{name}").select("*", *where, F.lit(s["seq"]).cast("long").alias("__seq")) for s in own]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _later(self, manifest: dict) -> list[dict]:
        """The deletion vectors that some part is older than."""
        oldest = min((p["seq"] for p in (*manifest["segments"], *manifest["codes"])), default=0)
        return [d for d in manifest["deletions"] if d["seq"] > oldest]

    def _alive(self, rows: DataFrame, manifest: dict, key: str, how: str = "left_anti") -> DataFrame:
        """Without the rows that a later deletion vector names; or only these (left_semi)."""
        vectors = self._later(manifest)
        if not vectors:
            return rows.drop("__seq")
        dead = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/deletions/{d['id']}").select(F.col(key).alias("__dead"), F.lit(d["seq"]).cast("long").alias("__at")) for d in vectors])
        hit = (F.col(key) == F.col("__dead")) & (F.col("__seq") < F.col("__at"))
        return rows.join(_small(dead, sum(d["rows"] for d in vectors)), hit, how).drop("__seq")

    def _alive_rows(self, manifest: dict, segments: list[dict] | None = None) -> DataFrame | None:
        """The live rows with their texts and vectors. Where more are dead than may be broadcast, keys alone are joined; that gives a bit
        for each row of a file, by which the rows are left out where they lie."""
        if sum(d["rows"] for d in self._later(manifest)) <= BROADCAST_ROWS:
            held = self._of(manifest, "rows", segments)
            return None if held is None else self._alive(held, manifest, "chunk_id")
        held = self._of(manifest, "rows", segments, places=True)
        if held is None:
            return None
        slot, bit = F.bitmap_bucket_number(F.col("__row") + 1), F.bitmap_bit_position(F.col("__row") + 1)
        dead = self._alive(held.select("chunk_id", "__file", "__row", "__seq"), manifest, "chunk_id", "left_semi")
        bits = dead.groupBy("__file", slot.alias("__slot")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        gone = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
        return held.withColumn("__slot", slot).join(F.broadcast(bits), ["__file", "__slot"], "left").where(~gone).drop("__file", "__slot", "__bits", "__row", "__seq")

    def rows(self, manifest: dict | None = None) -> DataFrame | None:
        """All live rows; None if no segment is there."""
        return self._alive_rows(manifest or self.head())

    def vectors(self, manifest: dict | None = None) -> DataFrame | None:
        held = self.rows(manifest)
        return None if held is None else held.drop("content", "doc_id", "doc_len", "document")

    def lexical(self, manifest: dict | None = None) -> DataFrame | None:
        held = self.rows(manifest)
        return None if held is None else index.lexical_docs(held).drop("document", "doc_len")

    # ---- writing

    def _write_segment(self, points: DataFrame) -> dict | None:
        """One pass over the points, one over the texts just written."""
        id_ = uuid.uuid4().hex
        path = f"{self.root}/segments/{id_}"
        document = identity.base_path(F.col("path"))
        words = F.when(F.col("modality") != "image", F.size(ranking.terms(F.col("content"))))
        points.withColumns({"doc_id": identity.lexical_id(F.col("chunk_id")), "document": document, "doc_len": words}).sortWithinPartitions("source_id", "document").write.option("compression", CODEC).parquet(f"{path}/rows")
        rows = self.spark.read.parquet(f"{path}/rows")
        n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_len").alias("docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words")).first()
        if not n["rows"]:
            self._fs.delete(self._path(path), True)
            return None
        if n["docs"]:
            self._write_postings(path, n["words"], n["docs"])
        return {"id": id_, "rows": n["rows"], "docs": n["docs"], "words": n["words"]}

    def _write_postings(self, path: str, words: int, docs: int) -> None:
        """Postings of the rows of a segment, over files of bounded size, and the words. Texts are dealt out by document: a file has all
        postings of its documents, in order of term, so that a query reads the pages of its terms.

        Documents of about one length lie in parts of about PART_DOCS. A frequent term has a block for each part: how many
        documents, its most occurrences and its least length there, which bound its score in the part."""
        length = F.floor(F.log2(F.col("doc_len").cast("double") + 1) * 4).cast("long")
        files, groups, own = max(1, -(-words // FILE_WORDS)), max(1, docs // (16 * PART_DOCS)), F.hash("doc_id")
        # as texts are dealt out by the same hash, a file has the parts of few groups, and few blocks for each word
        group = F.pmod(F.pmod(own, F.lit(files)), F.lit(groups)) if groups < files else F.pmod(own, F.lit(files * -(-groups // files)))
        part = F.shiftleft(length, 32) + group
        texts = self.spark.read.parquet(f"{path}/rows").where("doc_len is not null").select("doc_id", "content")
        dealt = index.counted(texts.coalesce(1) if files == 1 else texts.repartition(files, "doc_id"), "doc_id", "content")
        rows = dealt.select("term", part.alias("part"), "doc_id", "doc_len", "tf")
        rows.sortWithinPartitions("term", "part", "doc_id").write.option("compression", CODEC).parquet(f"{path}/postings")
        held = self.spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/words")
        often = self.spark.read.parquet(f"{path}/words").where(F.col("df") >= max(FREQUENT, docs // OFTEN)).select("term")
        n = often.count()
        blocks = _blocks(held.join(F.broadcast(often), "term", "left_semi")) if n <= BROADCAST_ROWS else _blocks(held).join(often, "term", "left_semi")
        blocks.sortWithinPartitions("term").write.parquet(f"{path}/blocks")

    def _write_deletions(self, manifest: dict, documents: DataFrame, gone: DataFrame | None) -> dict | None:
        """The live rows of documents (source_id, document) that are replaced, and of those that are gone, with what was derived from these."""
        held = self._of(manifest, "rows")
        if held is None:
            return None
        narrow = held.select("source_id", "document", "derived_from", "chunk_id", "doc_id", "doc_len", "__seq")
        out = None
        for names, columns in ((documents, ("document",)), (gone, ("document", "derived_from"))):
            if names is None:
                continue
            names = names.select(F.col("source_id").alias("__source"), F.col("document").alias("__name")).distinct()
            few = names.limit(LISTED + 1).collect()
            for c in columns:
                own = narrow
                if len(few) <= LISTED:  # lists let the files' statistics spare most of them
                    own = own.where(F.col("source_id").isin([r[0] for r in few]) & F.col(c).isin([r[1] for r in few]))
                own = own.join(_small(names, len(few) if len(few) <= LISTED else names.count()), (F.col("source_id") == F.col("__source")) & (F.col(c) == F.col("__name")), "left_semi")
                out = own if out is None else out.unionByName(own)
        return self._deletion(manifest, out)

    def _deletion(self, manifest: dict, rows: DataFrame) -> dict | None:
        """A deletion vector of rows (with `__seq`), as far as they are alive."""
        id_ = uuid.uuid4().hex
        self._alive(rows, manifest, "chunk_id").select("chunk_id", "doc_id", "doc_len").dropDuplicates(["chunk_id"]).write.parquet(f"{self.root}/deletions/{id_}")
        n = self.spark.read.parquet(f"{self.root}/deletions/{id_}").agg(F.count(F.lit(1)).alias("rows"), F.count("doc_len").alias("docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words")).first()
        if not n["rows"]:
            self._fs.delete(self._path(f"{self.root}/deletions/{id_}"), True)
            return None
        return {"id": id_, "rows": n["rows"], "docs": n["docs"], "words": n["words"]}

    def _next(self, head: dict, segment: dict | None, dead: dict | None) -> dict | None:
        if segment is None and dead is None:
            return None
        seq, new = head["version"] + 1, json.loads(json.dumps(head))
        for kind, part in (("segments", segment), ("deletions", dead)):
            if part:
                new[kind].append(part | {"seq": seq})
        for n in ("docs", "words"):
            new[n] += (segment or {}).get(n, 0) - (dead or {}).get(n, 0)
        if segment and head.get("book"):
            rows = self.spark.read.parquet(f"{self.root}/segments/{segment['id']}/rows").where(F.size("vector") == head["book"]["width"])
            new["codes"].append({"id": self._write_codes(placed(rows.select(*_CODED, "vector"), self._book(head), f"{self.root}/codes/{uuid.uuid4().hex}")), "seq": seq})
        return new

    # ---- vectors by cells

    def _book(self, manifest: dict) -> Codebook:
        id_ = manifest["book"]["id"]
        if id_ not in self._books:
            self._books = {id_: Codebook.load(self.spark, f"{self.root}/books/{id_}")}
        return self._books[id_]

    def _write_codes(self, rows: DataFrame) -> str:
        """A part of codes, in the order of the cells; of the vectors only the codes. `rows` may be a table of placed(), which goes."""
        id_, from_ = uuid.uuid4().hex, {f.rsplit("/", 1)[0] for f in rows.inputFiles()} if "vector" in rows.columns else set()
        rows.drop("vector").sortWithinPartitions("cell").write.parquet(f"{self.root}/codes/{id_}")
        for path in from_:
            self._fs.delete(self._path(path), True)
        return id_

    def _codes(self, manifest: dict) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/codes/{c['id']}").withColumn("__seq", F.lit(c["seq"]).cast("long")) for c in manifest["codes"]]
        return self._alive(reduce(DataFrame.unionByName, parts), manifest, "chunk_id")

    def train(self, dimensions: int, cells: int | None = None, most: int | None = None) -> dict:
        """Make a codebook for the live vectors of so many dimensions, and their codes; later commits add theirs. The manifest.

        To be called again when the rows have grown by much: then the cells are made anew."""
        head = self.head()
        held = self.rows(head)
        if held is None:
            return head
        own = held.where(F.size("vector") == dimensions).select(*_CODED, "vector")
        n, id_ = own.count(), uuid.uuid4().hex
        if not n:
            return head
        work = f"{self.root}/books/{id_}-work"
        book, rows = grown(own, work, "chunk_id", n, cells, most)
        book.save(self.spark, f"{self.root}/books/{id_}")
        probes = {str(r): book.probes_for(rows, "chunk_id", r) for r in RECALLS}
        codes = self._write_codes(rows)
        clear(self.spark, work)

        def make(now: dict) -> dict:
            new = json.loads(json.dumps(now))
            new["book"] = {"id": id_, "width": dimensions, "rows": n, "cells": len(book.leaves()), "probes": probes}
            new["codes"] = [{"id": codes, "seq": head["version"]}]
            for s in now["segments"]:  # written meanwhile
                if s["seq"] > head["version"]:
                    rest = self.spark.read.parquet(f"{self.root}/segments/{s['id']}/rows").where(F.size("vector") == dimensions).select(*_CODED, "vector")
                    new["codes"].append({"id": self._write_codes(placed(rest, book, f"{self.root}/codes/{uuid.uuid4().hex}")), "seq": s["seq"]})
            return new

        return self._commit(make)

    def nearest(self, query: Sequence[float], k: int = 10, recall: float = 0.95, threshold: float = 0.0, tie: str = "chunk_id", as_of: int | None = None, freshness_boost: float = 0.0, max_age_days: int | None = None, path_prefix: str | None = None, probes: int | None = None, manifest: dict | None = None, **equal: str | None) -> DataFrame | None:
        """As search.semantic() over the cells that hold about this part of the nearest rows: codes first, then the vectors of the best. None without codes for such a query.

        Filters come first; where they leave fewer rows than are wanted in these cells, the answer has fewer."""
        manifest = manifest or self.head()
        if not manifest.get("book") or manifest["book"]["width"] != len(query) or k <= 0:
            return None
        book = self._book(manifest)
        n = probes or manifest["book"]["probes"][str(min((r for r in RECALLS if r >= recall), default=RECALLS[-1]))]
        held = search.filtered(self._codes(manifest).where(F.col("cell").isin(book.near(query, n))), as_of, max_age_days, path_prefix, **equal)
        wanted = min(CANDIDATES, AGAIN * ranking.fetch_size(k, freshness_boost))
        best = held.select(*_CODED[:3], book.rough(query).alias("__rough")).orderBy(F.desc("__rough"), tie).limit(max(wanted, k)).collect()
        rows = self.rows(manifest)
        for c in _CODED[:3]:  # the statistics of the files spare most of them
            rows = rows.where(F.col(c).isin(sorted({r[c] for r in best})))
        return search.semantic(rows.drop("content", "doc_id", "doc_len", "document"), query, k, threshold, tie, as_of, freshness_boost)

    def upsert(self, points: DataFrame, gone: DataFrame | None = None) -> dict:
        """Replace the documents of points, and remove the gone ones (source_id, path): all of it in one commit. The manifest.

        All chunks of a document are replaced together. Repeated keys within points are the caller's to avoid."""
        segment = self._write_segment(points)
        away = None if gone is None else gone.select("source_id", F.col("path").alias("document"))
        fresh = self.spark.read.parquet(f"{self.root}/segments/{segment['id']}/rows").select("source_id", "document") if segment else None
        empty = self.spark.createDataFrame([], "source_id string, document string")
        return self._commit(lambda head: self._next(head, segment, self._write_deletions(head, fresh if fresh is not None else empty, away)))

    def purge(self, source_id: str) -> dict[str, int]:
        """Remove a source in one commit; how many rows each index had of it."""
        counted = {"vectors": 0, "lexical": 0}

        def make(head: dict) -> dict | None:
            held = self._of(head, "rows")
            dead = None if held is None else self._deletion(head, held.where(F.col("source_id") == source_id).select("chunk_id", "doc_id", "doc_len", "__seq"))
            counted.update(vectors=(dead or {}).get("rows", 0), lexical=(dead or {}).get("docs", 0))
            return self._next(head, None, dead)

        self._commit(make)
        return counted

    # ---- upkeep

    def tiers(self, manifest: dict) -> list[list[dict]]:
        """Segments that are due to be merged, by size."""
        by_size: dict[int, list[dict]] = {}
        for s in manifest["segments"]:
            by_size.setdefault(int(math.log(max(1, s["rows"]), FAN)), []).append(s)
        return [x for _, x in sorted(by_size.items()) if len(x) >= FAN]

    def compact(self, everything: bool = False) -> dict:
        """Merge the smallest tier that is full, again and again; or all segments into one. The manifest."""
        while True:
            head = self.head()
            due = [head["segments"]] if everything else self.tiers(head)
            if not due or (len(due[0]) < 2 and not (everything and due[0] and head["deletions"])):
                return head
            before = head["version"]
            head = self._merge(head, due[0])
            if everything or head["version"] == before:
                return head

    def _merge(self, head: dict, old: list[dict]) -> dict:
        id_ = uuid.uuid4().hex
        path, ids = f"{self.root}/segments/{id_}", {s["id"] for s in old}
        self._alive_rows(head, old).sortWithinPartitions("source_id", "document").write.option("compression", CODEC).parquet(f"{path}/rows")
        n = self.spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("rows"), F.count("doc_len").alias("docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words")).first()
        if n["docs"]:
            self._write_postings(path, n["words"], n["docs"])
        # what is alive at this head is what its number says; later deletions still reach it
        merged = {"id": id_, "rows": n["rows"], "docs": n["docs"], "words": n["words"], "seq": head["version"]}

        def make(now: dict) -> dict | None:
            if not ids <= {s["id"] for s in now["segments"]}:  # others have merged some of them
                return None
            new = json.loads(json.dumps(now))
            new["segments"] = [s for s in new["segments"] if s["id"] not in ids] + ([merged] if n["rows"] else [])
            oldest = min((s["seq"] for s in new["segments"]), default=now["version"])
            if len(now["codes"]) >= FAN:  # the codes of one book become one part
                new["codes"] = [{"id": self._write_codes(self._codes(now)), "seq": now["version"]}]
            oldest = min((p["seq"] for p in (*new["segments"], *new["codes"])), default=now["version"])
            new["deletions"] = [d for d in new["deletions"] if d["seq"] > oldest]
            return new

        return self._commit(make)

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests before the last `keep`, and folders that none of these names and that are no commit in the making. How many folders."""
        numbers = self._numbers()
        kept = [m for v in numbers[-keep:] if (m := self.manifest(v)) is not None]
        for v in numbers[:-keep]:
            self._fs.delete(self._file(v), False)
        gone = 0
        for kind in ("segments", "deletions", "codes", "books"):
            base, named = self._path(f"{self.root}/{kind}"), {p["id"] for m in kept for p in (m[kind] if kind != "books" else [m["book"]] if m["book"] else [])}
            for f in self._fs.listStatus(base) if self._fs.exists(base) else []:
                if f.getPath().getName() not in named and time.time() - f.getModificationTime() / 1000 > STALE:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone

    # ---- lexical queries

    def index(self, manifest: dict | None = None) -> SegmentIndex:
        return SegmentIndex(self, manifest or self.head())


def _blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "part").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most_tf"), F.min("doc_len").alias("least_len"))


class SegmentIndex:
    """BM25 over the postings of one manifest. Files are in order of term: only the pages that may have a term are read."""

    key = "doc_id"

    def __init__(self, store: SegmentStore, manifest: dict):
        self.store, self.manifest = store, manifest
        self.n_docs, self.mean_len = manifest["docs"], manifest["words"] / max(1, manifest["docs"])

    def _held(self, segment: dict, terms: Sequence[str]) -> DataFrame:
        """The postings of these terms in a segment, dead ones too."""
        return self.store.spark.read.schema(POSTINGS).parquet(f"{self.store.root}/segments/{segment['id']}/postings").where(F.col("term").isin(list(terms)))

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """term, doc_id, doc_len, tf: live postings of these terms."""
        parts = [self._held(s, terms).withColumn("__seq", F.lit(s["seq"]).cast("long")) for s in self.manifest["segments"] if s["docs"] and terms]
        if not parts:
            return self.store.spark.createDataFrame([], "term string, doc_id string, doc_len int, tf long")
        return self.store._alive(reduce(DataFrame.unionByName, parts), self.manifest, "doc_id").select("term", "doc_id", "doc_len", "tf")

    # ---- the k best, without reading what cannot be among them

    def bounds(self, terms: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
        """segment, part and the most that a document there can score, as a table; and how many live documents have each term."""
        spark, parts = self.store.spark, []
        for s in self.manifest["segments"]:
            if not s["docs"]:
                continue
            base = f"{self.store.root}/segments/{s['id']}"
            stored = spark.read.parquet(f"{base}/blocks").where(F.col("term").isin(list(terms)))
            often = [r.term for r in stored.select("term").distinct().collect()]  # of the query's terms
            rare = [t for t in terms if t not in often]
            if rare:  # few postings each
                stored = stored.unionByName(_blocks(self._held(s, rare)))
            parts.append(stored.withColumn("segment", F.lit(s["id"])))
        if not parts:
            return spark.createDataFrame([], "segment string, part long, bound double"), {}
        blocks = reduce(DataFrame.unionByName, parts)
        if any(d["docs"] for d in self.manifest["deletions"]):
            df = self.postings(terms).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        else:
            df = blocks.groupBy("term").agg(F.sum("df").alias("n"))
        counts = {r.term: r.n for r in df.collect()}  # of the query's terms
        each = F.create_map(*[x for t, n in counts.items() for x in (F.lit(t), F.lit(n))]) if counts else F.lit(None).cast("map<string,bigint>")
        most = ranking.bm25(F.col("most_tf"), each[F.col("term")], F.col("least_len"), F.lit(self.n_docs), F.lit(self.mean_len))
        return blocks.groupBy("segment", "part").agg(F.sum(most).alias("bound")), counts

    def _scored(self, terms: Sequence[str], chosen: list[tuple[str, int]] | DataFrame, counts: dict[str, int]) -> DataFrame:
        """doc_id, bm25 of the live documents of some parts."""
        spark, parts = self.store.spark, []
        by_segment: dict[str, list[int]] = {}
        for segment, part in chosen if isinstance(chosen, list) else ():
            by_segment.setdefault(segment, []).append(part)
        for s in self.manifest["segments"]:
            if not s["docs"] or (isinstance(chosen, list) and s["id"] not in by_segment):
                continue
            rows = self._held(s, terms)
            rows = rows.where(F.col("part").isin(by_segment[s["id"]])) if isinstance(chosen, list) else rows.join(chosen.where(F.col("segment") == s["id"]).select("part"), "part", "left_semi")
            parts.append(rows.withColumn("__seq", F.lit(s["seq"]).cast("long")))
        if not parts or not counts:
            return spark.createDataFrame([], "doc_id string, bm25 double")
        each = F.create_map(*[x for t, n in counts.items() for x in (F.lit(t), F.lit(n))])
        live = self.store._alive(reduce(DataFrame.unionByName, parts), self.manifest, "doc_id")
        one = ranking.bm25(F.col("tf"), each[F.col("term")], F.col("doc_len"), F.lit(self.n_docs), F.lit(self.mean_len))
        return live.select("doc_id", one.alias("part_score")).groupBy("doc_id").agg(F.sum("part_score").alias("bm25"))

    def top(self, terms: Sequence[str], k: int, among: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
        """doc_id, bm25 of the k best documents at least (by bm25 to six places, then by doc_id), among those of a table (doc_id) if given; and how many parts there were and were read.

        The parts of the highest bounds are scored first; the k-th score is the threshold below which a part is left out."""
        bounds, counts = self.bounds(terms)
        bounds = bounds.cache()
        try:
            total = bounds.count()
            first = [(r.segment, r.part) for r in bounds.orderBy(F.desc("bound"), "segment", "part").limit(FIRST_PARTS).collect()]
            within = lambda scores: scores if among is None else scores.join(among.select("doc_id"), "doc_id", "left_semi")
            best = within(self._scored(terms, first, counts)).withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), "doc_id").limit(k).collect()
            least = best[-1].bm25 if len(best) >= k > 0 else float("-inf")
            seen = self.store.spark.createDataFrame(first, "segment string, part long")
            rest = bounds.where(F.col("bound") >= least - 2e-6).join(F.broadcast(seen), ["segment", "part"], "left_anti")
            n = rest.count() if total > len(first) else 0
            found = self.store.spark.createDataFrame(best, "doc_id string, bm25 double")
            if n:
                chosen = [(r.segment, r.part) for r in rest.select("segment", "part").collect()] if n <= LISTED else rest.select("segment", "part")
                more = within(self._scored(terms, chosen, counts)).withColumn("bm25", F.round("bm25", 6)).orderBy(F.desc("bm25"), "doc_id").limit(k)
                found = self.store.spark.createDataFrame([*best, *more.collect()], "doc_id string, bm25 double")  # 2 k rows
            return found, {"parts": total, "read": len(first) + n}
        finally:
            bounds.unpersist()

    def near(self, terms: Sequence[str]) -> DataFrame | None:
        """term, meant: the words of the vocabulary near a query's terms; only the words of the segments are compared."""
        query = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
        close = F.filter(query, lambda t: (F.abs(F.length("term") - F.length(t)) <= 2) & (F.levenshtein(F.col("term"), t) <= allowed(t)))
        held = self.store._of(self.manifest, "words")
        return None if held is None or not terms else held.select("term").distinct().select("term", F.explode(close).alias("meant"))

    def matches(self, terms: Sequence[str], typos: bool = False) -> DataFrame:
        """doc_id, doc_len, term, tf; with typos, words near a term count as that term."""
        if not typos or (near := self.near(terms)) is None:
            return self.postings(terms)
        few = near.limit(LISTED + 1).collect()
        if len(few) <= LISTED:  # only the pages of these words are read
            words = F.broadcast(self.store.spark.createDataFrame(few, near.schema))
            held = self.postings(sorted({r.term for r in few}))
        else:
            n = near.count()
            words = _small(near, n)  # postings of other words go before the dead ones are joined
            held = self.store._of(self.manifest, "postings").join(_small(near.select("term").distinct(), n), "term", "left_semi")
            held = self.store._alive(held, self.manifest, "doc_id")
        return held.join(words, "term").groupBy("doc_id", "doc_len", F.col("meant").alias("term")).agg(F.sum("tf").alias("tf"))

    def scores(self, terms: Sequence[str], typos: bool = False) -> DataFrame:
        """doc_id, bm25."""
        tf = self.matches(terms, typos)
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per query term
        one = ranking.bm25(F.col("tf"), F.col("df"), F.col("doc_len"), F.lit(self.n_docs), F.lit(self.mean_len))
        return tf.join(F.broadcast(df), "term").select("doc_id", one.alias("part")).groupBy("doc_id").agg(F.sum("part").alias("bm25"))


def allowed(term: Column) -> Column:
    """Edits that a word may be away from a term."""
    return F.when(F.length(term) < 4, 0).when(F.length(term) < 8, 1).otherwise(2)
