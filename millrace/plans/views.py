"""The driver's tables as the engine's corpus, for the query catalogue; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lexical_index import LexicalIndex
from millrace.operators.segments import SegmentStore
from millrace.operators.vector_index import VectorIndex
from millrace.plans.session import shared_folder

#: 2024-02-01 00:00 UTC, the present of every query.
AS_OF = 1706745600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _age(key: str):
    return F.when(F.col(key) % 10 != 0, F.lit(AS_OF) - (F.col(key) % 720) * 86400)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("source_id"), F.col("lang").alias("repo"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("text").alias("modality"), F.left("text", F.lit(4000)).alias("snippet"), "text", F.lit("").alias("derived_from"), _age("doc_id").alias("content_modified_ts"),
    )


DOCS = f"""d as (select doc_id, source as source_id, lang as repo, lang || '/' || doc_id || '.txt' as path, 'text' as modality, left(text, 4000) as snippet, text,
  '' as derived_from, case when doc_id % 10 <> 0 then {AS_OF} - (doc_id % 720) * 86400 end as content_modified_ts from documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    return e.select(
        "vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("s"), (n % 5).cast("string")).alias("source_id"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("repo"),
        F.concat(F.lit("p"), (n % 50).cast("string"), F.lit("/"), n.cast("string"), F.lit(".md")).alias("path"), F.when(n % 7 == 0, "image").otherwise("text").alias("modality"), _age("vec_id").alias("content_modified_ts"),
    )


VECTORS = f"""v as (select vec_id, embedding::double[] as vector, 's' || (vec_id % 5) as source_id, 'r' || label as repo, 'p' || (vec_id % 50) || '/' || vec_id || '.md' as path,
  case when vec_id % 7 = 0 then 'image' else 'text' end as modality, case when vec_id % 10 <> 0 then {AS_OF} - (vec_id % 720) * 86400 end as content_modified_ts from embeddings)"""

COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
QUERY_VECTOR = "q as (select embedding::double[] as q from embeddings where vec_id = 0)"
TERMS = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def query_text(spark: SparkSession, sf_dir: str, item: int = 0) -> str:
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") == item).select("text").first()[0]


_BUILT: dict[tuple, object] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table from another: its files with their sizes and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p.suffix("/*")) or []
    own = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    return tuple((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in [own, *files])


def _once(spark: SparkSession, sf_dir: str, name: str, build, kind: str = "index"):
    """An index is built when a session first needs it, in the shared folder, and again when its table has changed."""
    key = (spark.sparkContext.applicationId, kind, name, _state(spark, f"{sf_dir}/{name}.parquet"))
    if key not in _BUILT:
        _BUILT[key] = build(shared_folder(spark, f"{kind}-{name}"))
    return _BUILT[key]


def lexical_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    return _once(spark, sf_dir, "documents", lambda path: LexicalIndex.build(docs(spark, sf_dir), path))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return _once(spark, sf_dir, "embeddings", lambda path: VectorIndex.build(vectors(spark, sf_dir), path, "vec_id"))


#: What the second commit of revised() adds to the documents that it replaces.
REVISION = " revised: the mill wheel turns again"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, as the store takes it."""
    d = docs(spark, sf_dir)
    chunk = F.concat_ws(":", F.col("source_id"), F.col("path"), F.lit("0"))
    return d.select(chunk.alias("chunk_id"), *(c for c in d.columns if c not in ("doc_id", "text")), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("number"))


def revised(spark: SparkSession, sf_dir: str) -> tuple[SegmentStore, dict, dict]:
    """All documents put into a store, then every fifth replaced, every seventh removed, and every 35th put in again: the store with its manifests before and after compaction."""

    def build(path: str) -> tuple[SegmentStore, dict, dict]:
        store, all_ = SegmentStore(spark, path), points(spark, sf_dir)
        store.upsert(all_)
        store.upsert(all_.where("number % 5 = 0").withColumn("content", F.concat("content", F.lit(REVISION))))
        store.upsert(all_.limit(0), all_.where("number % 7 = 0").select("source_id", "path"))
        before = store.upsert(all_.where("number % 35 = 0"))
        return store, before, store.compact(everything=True)

    return _once(spark, sf_dir, "documents", build, "segments")


REVISED = f"""{DOCS}, r as (select doc_id, path, case when doc_id % 5 = 0 and doc_id % 35 <> 0 then coalesce(text, '') || '{REVISION}' else coalesce(text, '') end as text
  from d where doc_id % 7 <> 0 or doc_id % 35 = 0), phases as (select unnest(['before', 'after']) as phase)"""
