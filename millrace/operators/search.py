"""Semantic and lexical top-k, with filters, freshness and paging."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from millrace.functions import ranking, text

PAYLOAD = ("chunk_id", "source_id", "repo", "path", "modality", "snippet", "derived_from", "content_modified_ts")


def filtered(rows: DataFrame, as_of: int | None = None, max_age_days: int | None = None, path_prefix: str | None = None, **equal: str | None) -> DataFrame:
    """Equality, prefix and age filters, all before any limit. With an age limit, rows of unknown age go."""
    out = rows
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    if path_prefix:
        out = out.where(F.col("path").startswith(path_prefix))
    if max_age_days is not None and max_age_days >= 0:
        if as_of is None:
            raise ValueError("an age limit needs as_of")
        out = out.where(F.col("content_modified_ts") >= ranking.cutoff(as_of, max_age_days))
    return out


def rerank(hits: DataFrame, as_of: int, boost: float, k: int, tie: str) -> DataFrame:
    """score_final blends the score with freshness; the k best stay."""
    fresh = ranking.freshness(F.col("content_modified_ts"), as_of)
    return hits.withColumn("score_final", ranking.blended(F.col("score"), fresh, boost)).orderBy(F.desc("score_final"), tie).limit(k)


def semantic(
    vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.0, tie: str = "chunk_id", as_of: int | None = None,
    freshness_boost: float = 0.0, max_age_days: int | None = None, path_prefix: str | None = None, **equal: str | None,
) -> DataFrame:
    """The k rows nearest by cosine with score >= threshold. Exact: a filtered scan and a bounded heap per task."""
    rows = filtered(vectors, as_of, max_age_days, path_prefix, **equal)
    boost = ranking.clamp(freshness_boost)
    scored = rows.withColumn("score", ranking.cosine_to(F.col("vector"), query)).drop("vector").where(F.col("score") >= threshold)
    hits = scored.orderBy(F.desc("score"), tie).limit(ranking.fetch_size(k, boost))
    return rerank(hits, as_of, boost, k, tie) if boost > 0 else hits


#: Queries whose vectors a task holds at once.
QUERY_BLOCK = 4096


def semantic_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, tie: str = "chunk_id", route: Callable[[np.ndarray], Sequence[int]] | None = None) -> DataFrame:
    """queries: query_id, query_vector, a stated set, met in blocks of QUERY_BLOCK. The k best per query.

    Each task multiplies its batches with the block's matrix and keeps the k best of each query over all its batches, so at
    most k rows for each query and *task* are shuffled, and merged once. route: gives the cells that a query is sent to; rows
    (with a column `cell`) of other cells are not multiplied with it."""
    kinds = {f.name: f.dataType for f in [*vectors.select(tie).schema, *queries.select("query_id").schema]}
    schema = StructType([StructField("query_id", kinds["query_id"]), StructField(tie, kinds[tie]), StructField("score", DoubleType())])
    spark, blocks = vectors.sparkSession, max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.select("query_id", "query_vector").withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    narrow, found = vectors.select(tie, "vector", *(["cell"] if route else [])), []
    for block in range(blocks):
        own = dealt.where(F.col("__b") == block).toArrow()  # about QUERY_BLOCK rows
        ids, rows = own.column("query_id").combine_chunks(), own.column("query_vector").combine_chunks()
        width = pc.max(pc.list_value_length(rows)).as_py() or 1
        matrix = _unit_rows(rows, width)
        sent: dict[int, list[int]] = {}
        for i, q in enumerate(matrix if route else ()):
            for c in route(q):
                sent.setdefault(int(c), []).append(i)
        held = spark.sparkContext.broadcast((ids, matrix, width, sent if route else None))

        def best(batches, held=held):
            ids, matrix, width, sent = held.value
            heap = _Best(len(ids), k, threshold)
            for b in batches:
                x = _unit_rows(b.column(1), width)
                if sent is None:
                    heap.add(x @ matrix.T, b.column(0), np.arange(len(x)), np.arange(len(ids)))
                    continue
                cells = b.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cells).tolist():
                    if wanted := sent.get(int(c)):
                        mine = np.flatnonzero(cells == c)
                        heap.add(x[mine] @ matrix[wanted].T, b.column(0), mine, np.array(wanted))
            query, keys, score = heap.all()
            if len(query):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), keys, pa.array(score)], ["query_id", tie, "score"])

        chosen = narrow.where(F.col("cell").isin(sorted(sent))) if route and len(sent) <= LISTED_CELLS else narrow
        found.append(chosen.mapInArrow(best, schema))
    every = reduce(DataFrame.unionByName, found)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie)))
    return ranked.where(F.col("rank") <= k).select("query_id", tie, "score", "rank")


#: Cells that are named in a filter, so that the files' statistics spare others.
LISTED_CELLS = 2000


class _Best:
    """The k best keys of each of n queries, of equal scores those with the least keys."""

    def __init__(self, n: int, k: int, threshold: float):
        self.k, self.least, self.parts, self.size = max(0, k), np.full(n, float(threshold)), [], 0
        self.most = max(1 << 16, 4 * n * max(1, k))

    def add(self, score: np.ndarray, keys: pa.Array, rows: np.ndarray, queries: np.ndarray) -> None:
        """score: rows by queries."""
        if not self.k or not score.size:
            return
        floor = self.least[queries]
        if len(rows) > self.k:  # a row below the k-th of this batch cannot stay; ties may
            floor = np.maximum(floor, np.partition(score, len(rows) - self.k, 0)[len(rows) - self.k])
        at, query = np.nonzero(score >= floor[None])
        if len(at):
            self.parts.append((queries[query], keys.take(pa.array(rows[at])), score[at, query]))
            self.size += len(at)
            if self.size > self.most:
                self._prune()

    def _prune(self) -> None:
        query, keys, score = self.all()
        self.parts, self.size = [(query, keys, score)], len(query)
        full = np.bincount(query, minlength=len(self.least)) >= self.k
        lowest = np.full(len(self.least), np.inf)
        np.minimum.at(lowest, query, score)
        self.least = np.where(full, np.maximum(self.least, lowest), self.least)

    def all(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), pa.array([]), np.zeros(0)
        query, score = (np.concatenate([p[k] for p in self.parts]) for k in (0, 2))
        keys = pa.concat_arrays([p[1] for p in self.parts])
        order = pc.sort_indices(pa.table({"q": query, "s": -score, "k": keys}), sort_keys=[("q", "ascending"), ("s", "ascending"), ("k", "ascending")], null_placement="at_start").to_numpy()
        query, score = query[order], score[order]
        first = np.searchsorted(query, query, "left")
        kept = np.arange(len(query)) - first < self.k
        return query[kept], keys.take(pa.array(order[kept])), score[kept]


def _unit_rows(rows: pa.Array, width: int) -> np.ndarray:
    """Rows of length 1; zeros for null and for another width."""
    out = np.zeros((len(rows), width))
    same = pc.fill_null(pc.equal(pc.list_value_length(rows), width), False)
    out[same.to_numpy(zero_copy_only=False)] = pc.fill_null(rows.filter(same).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    size = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out / np.where(size > 0, size, 1)


def query_terms(query: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def lexical_scores(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", content: str = "text", typos: bool = False) -> DataFrame:
    """key, score: BM25 of the documents that hold a query term. Only occurrences of query terms leave the scan; lengths are summed there.

    With typos, words near a query term (one edit from 4 characters, two from 8) count as that term."""
    words = docs.select(F.col(key), ranking.terms(F.col(content)).alias("__t")).withColumn("doc_len", F.size("__t"))
    totals = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("mean_len"))
    query = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    if typos:
        near = lambda w, t: F.levenshtein(w, t) <= F.when(F.length(t) < 4, 0).when(F.length(t) < 8, 1).otherwise(2)
        hits = words.select(key, "doc_len", F.explode("__t").alias("word")).select(key, "doc_len", F.explode(F.filter(query, lambda t: near(F.col("word"), t))).alias("term"))
    else:
        hits = words.select(key, "doc_len", F.explode(F.filter("__t", lambda w: F.array_contains(query, w))).alias("term"))
    tf = hits.groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per query term
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    one = ranking.bm25(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n_docs"), F.col("mean_len"))
    return scored.select(key, "term", one.alias("part")).groupBy(key).agg(F.sum("part").alias("bm25"))


def lexical(
    docs: DataFrame, query: str, limit: int = 20, offset: int = 0, key: str = "doc_id", content: str = "text", typos: bool = False, as_of: int | None = None,
    freshness_boost: float = 0.0, max_age_days: int | None = None, path_prefix: str | None = None, index=None, **equal: str | None,
) -> DataFrame:
    """Pages of documents by BM25 over whole texts, with highlights; through a LexicalIndex if one is given, else by a scan. A freshness boost scores ranks: 1 for the first, falling evenly over the fetched page."""
    terms = query_terms(query)
    rows = filtered(docs, as_of, max_age_days, path_prefix, **equal)
    boost = ranking.clamp(freshness_boost)
    if index is not None and not typos and hasattr(index, "top"):  # reads only what may be among the hits
        narrowed = path_prefix or max_age_days is not None or any(v is not None for v in equal.values())
        scores = F.broadcast(index.top(terms, ranking.fetch_size(limit, boost) + offset, rows.select(key) if narrowed else None)[0])
    else:
        scores = lexical_scores(docs, terms, key, content, typos) if index is None else index.scores(terms, typos)
    best = scores.withColumn("bm25", F.round("bm25", 6))
    hits = rows.join(best, key).orderBy(F.desc("bm25"), key)
    hits = hits.limit(limit + offset).offset(offset) if boost <= 0 else hits.limit(ranking.fetch_size(limit, boost) + offset).offset(offset)
    hits = hits.withColumn("highlight", text.highlight(F.col(content), terms))
    if boost <= 0:
        return hits
    order = Window.orderBy(F.desc("bm25"), key)  # at most MOST_FETCH rows
    whole = Window.partitionBy()
    ranked = hits.withColumn("score", 1 - (F.row_number().over(order) - 1) / F.count(F.lit(1)).over(whole))
    return rerank(ranked, as_of, boost, limit, key)


def projected(hits: DataFrame, extra: Sequence[str] = ("score",)) -> DataFrame:
    """The result columns; an empty derived_from is null."""
    out = hits.withColumn("derived_from", F.nullif("derived_from", F.lit(""))) if "derived_from" in hits.columns else hits
    return out.select(*[c for c in (*PAYLOAD, *extra) if c in out.columns])
