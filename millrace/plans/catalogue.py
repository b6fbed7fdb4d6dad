"""Named queries over the driver's tables, with the SQL that computes the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from millrace.functions import identity, ranking, text, urls
from millrace.operators import cdc, chunking, crawl, extract, hybrid, index, routing, search
from millrace.plans import sqltext as S
from millrace.plans.views import AS_OF, COSINE, DOCS, QUERY_VECTOR, REVISED, TERMS, VECTORS, docs, lexical_index, query_text, query_vector, revised, table, vector_index, vectors
from millrace.sources import folder
from millrace.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- semantic search

_SCORED = f"with {VECTORS}, {QUERY_VECTOR}, s as (select v.*, {COSINE.format(a='vector', b='q')} as score from v, q)"


@query(f"{_SCORED} select vec_id, path, round(score, 6) as score from s order by s.score desc, vec_id limit 10")
def semantic_topk(spark, d):
    return search.semantic(vectors(spark, d), query_vector(spark, d), 10, -1.0, "vec_id").select("vec_id", "path", F.round("score", 6).alias("score"))


@query(f"{_SCORED} select vec_id, path, round(score, 6) as score from s order by s.score desc, vec_id limit 10")
def semantic_indexed(spark, d):
    """Through the cells of the vector index, all of them, so exactly."""
    return vector_index(spark, d).search(query_vector(spark, d), 10, None, -1.0).select("vec_id", "path", F.round("score", 6).alias("score"))


@query(f"{_SCORED} select vec_id, repo, path, round(score, 6) as score from s where modality = 'text' and repo = 'r1' and source_id in ('s1', 's2', 's3') and path like 'p1%' order by s.score desc, vec_id limit 10")
def semantic_filtered(spark, d):
    rows = vectors(spark, d).where(F.col("source_id").isin("s1", "s2", "s3"))
    return search.semantic(rows, query_vector(spark, d), 10, -1.0, "vec_id", modality="text", repo="r1", path_prefix="p1").select("vec_id", "repo", "path", F.round("score", 6).alias("score"))


@query(f"{_SCORED} select vec_id, round(score, 6) as score from s where score >= 0.2 order by s.score desc, vec_id limit 25")
def semantic_threshold(spark, d):
    return search.semantic(vectors(spark, d), query_vector(spark, d), 25, 0.2, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


_FRESH = f"(case when content_modified_ts is null then 0.5 else exp(-greatest(0.0, ({AS_OF} - content_modified_ts) / 86400.0) / 180.0) end)"


@query(f"""{_SCORED}, f as (select *, score * 0.7 + {_FRESH} * 0.3 as score_final from (select * from s order by score desc, vec_id limit 40))
select vec_id, round(score, 6) as score, round(score_final, 6) as score_final from f order by f.score_final desc, vec_id limit 10""")
def semantic_fresh(spark, d):
    return search.semantic(vectors(spark, d), query_vector(spark, d), 10, -1.0, "vec_id", AS_OF, 0.3).select("vec_id", F.round("score", 6).alias("score"), F.round("score_final", 6).alias("score_final"))


@query(f"{_SCORED} select vec_id, content_modified_ts, round(score, 6) as score from s where content_modified_ts >= {AS_OF - 90 * 86400} order by s.score desc, vec_id limit 10")
def semantic_max_age(spark, d):
    return search.semantic(vectors(spark, d), query_vector(spark, d), 10, -1.0, "vec_id", AS_OF, max_age_days=90).select("vec_id", "content_modified_ts", F.round("score", 6).alias("score"))


@query(f"""with {VECTORS}, qs as (select vec_id as query_id, vector as qv from v where vec_id % 100 = 0),
s as (select query_id, vec_id, {COSINE.format(a='vector', b='qv')} as score from v, qs)
select query_id, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by s.score desc, vec_id) as rank from s
qualify row_number() over (partition by query_id order by s.score desc, vec_id) <= 5""")
def semantic_batch_topk(spark, d):
    v = vectors(spark, d)
    qs = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.semantic_batch(v, qs, 5, -1.0, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_BATCH = f"""with {VECTORS}, qs as (select vec_id as query_id, vector as qv from v where vec_id % 100 = 0),
s as (select query_id, vec_id, {COSINE.format(a='vector', b='qv')} as score from v, qs),
t as (select query_id, vec_id, row_number() over (partition by query_id order by s.score desc, vec_id) as rank from s qualify rank <= 10)"""


def _recall(spark, d, found):
    """query_id, whether at least nine in ten of the ten nearest rows of all were found, over all queries together."""
    v = vectors(spark, d)
    qs = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    exact = search.semantic_batch(v, qs, 10, -1.0, "vec_id").select("query_id", "vec_id")
    hits = exact.join(found(qs).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("wanted"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("nine_in_ten"))


@query(f"{_BATCH} select count(*) as wanted, true as nine_in_ten from t")
def semantic_cells_recall(spark, d):
    """Batch search through as many cells as tuning on other rows asks for, against the exact answer over all rows: recall of the ten best."""
    ix = vector_index(spark, d)
    return _recall(spark, d, lambda qs: ix.batch(qs, 10, ix.probes_for(0.97), -1.0))


@query(f"{_BATCH} select query_id, vec_id, rank from t")
def semantic_cells_batch(spark, d):
    """Batch search with every query sent to all cells: the exact answer."""
    qs = vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    ix = vector_index(spark, d)
    return ix.batch(qs, 10, len(ix.codebook.leaves()), -1.0).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {VECTORS} select vec_id, round({_FRESH}, 6) as freshness, round(0.4 * 0.5 + 0.5 * {_FRESH}, 6) as blended from v")
def freshness_scores(spark, d):
    fresh = ranking.freshness(F.col("content_modified_ts"), AS_OF)
    return vectors(spark, d).select("vec_id", F.round(fresh, 6).alias("freshness"), F.round(ranking.blended(F.lit(0.4), fresh, 0.5), 6).alias("blended"))


# ---- lexical search

_BM25 = f"""{DOCS}, w as (select doc_id, {TERMS.format(x='text')} as ws from d),
qt as (select distinct unnest({TERMS.format(x='text')}) as term from benchmark where item_id = 0),
tot as (select count(*) as n, avg(len(ws)) as m from w), x as (select doc_id, len(ws) as dl, unnest(ws) as term from w),
tf as (select doc_id, dl, term, count(*) as tf from x where term in (select term from qt) group by all), df as (select term, count(*) as df from tf group by 1),
b as (select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) as bm25 from tf join df using (term), tot group by 1)"""


@query(f"with {_BM25} select doc_id, bm25 from b order by bm25 desc, doc_id limit 20")
def lexical_bm25(spark, d):
    return search.lexical(docs(spark, d), query_text(spark, d), index=lexical_index(spark, d)).select("doc_id", "bm25")


@query(f"with {_BM25} select doc_id, path, bm25 from b join d using (doc_id) where repo = 'en' order by bm25 desc, doc_id limit 10 offset 10")
def lexical_paged(spark, d):
    return search.lexical(docs(spark, d), query_text(spark, d), 10, 10, index=lexical_index(spark, d), repo="en").select("doc_id", "path", "bm25")


@query(f"""with {_BM25}, h as (select doc_id, bm25, content_modified_ts from b join d using (doc_id) order by bm25 desc, doc_id limit 80),
r as (select doc_id, content_modified_ts, 1 - (row_number() over (order by bm25 desc, doc_id) - 1) / (count(*) over ())::double as score from h),
f as (select doc_id, score, score * 0.5 + {_FRESH} * 0.5 as score_final from r)
select doc_id, round(score, 6) as score, round(score_final, 6) as score_final from f order by f.score_final desc, doc_id limit 20""")
def lexical_rank_score(spark, d):
    return search.lexical(docs(spark, d), query_text(spark, d), 20, as_of=AS_OF, index=lexical_index(spark, d), freshness_boost=0.5).select("doc_id", F.round("score", 6).alias("score"), F.round("score_final", 6).alias("score_final"))


@query(f"""with {DOCS}, w as (select doc_id, {TERMS.format(x='text')} as ws from d), qt as (select unnest(['tion', 'worthles', 'patheticc']) as term),
tot as (select count(*) as n, avg(len(ws)) as m from w), x as (select doc_id, len(ws) as dl, unnest(ws) as word from w),
tf as (select doc_id, dl, term, count(*) as tf from x join qt on levenshtein(regexp_replace(word, '[^\\x00-\\x7f]', '~', 'g'), term) <= case when length(term) < 4 then 0 when length(term) < 8 then 1 else 2 end group by all),
df as (select term, count(*) as df from tf group by 1),
b as (select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) as bm25 from tf join df using (term), tot group by 1)
select doc_id, bm25 from b order by bm25 desc, doc_id limit 20""")
def lexical_typo(spark, d):
    return search.lexical(docs(spark, d), "tion worthles patheticc", typos=True, index=lexical_index(spark, d)).select("doc_id", "bm25")


@query(f"with {_BM25} select doc_id, bm25 from b order by bm25 desc, doc_id limit 20")
def lexical_scan(spark, d):
    """Without an index: one more scan of the texts."""
    return search.lexical(docs(spark, d), query_text(spark, d)).select("doc_id", "bm25")


def _phases(spark, d, of):
    """What `of` gives for the manifest before compaction and for the one after it."""
    store, before, after = revised(spark, d)
    return of(store, before).withColumn("phase", F.lit("before")).unionByName(of(store, after).withColumn("phase", F.lit("after")))


@query(f"with {REVISED}, w as (select *, {TERMS.format(x='text')} as ws from r) select phase, path, md5(text) as digest, len(ws) as words from w, phases")
def segment_rows(spark, d):
    """The live rows of the store of segments after replacements, deletions and one more insertion, before and after compaction."""
    return _phases(spark, d, lambda store, m: store.rows(m).select("path", F.md5("content").alias("digest"), F.col("doc_len").cast("long").alias("words")))


@query(f"""with {REVISED}, w as (select path, {TERMS.format(x='text')} as ws from r), qt as (select distinct unnest({TERMS.format(x='text')}) as term from benchmark where item_id = 0),
tot as (select count(*) as n, avg(len(ws)) as m from w), x as (select path, len(ws) as dl, unnest(ws) as term from w),
tf as (select path, dl, term, count(*) as tf from x where term in (select term from qt union all select unnest(['mill', 'revised'])) group by all), df as (select term, count(*) as df from tf group by 1),
b as (select path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) as bm25 from tf join df using (term), tot group by 1)
select phase, path, bm25 from b, phases""")
def segment_bm25(spark, d):
    """BM25 of all documents that hold a query term, over the postings of the segments before and after compaction."""
    terms = search.query_terms(query_text(spark, d) + " mill revised")
    return _phases(spark, d, lambda store, m: store.index(m).scores(terms).join(store.rows(m).select("doc_id", "path"), "doc_id").select("path", F.round("bm25", 6).alias("bm25")))


@query(f"""with {REVISED}, w as (select path, {TERMS.format(x='text')} as ws from r), qt as (select distinct unnest({TERMS.format(x='text')}) as term from benchmark where item_id = 0),
tot as (select count(*) as n, avg(len(ws)) as m from w), x as (select path, len(ws) as dl, unnest(ws) as term from w),
tf as (select path, dl, term, count(*) as tf from x where term in (select term from qt) group by all), df as (select term, count(*) as df from tf group by 1),
b as (select path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))), 6) as bm25 from tf join df using (term), tot group by 1)
select phase, bm25, row_number() over (partition by phase order by bm25 desc) as rank from b, phases qualify rank <= 20""")
def segment_top(spark, d):
    """The scores of the 20 best documents, from the parts of the postings whose bounds let them hold one, before and after compaction."""
    terms = search.query_terms(query_text(spark, d))
    best = _phases(spark, d, lambda store, m: store.index(m).top(terms, 20)[0])
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("bm25"), "doc_id")))
    return ranked.where("rank <= 20").select("phase", "bm25", F.col("rank").cast("long").alias("rank"))


@query(r"""with x as (select doc_id, regexp_replace(text, '([^\p{L}\p{N}_]|^)(the|of|und|les)', '\1' || chr(1) || '\2', 'gi') as t from documents)
select doc_id, md5(regexp_replace(regexp_replace(t, chr(1) || '(the|of|und|les)([\p{L}\p{N}_])', '\1\2', 'gi'), chr(1) || '(the|of|und|les)', '<em>\1</em>', 'gi')) as digest from x""")
def highlights(spark, d):
    return docs(spark, d).select("doc_id", F.md5(text.highlight(F.col("text"), ["the", "of", "und", "les"])).alias("digest"))


@query(f"with {DOCS}, w as (select doc_id, {TERMS.format(x='text')} as ws from d), x as (select doc_id, len(ws) as doc_len, unnest(ws) as term from w) select term, doc_id, doc_len, count(*) as tf from x group by all")
def postings(spark, d):
    return index.postings(docs(spark, d)).select("term", "doc_id", F.col("doc_len").cast("long").alias("doc_len"), "tf")


# ---- hybrid retrieval


def _legs(spark, d):
    """Vectors stand for the documents of the same number; a query is vector 0 and benchmark text 0."""
    base = docs(spark, d).select("doc_id", "source_id", "repo", "path", "snippet", "text", "content_modified_ts")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    order = Window.orderBy(F.desc("score"), "doc_id")
    sem = search.semantic(base.drop("text").join(v, "doc_id"), query_vector(spark, d), 15, hybrid.THRESHOLD - 0.15, "doc_id").withColumn("pos", F.row_number().over(order) - 1)
    lex = search.lexical(base, query_text(spark, d), 15, index=lexical_index(spark, d)).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("bm25"), "doc_id")) - 1)
    return sem, lex


_LEGS = f"""{_BM25}, {QUERY_VECTOR}, s0 as (select d.*, {COSINE.format(a='embedding::double[]', b='q')} as score from d join embeddings e on e.vec_id = d.doc_id, q),
sem as (select *, row_number() over (order by score desc, doc_id) - 1 as pos from s0 where score >= 0.1 order by score desc, doc_id limit 15),
lex as (select d.*, bm25, row_number() over (order by bm25 desc, doc_id) - 1 as pos from b join d using (doc_id) order by bm25 desc, doc_id limit 15),
m as (select coalesce(s.doc_id, l.doc_id) as doc_id, coalesce(s.source_id, l.source_id) as source_id, coalesce(s.path, l.path) as path, coalesce(s.snippet, l.snippet) as snippet,
  coalesce(s.score, 0) as semantic_score, case when l.doc_id is not null then 0.5 else 0 end as lexical_score, case when s.doc_id is null then 1 else 0 end as leg, coalesce(s.pos, l.pos) as pos
  from sem s full join lex l on s.doc_id = l.doc_id),
c as (select *, semantic_score * 0.7 + lexical_score * (1.0 - 0.7) as combined_score, split_part(path, '/', 1) || '/' || (doc_id % 7) as folder from m)"""


@query(f"with {_LEGS} select doc_id, path, round(semantic_score, 6) as semantic_score, round(lexical_score, 6) as lexical_score, round(combined_score, 6) as combined_score from c")
def hybrid_merge(spark, d):
    m = hybrid.merge(*_legs(spark, d))
    return m.select("doc_id", "path", *[F.round(c, 6).alias(c) for c in ("semantic_score", "lexical_score", "combined_score")])


def _merged(spark, d):
    """Several chunks share a path here, so that grouping by path has work to do."""
    m = hybrid.merge(*_legs(spark, d))
    return m.withColumn("path", F.concat(F.get(F.split("path", "/"), F.lit(0)), F.lit("/"), (F.col("doc_id") % 7).cast("string")))


_BEST = f"""{_LEGS}, p as (select *, row_number() over (order by combined_score desc, leg, pos) as path_rank from
  (select * from c qualify row_number() over (partition by folder order by combined_score desc, leg, pos) = 1))"""


@query(f"with {_BEST} select path_rank, folder as path, doc_id, round(combined_score, 6) as combined_score from p")
def hybrid_best_per_path(spark, d):
    return hybrid.best_per_path(_merged(spark, d)).select(F.col("path_rank").cast("long").alias("path_rank"), "path", "doc_id", F.round("combined_score", 6).alias("combined_score"))


_USED = f"""{_BEST}, t as (select path_rank, folder as path, source_id, combined_score, {S.strip('snippet')} as snippet from p),
u as (select *, coalesce(sum(length(snippet) + length(path) + 20) over (order by path_rank rows between unbounded preceding and 1 preceding), 0) as before from t where snippet <> ''),
k as (select path_rank, path, source_id, combined_score, case when length(snippet) > 6000 - before then left(snippet, (6000 - before)::int) || '...' else snippet end as snippet from u where before < 6000)"""


@query(f"""with {_USED} select coalesce(string_agg('### ' || path || ' (score: ' || printf('%.2f', combined_score) || ')' || chr(10) || snippet, chr(10) || chr(10) order by path_rank), '{hybrid.EMPTY_CONTEXT}') as context,
  count(*) as sources_in_context, coalesce(sum(length(snippet) + length(path) + 20), 0)::bigint as context_chars from k""")
def rag_context(spark, d):
    return hybrid.context(hybrid.budgeted(hybrid.best_per_path(_merged(spark, d)))).withColumn("context_chars", F.col("context_chars").cast("long"))


@query(f"with {_USED} select path_rank, path, source_id, round_even(combined_score, 3) as score, length(snippet) as chars from k")
def rag_sources(spark, d):
    out = hybrid.sources(hybrid.budgeted(hybrid.best_per_path(_merged(spark, d))))
    return out.withColumns({"path_rank": F.col("path_rank").cast("long"), "chars": F.col("chars").cast("long")})


@query(f"with {_LEGS} select count(*) filter (leg = 0) as semantic_hits, count(*) filter (lexical_score > 0) as lexical_hits, count(*) as merged_candidates from c")
def rag_stats(spark, d):
    m = hybrid.merge(*_legs(spark, d))
    return m.agg(F.count_if(F.col("leg") == 0).alias("semantic_hits"), F.count_if(F.col("lexical_score") > 0).alias("lexical_hits"), F.count(F.lit(1)).alias("merged_candidates"))


@query(f"with {_LEGS} select doc_id, path from c where contains(path, 'en/') or contains(split_part(path, '/', 1), 'src3') or contains(source_id, 'src3')")
def rag_repos(spark, d):
    m = hybrid.merge(*_legs(spark, d)).withColumn("repo", F.get(F.split("path", "/"), F.lit(0)))
    return hybrid.in_repos(m, ["en/", "src3"]).select("doc_id", "path")


# ---- identity and chunking


@query(f"""with {DOCS} select doc_id, sha256(source_id || ':' || path || ':' || sha256(text) || ':' || modality) as idempotency_key, sha256(text) as content_hash, source_id || ':' || path || ':0' as chunk_id,
  md5(source_id || ':' || path || ':0') as lexical_id, left(sha256('plain:0.1.0:' || sha256(text)), 32) as cache_key from d""")
def identity_keys(spark, d):
    b = docs(spark, d).withColumn("content_hash", identity.content_hash(F.col("text").cast("binary"))).withColumn("chunk_id", identity.chunk_id(F.col("source_id"), F.col("path"), F.lit(0)))
    return b.select(
        "doc_id", identity.idempotency_key(F.col("source_id"), F.col("path"), F.col("content_hash"), F.col("modality")).alias("idempotency_key"), "content_hash", "chunk_id",
        identity.lexical_id(F.col("chunk_id")).alias("lexical_id"), identity.cache_key(F.lit("plain"), F.lit("0.1.0"), F.col("content_hash")).alias("cache_key"),
    )


@query(f"with {DOCS} select doc_id, ('0x' || left(md5(source_id || ':' || path || ':0'), 16))::ubigint::varchar as point_id from d")
def point_ids(spark, d):
    b = docs(spark, d)
    return b.select("doc_id", identity.point_id(identity.chunk_id(F.col("source_id"), F.col("path"), F.lit(0))).cast("string").alias("point_id"))


@query(f"with {DOCS} select doc_id, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end as tokens from d")
def token_count(spark, d):
    return docs(spark, d).select("doc_id", text.count_tokens(F.col("text")).cast("long").alias("tokens"))


def _chunks(df):
    return df.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "content")


@query(S.chunked(f"with {DOCS}, src as (select source_id, path, text as body from d)", S.recursive("body", 128), 20))
def chunk_recursive(spark, d):
    return _chunks(chunking.chunk(docs(spark, d).select("source_id", "path", "text"), most=128, overlap=20))


@query(S.chunked(f"with {DOCS}, src as (select source_id, path, text as body from d)", S.recursive("body", 512), 0))
def chunk_default_size(spark, d):
    return _chunks(chunking.chunk(docs(spark, d).select("source_id", "path", "text"), overlap=0))


def _talks(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("text"))
    return c.select(F.lit("talks").alias("source_id"), F.col("conv_id").cast("string").alias("path"), "text")


@query(S.chunked("with src as (select 'talks' as source_id, conv_id::varchar as path, string_agg(text, chr(10) || chr(10) order by turn) as body from conversations group by conv_id)", S.paragraphs("body", 32), 5))
def chunk_paragraph(spark, d):
    return _chunks(chunking.chunk(_talks(spark, d), most=32, overlap=5, strategy="paragraph"))


@query(f"with {DOCS} select doc_id, list_transform({S.hard('text', 100)}, lambda s: md5(s)) as slices from d")
def chunk_hard_slice(spark, d):
    return docs(spark, d).select("doc_id", F.transform(text.hard_slices(F.col("text"), 100), lambda s: F.md5(s.cast("binary"))).alias("slices"))


@query(S.chunked("with src as (select 'talks' as source_id, conv_id || '#page=' || turn as path, text as body from conversations)", S.recursive("body", 64), 10))
def chunk_paged(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("index"), "text", F.col("role").alias("title")))).alias("pages"))
    rows = c.select(F.lit("talks").alias("source_id"), F.col("conv_id").cast("string").alias("path"), F.lit("unused").alias("text"), "pages")
    return _chunks(chunking.chunk_extracted(rows, most=64, overlap=10))


# ---- change detection and routing


@query(f"""with {DOCS}, cur as (select path, content_modified_ts as modified, length(text) as size from d where doc_id % 11 <> 3),
prev as (select path, content_modified_ts as modified, case when doc_id % 5 = 0 then 1 else length(text) end as size from d where doc_id % 13 <> 4)
select coalesce(cur.path, prev.path) as path, case when prev.path is null then 'add' when cur.path is null then 'delete' else 'modify' end as operation from cur full join prev on cur.path = prev.path
where prev.path is null or cur.path is null or cur.modified is distinct from prev.modified or cur.size is distinct from prev.size""")
def snapshot_diff(spark, d):
    b = docs(spark, d).select("doc_id", "path", F.col("content_modified_ts").alias("modified"), F.length("text").alias("size"))
    cur = b.where("doc_id % 11 <> 3").drop("doc_id")
    prev = b.where("doc_id % 13 <> 4").withColumn("size", F.when(F.col("doc_id") % 5 == 0, 1).otherwise(F.col("size"))).drop("doc_id")
    return cdc.snapshot_diff(cur, prev).select("path", "operation")


@query(f"""with {DOCS}, cur as (select path, case when doc_id % 4 <> 0 then md5(text) end as etag, 1 as size from d), prev as (select path, case when doc_id % 3 <> 0 then md5(text) else 'old' end as etag, 1 as size from d)
select cur.path, 'modify' as operation from cur join prev using (path) where cur.etag is not null and cur.etag is distinct from prev.etag""")
def object_diff(spark, d):
    b = docs(spark, d).select("doc_id", "path", F.md5("text").alias("m"))
    cur = b.select("path", F.when(F.col("doc_id") % 4 != 0, F.col("m")).alias("etag"), F.lit(1).alias("size"))
    prev = b.select("path", F.when(F.col("doc_id") % 3 != 0, F.col("m")).otherwise("old").alias("etag"), F.lit(1).alias("size"))
    return cdc.snapshot_diff(cur, prev, compare=("size",), etag="etag").select("path", "operation")


@query(f"""with {DOCS}, x as (select doc_id, path, case doc_id % 6 when 0 then 'A' when 1 then 'M' when 2 then 'D' when 3 then 'R' when 4 then 'C' else 'T' end as mark from d)
select doc_id, case mark when 'A' then 'add' when 'M' then 'modify' when 'D' then 'delete' else 'add' end as operation, case mark when 'R' then path || '.new' else path end as path from x where mark in ('A', 'M', 'D', 'R')
union all select doc_id, 'delete', path from x where mark = 'R'""")
def git_status_parse(spark, d):
    marks = F.element_at(F.lit(["A", "M", "D", "R", "C", "T"]), (F.col("doc_id") % 6 + 1).cast("int"))
    line = F.when(marks == "R", F.concat(F.lit("R087\t"), F.col("path"), F.lit("\t"), F.col("path"), F.lit(".new"))).otherwise(F.concat(marks, F.lit("\t"), F.col("path")))
    return cdc.split_renames(cdc.git_status(docs(spark, d).select("doc_id", line.alias("line")))).select("doc_id", "operation", "path")


@query(f"with {DOCS} select path from d where (path like 'en/1%.txt' or regexp_matches(path, '^(fr|de)/.*[02468]\\.txt$')) and not regexp_matches(path, '/[^/]*7[^/]*$')")
def glob_filter(spark, d):
    return docs(spark, d).where(text.selected(F.col("path"), ["en/1*.txt", "fr/*[02468].txt", "de/*[02468].txt"], ["*7*"])).select("path")


@query(f"with {DOCS} select path, length(text) as size from d where length(text) <= 2000")
def size_cap(spark, d):
    listing = docs(spark, d).select(F.col("path").alias("key"), F.lit(0).alias("modified"), F.length("text").cast("long").alias("size"), F.lit("").alias("etag"))
    return folder.objects(listing, max_bytes=2000).select("path", "size")


_EXT = "case doc_id % 8 when 0 then 'PNG' when 1 then 'txt' when 2 then 'jpeg' when 3 then 'bmp' when 4 then 'md' when 5 then 'pdf' when 6 then 'webp' else 'html' end"


def _named(spark, d):
    ext = F.element_at(F.lit(["PNG", "txt", "jpeg", "bmp", "md", "pdf", "webp", "html"]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))


@query(f"""with x as (select doc_id, {_EXT} as e from documents) select doc_id, case when lower(e) in ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'tiff', 'tif', 'webp', 'ico') then 'image' else 'text' end as detected,
  case when lower(e) in ('png', 'jpg', 'jpeg', 'gif', 'webp') then 'image' else 'text' end as adapter from x""")
def modality_detect(spark, d):
    return _named(spark, d).select("doc_id", text.detect_modality(F.col("path")).alias("detected"), text.adapter_modality(F.col("path")).alias("adapter"))


_MIME = "case when doc_id % 3 = 0 then 'text/html; charset=utf-8' when doc_id % 5 = 0 then 'Text/Markdown' end"


def _events(spark, d):
    n = F.col("doc_id")
    mime = F.when(n % 3 == 0, "text/html; charset=utf-8").when(n % 5 == 0, "Text/Markdown")
    ref = F.when(n % 9 != 5, F.struct(F.lit("path").alias("kind"), F.col("path").alias("path")))
    return _named(spark, d).select(n.cast("string").alias("event_id"), "doc_id", "path", mime.alias("content_mime"), F.when(n % 7 == 0, "delete").otherwise("add").alias("operation"), (n % 5).cast("int").alias("depth"), text.adapter_modality(F.col("path")).alias("modality"), ref.alias("content_ref"))


_PICK = f"""x as (select doc_id, lower({_EXT}) as e, {_MIME} as mime from documents),
k as (select *, case when mime like 'text/html%' or e = 'html' then 'html' when e = 'pdf' then 'pdf-text' when mime = 'Text/Markdown' or e in ('txt', 'md') then 'plain' end as extractor,
  case when e in ('png', 'jpeg', 'webp') then 'image' else 'text' end as modality from x)"""


@query(f"with {_PICK} select doc_id, extractor from k")
def route_extractor(spark, d):
    return routing.pick_extractor(_events(spark, d), routing.capabilities(spark)).select("doc_id", "extractor")


@query(f"""with {_PICK} select doc_id, case when doc_id % 7 = 0 then 'delete' when doc_id % 5 >= 3 then 'too_deep' when modality = 'image' then 'image' when doc_id % 9 = 5 then 'no_content'
  when extractor is null then 'skip' else 'extract' end as route from k""")
def route_decision(spark, d):
    return routing.route(_events(spark, d), routing.capabilities(spark), text_fallback=False).select("doc_id", "route")


@query("""with k as (select doc_id, case when doc_id % 2 = 0 then source else 'own' end as source_id, doc_id % 4 + 1 as depth, source, lang from documents)
select doc_id, source_id, depth, sha256(source_id || ':' || doc_id || '#img-0::image') as idempotency_key from k where depth < 3""")
def attached_depth(spark, d):
    b = table(spark, d, "documents")
    parents = b.select(F.col("doc_id").alias("event_id"), F.col("source").alias("source_id"), F.lit("folder").alias("source_type"), (F.col("doc_id") % 4).alias("depth"))
    kids = b.select("doc_id", F.col("doc_id").alias("parent_event_id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("own").alias("source_id"), F.lit("").alias("source_type"), F.concat(F.col("doc_id").cast("string"), F.lit("#img-0")).alias("path"), F.lit(None).cast("string").alias("content_hash"), F.lit("image").alias("modality"))
    return routing.attach(kids, parents).select("doc_id", "source_id", "depth", "idempotency_key")


# ---- pages

_HEAD = "regexp_extract(regexp_replace({u}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
_CANON = f"(lower({_HEAD}) || substr(regexp_replace({{u}}, '#.*$', ''), length({_HEAD}) + 1))"


@query(f"select page_id, {_CANON.format(u='url')} as canonical, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as origin from pages")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.origin(F.col("url")).alias("origin"))


@query(r"""with h as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''>]*)["'']', 1)) as href from pages), t as (select page_id, url, trim(href) as href from h)
select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || href as link, count(*) as n from t where href like '/%' and href not like '//%' group by 1, 2""")
def link_extract(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(urls.links(F.col("html"), F.col("url"))).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


_HTML_SQL = S.html("html")


@query(f"select page_id, {_HTML_SQL} as text from pages")
def html_text(spark, d):
    return extract.html(table(spark, d, "pages")).select("page_id", "text")


@query(f"select page_id, {S.main_text('html')} as text from pages")
def html_main_text(spark, d):
    """The main text of every page: long blocks of few links."""
    return extract.html(table(spark, d, "pages"), main=True).select("page_id", "text")


def _site(spark, d):
    """Pages have no links among themselves, so each links to the next two of a derived order."""
    p = table(spark, d, "pages").select("page_id")
    hop = F.explode(F.lit([2, 3]))
    links = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.col("page_id").alias("n"), hop.alias("k"))
    return links.select("src", F.concat(F.lit("p"), ((F.col("n") * F.col("k") + 1) % 97).cast("string")).alias("dst"), (F.col("k") - 2).alias("link_pos"))


@query("""with recursive l as (select 'p' || page_id as src, 'p' || ((page_id * k + 1) % 97) as dst from pages, (select unnest([2, 3]) as k)),
r(url, depth) as (select 'p1', 0 union select l.dst, r.depth + 1 from r join l on l.src = r.url where r.depth < 5)
select url, min(depth) as depth from r group by 1""")
def crawl_bfs(spark, d):
    root = spark.range(1).select(F.lit("p1").alias("url"))
    return crawl.crawl(root, _site(spark, d), 5).select("url", F.col("depth").cast("int").alias("depth"))


@query(r"""with r as (select url, row_number() over (order by url) as rank from (select distinct url from pages)),
h as (select url, list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''>]*)["'']', 1), lambda x: trim(x)), lambda x: x like '/%' and x not like '//%') as hrefs from pages),
l as (select url as src, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || unnest(hrefs) as dst, generate_subscripts(hrefs, 1) as pos from h),
f as (select dst, min(rank * 1000000 + pos) as via from l join r on src = r.url where dst not in (select url from r) group by 1)
select url, 0 as depth, rank from r union all select dst, 1, row_number() over (order by via, dst) + (select count(*) from r) from f""")
def crawl_pages(spark, d):
    """From every page over the links in its text, level by level; what the table has no page for is where the walk ends."""
    p = table(spark, d, "pages")
    links = p.select(F.col("url").alias("src"), F.posexplode(urls.links(F.col("html"), F.col("url"))).alias("link_pos", "dst"))
    return crawl.crawl(p.select("url"), links, max_depth=2).select("url", "depth", "rank")



@query("""with h as (select page_id, url, md5(html) as h, page_id % 17 as site from pages), g as (select *, lag(h) over (partition by site order by page_id) as before, row_number() over (partition by site order by page_id) as n from h where page_id % 19 <> 1)
select page_id, case when n = 1 then 'add' else 'modify' end as operation from g where n = 1 or h is distinct from before""")
def fetch_changes(spark, d):
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 17).alias("url"), F.md5("html").alias("content_hash"))
    return cdc.fetch_changes(p, "url", "page_id", failed=F.col("page_id") % 19 == 1).select("page_id", "operation")


# ---- indexes

_UPSERT = f"""{DOCS}, old as (select doc_id, source_id, path, md5(text) as snippet, 0 as seq from d where doc_id % 3 <> 0),
new as (select doc_id, source_id, path, md5(text || '!') as snippet, doc_id % 100 + 1 as seq from d where doc_id % 2 = 0)"""


def _old_new(spark, d):
    b = docs(spark, d)
    old = b.where("doc_id % 3 <> 0").select("doc_id", "source_id", "path", F.md5("text").alias("snippet"), F.lit(0).cast("long").alias("seq"))
    new = b.where("doc_id % 2 = 0").select("doc_id", "source_id", "path", F.md5(F.concat("text", F.lit("!"))).alias("snippet"), (F.col("doc_id") % 100 + 1).alias("seq"))
    return old, new.unionByName(new.withColumns({"seq": F.lit(0).cast("long"), "snippet": F.lit("stale")}))


@query(f"with {_UPSERT} select doc_id, snippet, seq from new union all select doc_id, snippet, seq from old where doc_id not in (select doc_id from new)")
def upsert_latest(spark, d):
    old, new = _old_new(spark, d)
    return index.upsert(old, new, "doc_id", "seq").select("doc_id", "snippet", "seq")


def _chunk_rows(spark, d):
    b = docs(spark, d).select("source_id", F.concat("path", F.lit("#page="), (F.col("doc_id") % 3).cast("string")).alias("path"), F.when(F.col("doc_id") % 10 == 1, F.lit("en/2.txt")).otherwise("").alias("derived_from"), "doc_id")
    return b


_GONE = f"{DOCS}, gone as (select source_id, path from d where doc_id % 6 = 2)"


@query(f"""with {_GONE} select doc_id from d where (source_id, path) not in (select (source_id, path) from gone)
  and not (doc_id % 10 = 1 and source_id in (select source_id from gone where path = 'en/2.txt'))""")
def delete_by_path(spark, d):
    gone = docs(spark, d).where("doc_id % 6 = 2").select("source_id", "path")
    return index.delete_paths(_chunk_rows(spark, d), gone).select("doc_id")


@query(f"with {DOCS} select (select count(*) from d where source_id = 'src3') as deleted, (select count(*) from d where source_id <> 'src3') as kept")
def purge_source(spark, d):
    kept, deleted = index.purge_source(docs(spark, d), "src3")
    return deleted.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # one row each


@query(f"""with {VECTORS}, {DOCS} select (select count(*) from v where modality = 'text') as text_points, (select count(*) from v where modality = 'image') as image_points, (select max(content_modified_ts) from v) as last_index_ts,
  (select count(*) from d) as lexical_docs, (select count(*) from v) + (select count(*) from d) as total""")
def index_stats(spark, d):
    v = vectors(spark, d).withColumn("collection", index.collection(F.col("modality")))
    return index.stats(v, docs(spark, d))


@query(f"with {DOCS} select source_id, path, modality, count(*) as chunks, max(content_modified_ts) as content_modified_ts from d where source_id = 'src2' and path like 'en/%' group by all order by 1, 2 limit 20 offset 5")
def list_files(spark, d):
    return index.list_files(docs(spark, d), "src2", "en/", "text", 20, 5)


@query("""select case when vec_id % 5 in (0, 1) then 'text' when vec_id % 5 = 2 then 'image' else null end as collection, count(*) as n from embeddings group by 1""")
def collection_routing(spark, d):
    m = F.element_at(F.lit(["text", "audio_transcript", "image", "hologram", ""]), (F.col("vec_id") % 5 + 1).cast("int"))
    return table(spark, d, "embeddings").select(index.collection(m).alias("collection")).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


# ---- sources, queues, schedules


@query("select source, min(doc_id) as doc_id from documents group by 1")
def sources_dedup(spark, d):
    return cdc.distinct_in_order(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("select event_type, case when bool_and(value > 90) then 'all' when bool_or(value > 90) then 'some' else 'none' end as status from events group by 1")
def status_rollup(spark, d):
    return jobs.rollup(table(spark, d, "events"), "event_type", F.col("value") > 90)


_LATE = "case retry_count when 0 then 60 when 1 then 300 when 2 then 900 end"
_DEAD = f"q as (select event_id, event_id % 5 as retry_count, ts from events), a as (select timestamp '2024-01-15 00:00:00' as now), k as (select *, epoch(ts)::bigint + {_LATE} as due from q), n as (select epoch(now)::bigint as now from a)"


@query(f"with {_DEAD} select case when retry_count >= 3 then 'final' when due <= now then 'again' else 'waiting' end as state, retry_count + case when retry_count < 3 and due <= now then 1 else 0 end as retry_count, count(*) as n from k, n group by 1, 2")
def dlq_retry(spark, d):
    dead = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).alias("retry_count"), F.col("ts").cast("timestamp").alias("failed_at"))
    parts = zip(("again", "waiting", "final"), jobs.drain(dead, F.lit("2024-01-15 00:00:00").cast("timestamp")), strict=True)
    again, waiting, final = (p.select(F.lit(n).alias("state"), "retry_count") for n, p in parts)
    return again.unionByName(waiting).unionByName(final).groupBy("state", "retry_count").agg(F.count(F.lit(1)).alias("n"))


@query("select sha256(user_id || ':' || event_type || '::text') as idempotency_key from events where user_id % 7 <> 0 group by 1")
def idempotent_dedup(spark, d):
    e = table(spark, d, "events").select("user_id", identity.idempotency_key(F.col("user_id").cast("string"), F.col("event_type"), F.lit(None), F.lit("text")).alias("idempotency_key"))
    return routing.unprocessed(e, e.where("user_id % 7 = 0")).select("idempotency_key")


@query("""with c as (select doc_id, case doc_id % 6 when 0 then '*/5 * * * *' when 1 then '0 */2 * * *' when 2 then '15 * * * *' when 3 then '0 6 * * *' when 4 then '*/x * * * *' else 'daily' end as cron from documents)
select doc_id, case doc_id % 6 when 0 then 300.0 when 1 then 7200.0 when 2 then 3600.0 when 4 then 300.0 else 86400.0 end::double as seconds from c""")
def cron_interval(spark, d):
    cron = F.element_at(F.lit(["*/5 * * * *", "0 */2 * * *", "15 * * * *", "0 6 * * *", "*/x * * * *", "daily"]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", urls.poll_seconds(cron).alias("seconds"))


@query("select event_type, (props->>'k')::bigint % 10 as k, count(*) as n from events group by 1, 2")
def json_props(spark, d):
    parsed = jobs.parse_json(table(spark, d, "events").select("event_type", "props"), StructType([StructField("k", LongType())]), "props")
    return parsed.where("not _bad").groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as value from events""")
def publish_json(spark, d):
    return jobs.to_messages(table(spark, d, "events").select("event_id", "event_type"), keep=["event_id"])


@query(f"with {DOCS} select doc_id, case when doc_id % 4 = 0 then 'log' when doc_id % 4 = 1 then 'csv' else 'md' end as format, case when doc_id % 4 = 1 then ',' end as delimiter, md5(text) as digest from d")
def plain_extract(spark, d):
    ext = F.element_at(F.lit(["log", "csv", "md", "md"]), (F.col("doc_id") % 4 + 1).cast("int"))
    b = docs(spark, d).withColumn("path", F.concat(F.lit("x."), ext))
    return extract.plain(b).select("doc_id", F.col("metadata.format").alias("format"), F.col("structure.delimiter").alias("delimiter"), F.md5("text").alias("digest"))


@query("""with e as (select user_id, ts, event_type from events), s as (select *, row_number() over (partition by user_id order by ts desc, event_type desc) as n from e) select user_id, event_type from s where n = 1""")
def latest_state(spark, d):
    """A streaming upsert, run to its end: the last event of each user."""
    from millrace.plans.session import run_stream

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file
    key = stream.withColumn("at", F.struct("ts", "event_type"))
    return run_stream(jobs.latest_state(key, "user_id", "at", ["event_type"])).select("user_id", "event_type")


# ---- references, listings, snapshots


@query("""with k as (select doc_id, 'pre/' || case when doc_id % 5 = 0 then source || '/' else source || '/' || doc_id || '.md' end as key, length(text) as size, '"' || md5(text) || '"' as etag from documents)
select substr(key, 5) as path, size, trim(etag, '"') as etag from k where not ends_with(key, '/') and size <= 5000 and not regexp_matches(key, '^pre/src1/')""")
def object_listing(spark, d):
    b = table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("/"))).otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    listing = b.select(F.concat(F.lit("pre/"), name).alias("key"), F.lit(0).alias("modified"), F.length("text").cast("long").alias("size"), F.concat(F.lit('"'), F.md5("text"), F.lit('"')).alias("etag"))
    return folder.objects(listing, "pre", ["*.md"], ["src1/*"], 5000).select("path", "size", "etag")


@query("select doc_id, case when strlen(text) < 2000 then 'inline_bytes' else 'url' end as kind, case when strlen(text) < 2000 then base64(encode(text)) end as bytes_b64 from documents")
def inline_reference(spark, d):
    ref = cdc.inline_reference(F.col("text").cast("binary"), F.lit("u"), 2000)
    b = table(spark, d, "documents").select("doc_id", ref.alias("r"))
    return b.select("doc_id", "r.kind", F.regexp_replace("r.bytes_b64", "[\\r\\n]", "").alias("bytes_b64"))


@query("""select doc_id, case doc_id % 6 when 0 then true when 1 then doc_id % 4 = 1 when 2 then doc_id % 4 = 2 when 3 then true when 4 then doc_id % 8 = 4 else false end as valid from documents""")
def reference_validation(spark, d):
    n = F.col("doc_id")
    kind = F.element_at(F.lit(["path", "inline_bytes", "inline_text", "url", "object_storage", "odd"]), (n % 6 + 1).cast("int"))
    some = lambda c: F.when(c, F.lit("x"))
    ref = F.struct(kind.alias("kind"), F.lit("p").alias("path"), some(n % 4 == 1).alias("bytes_b64"), some(n % 4 == 2).alias("text"), F.lit("u").alias("url"), some(n % 2 == 0).alias("bucket"), some(n % 8 == 4).alias("key"))
    return table(spark, d, "documents").select("doc_id", routing.valid_reference(ref).alias("valid"))


@query("select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then left(text, 20) else '[file: ' || doc_id || '.xyz]' end as text from documents")
def legacy_text(spark, d):
    n = F.col("doc_id")
    modality, ocr = F.when(n % 3 == 0, "image").otherwise("text"), F.when(n % 3 == 1, F.left("text", F.lit(20))).otherwise("")
    return table(spark, d, "documents").select("doc_id", routing.legacy_text(modality, ocr, F.concat(n.cast("string"), F.lit(".xyz"))).alias("text"))


@query("select event_type as path, max(ts) as content_modified_at from events group by 1")
def last_commit(spark, d):
    return cdc.last_commit(table(spark, d, "events").select(F.col("event_type").alias("path"), F.col("ts").alias("committed_at")))


@query("""with c as (select doc_id, 2 as seen from documents where doc_id % 3 <> 0), p as (select doc_id, 1 as seen from documents where doc_id % 5 <> 0), f as (select doc_id from documents where doc_id % 7 = 0)
select doc_id, seen from c where doc_id not in (select doc_id from f) union all select doc_id, seen from p where doc_id in (select doc_id from f)""")
def next_snapshot(spark, d):
    b = table(spark, d, "documents").select("doc_id")
    return cdc.next_snapshot(b.where("doc_id % 3 <> 0").withColumn("seen", F.lit(2)), b.where("doc_id % 5 <> 0").withColumn("seen", F.lit(1)), b.where("doc_id % 7 = 0"), "doc_id")


@query("""select page_id, regexp_replace(regexp_extract(regexp_replace(split_part(split_part(url, '?', 1), '#', 1) || '.git', '/+$', ''), '([^/]*)$', 1), '\\.git$', '') as repo from pages""")
def repository_names(spark, d):
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", urls.repository(F.concat(bare, F.lit(".git"))).alias("repo"))


@query(f"with x as (select doc_id, lower({_EXT}) as e from documents) select doc_id, case e when 'png' then 'image/png' when 'txt' then 'text/plain' when 'jpeg' then 'image/jpeg' when 'md' then 'text/markdown' when 'pdf' then 'application/pdf' when 'webp' then 'image/webp' when 'html' then 'text/html' end as mime from x")
def mime_inference(spark, d):
    return _named(spark, d).select("doc_id", text.mime(F.col("path")).alias("mime"))


@query("select event_id, strptime(strftime(ts, '%d %b %Y %H:%M:%S'), '%d %b %Y %H:%M:%S') as modified from events where event_id % 2 = 0 union all select event_id, null from events where event_id % 2 = 1")
def http_dates(spark, d):
    header = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Wed, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    return table(spark, d, "events").select("event_id", urls.http_time(header).cast("timestamp_ntz").alias("modified"))


@query("select doc_id from documents where source not in (select distinct source from documents where doc_id % 50 = 0)")
def unknown_sources(spark, d):
    b = table(spark, d, "documents").select("doc_id", "source")
    return cdc.of_unknown_sources(b, b.where("doc_id % 50 = 0"), "source").select("doc_id")


@query("select doc_id, md5(left(text, 4000)) as vector_snippet, md5(left(text, 10000)) as lexical_snippet, md5('s:' || doc_id || ':0') as lexical_id from documents where doc_id % 4 <> 0 or doc_id % 8 = 0")
def lexical_upsert_rows(spark, d):
    n = F.col("doc_id")
    modality = F.when(n % 8 == 4, "image").otherwise("text")
    entries = table(spark, d, "documents").select(n, F.concat(F.lit("s:"), n.cast("string"), F.lit(":0")).alias("chunk_id"), modality.alias("modality"), F.col("text").alias("snippet"), F.lit("").alias("repo"), F.lit("").alias("derived_from"), F.lit(None).cast("timestamp").alias("content_modified_at"), F.array(F.lit(1.0)).alias("vector"), F.lit("m").alias("model"))
    points, _ = index.points(entries.withColumnRenamed("doc_id", "number"))
    found = index.lexical_docs(points).select(F.col("number").alias("doc_id"), F.col("doc_id").alias("lexical_id"), F.md5("snippet").alias("lexical_snippet"))
    return found.join(points.select(F.col("number").alias("doc_id"), F.md5("snippet").alias("vector_snippet")), "doc_id")


@query(f"with {_BM25} select doc_id, path, bm25 from b join d using (doc_id) where path like 'de/1%' order by bm25 desc, doc_id limit 10")
def lexical_prefix(spark, d):
    return search.lexical(docs(spark, d), query_text(spark, d), 10, path_prefix="de/1", index=lexical_index(spark, d)).select("doc_id", "path", "bm25")


@query(f"with {_PICK} select doc_id, case when doc_id % 4 = 1 then 'control' when doc_id % 7 = 0 then 'delete' when doc_id % 5 >= 3 then 'too_deep' when modality = 'image' then 'image' when doc_id % 9 = 5 then 'no_content' else 'extract' end as route from k")
def route_control_rows(spark, d):
    """Control rows go first, and texts that no extractor names fall back."""
    typed = _events(spark, d).withColumns({"type": F.when(F.col("doc_id") % 4 == 1, "trigger_sync"), "modality": F.coalesce("modality", F.lit("text"))})
    return routing.route(typed, routing.capabilities(spark)).select("doc_id", "route")


@query(f"with {DOCS} select source_id, repo, path, modality, md5(snippet) as snippet, case when doc_id % 3 = 0 then 'p' end as derived_from, content_modified_ts, doc_id from d")
def payload_projection(spark, d):
    hits = docs(spark, d).withColumn("derived_from", F.when(F.col("doc_id") % 3 == 0, "p").otherwise("")).withColumn("snippet", F.md5("snippet"))
    return search.projected(hits, ["doc_id"])


@query("""with e as (select doc_id, case when doc_id % 3 = 0 then 'delete' else 'modify' end as operation, doc_id || '.txt' as path, case when doc_id % 3 <> 0 then sha256(text) end as content_hash from documents)
select doc_id, operation, content_hash, sha256('s' || ':' || path || ':' || coalesce(content_hash, '') || ':text') as idempotency_key, 0 as retry_count, 0 as depth, 'cron' as priority from e""")
def change_events(spark, d):
    b = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "delete").otherwise("modify").alias("operation"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), identity.content_hash(F.col("text").cast("binary")).alias("content_hash"))
    return cdc.events(b, "s", "folder", F.lit(AS_OF).cast("timestamp")).select("doc_id", "operation", "content_hash", "idempotency_key", "retry_count", "depth", "priority")


@query("""select doc_id, sha256(source || ':' || case when doc_id % 2 = 0 then 'add' else 'delete' end || ':' || case when doc_id % 5 = 0 then '' else lang end) as version_key, 'pre/' || doc_id as object_key from documents""")
def version_keys(spark, d):
    n = F.col("doc_id")
    key = identity.version_key(F.col("source"), F.when(n % 2 == 0, "add").otherwise("delete"), F.when(n % 5 != 0, F.col("lang")))
    return table(spark, d, "documents").select("doc_id", key.alias("version_key"), urls.object_key("pre", n.cast("string")).alias("object_key"))


@query("""select doc_id, case when doc_id % 3 = 0 then md5(text) when doc_id % 3 = 1 then md5('inline') when strlen(text) > 3000 then md5('') when doc_id % 2 = 0 then md5(text) end as digest from documents""")
def fetch_by_reference(spark, d):
    """Content of events by the kind of their reference: inline, or a file, which is empty if too large and null if there is none."""
    n = F.col("doc_id")
    kind = F.when(n % 3 == 0, "inline_bytes").when(n % 3 == 1, "inline_text").otherwise("path")
    ref = F.struct(kind.alias("kind"), n.cast("string").alias("path"), F.base64(F.col("text").cast("binary")).alias("bytes_b64"), F.lit("inline").alias("text"))
    b = table(spark, d, "documents")
    files = b.where("doc_id % 2 = 0 or octet_length(text) > 3000").select(n.cast("string").alias("path"), F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    return routing.fetch_paths(b.select(n, ref.alias("content_ref")), files, 3000).select("doc_id", F.md5("content").alias("digest"))


@query("""with c as (select doc_id, unnest([{'e': 'plain', 'p': 0}, {'e': 'office', 'p': 10}, {'e': 'html', 'p': (doc_id % 3) * 10}]) as c from documents)
select doc_id, c.e as extractor, row_number() over (partition by doc_id order by c.p desc, c.e) as rank from c""")
def extractor_candidates(spark, d):
    pair = lambda e, p: F.struct(F.lit(e).alias("extractor"), p.cast("int").alias("priority"))
    rows = table(spark, d, "documents").select("doc_id", F.inline(F.array(pair("plain", F.lit(0)), pair("office", F.lit(10)), pair("html", F.col("doc_id") % 3 * 10))))
    return routing.rank_candidates(rows, "doc_id").select("doc_id", "extractor", F.col("rank").cast("long").alias("rank"))


@query(None)
def hashing_embeddings(spark, d):
    from millrace.operators import embed

    return embed.embed(docs(spark, d).select("doc_id", F.col("text").alias("content")), dimensions=32).select("doc_id", "vector")


@query("select doc_id, length(regexp_replace(case when doc_id % 4 = 0 then '  ' || left(text, 20) || '  ' else text end, '^\\s+|\\s+$', '', 'g')) < 50 as scanned from documents")
def scanned_pages(spark, d):
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), F.left("text", F.lit(20)), F.lit("  "))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", extract.likely_scanned(body).alias("scanned"))
