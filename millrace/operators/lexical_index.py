"""An inverted index as tables: postings by document and term, the vocabulary, and the totals that BM25 needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ranking
from millrace.operators import index

#: Bytes of text whose postings go to one file, about: the number of files grows with the corpus.
FILE_BYTES = 24_000_000
#: Words near a query that are listed in a filter, or broadcast.
LISTED, BROADCAST_ROWS = 1000, 200_000


class LexicalIndex:
    """A file holds all postings of its documents, sorted by term, so that a query reads the pages of its terms in each; a posting is never shuffled."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._postings, self._words = (spark.read.parquet(f"{self.path}/{t}") for t in ("postings", "words"))
        row = spark.read.parquet(f"{self.path}/totals").first()
        self.n_docs, self.mean_len = row["n_docs"], row["mean_len"]

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> LexicalIndex:
        """Every document and its whole text. Texts are dealt out by key and split into words once; the rest is counted from the postings."""
        spark = docs.sparkSession
        n = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count(text).alias("texts"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
        rows = index.postings(docs.select(key, text).repartition(max(1, -(-n["bytes"] // FILE_BYTES)), key), key, text)
        rows.sortWithinPartitions("term", key).write.parquet(f"{path}/postings")
        words = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
        words.write.parquet(f"{path}/words")
        total = spark.read.parquet(f"{path}/words").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).first()["words"]
        mean = total / n["texts"] if n["texts"] else None
        spark.createDataFrame([(n["n_docs"], mean)], "n_docs long, mean_len double").write.parquet(f"{path}/totals")
        return cls(spark, path, key)

    def near(self, terms: Sequence[str]) -> DataFrame:
        """term, meant: the words of the vocabulary near a query's terms."""
        query = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
        close = F.filter(query, lambda t: (F.abs(F.length("term") - F.length(t)) <= 2) & (F.levenshtein(F.col("term"), t) <= F.when(F.length(t) < 4, 0).when(F.length(t) < 8, 1).otherwise(2)))
        return self._words.select("term", F.explode(close).alias("meant"))

    def matches(self, terms: Sequence[str], typos: bool = False) -> DataFrame:
        """key, doc_len, term, tf: the postings of the query's terms; with typos, words near a term count as that term. Only the vocabulary is compared, and only the near words move."""
        if not typos:
            return self._postings.where(F.col("term").isin(list(terms))).select(self.key, "doc_len", "term", "tf")
        words, held = self.near(terms), self._postings
        few = words.limit(LISTED + 1).collect()
        if len(few) <= LISTED:
            words = F.broadcast(self.spark.createDataFrame(few, words.schema))
            held = held.where(F.col("term").isin(sorted({r.term for r in few})))
        elif words.count() <= BROADCAST_ROWS:
            words = F.broadcast(words)
        return held.join(words, "term").groupBy(self.key, "doc_len", F.col("meant").alias("term")).agg(F.sum("tf").alias("tf"))

    def scores(self, terms: Sequence[str], typos: bool = False) -> DataFrame:
        """key, bm25."""
        tf = self.matches(terms, typos)
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per query term
        one = ranking.bm25(F.col("tf"), F.col("df"), F.col("doc_len"), F.lit(self.n_docs), F.lit(self.mean_len))
        return tf.join(F.broadcast(df), "term").select(self.key, one.alias("part")).groupBy(self.key).agg(F.sum("part").alias("bm25"))
