"""A vector index: unit vectors in cells around centroids, with codes of a few bytes for what is left of each.

The residual of a vector to its centroid is cut into parts, and each part is the number of the nearest entry of its
book (product quantisation). A query reads the cells nearest to it: of their rows only the codes, whose scores are sums
of a table's entries (the query is not quantised); the best of these are then scored by their whole vectors. Without a
number of cells all rows are scored by their vectors, exactly.

Centroids and books are fitted to a bounded sample; every row is put into a cell. Cells that hold more than `most` rows
are split, again and again, by centroids that are fitted to a bounded sample of their own rows in the executors, so
cells grow in number with the rows. A cell whose rows are alike stays whole. Rows lie in the order of their cells over
files of bounded size: a large cell has several."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from millrace.operators import search

#: Rows that the first centroids and the books are fitted to, drawn evenly by a hash of the key; and rows of each cell that is split.
SAMPLE, SPLIT_SAMPLE = 20_000, 2_000
#: Cells at first, at most: the sample has some for each. More come by splitting.
FIRST_CELLS = 512
#: Parts of a vector that have a code of one byte each, about so many dimensions in one.
PART = 4
#: Rows that are queries when the number of cells for a recall is measured (expected).
TUNED = 100
#: Rows of a file, about; and how many candidates are scored by their vectors for each row that is asked for.
FILE_ROWS, AGAIN = 1_000_000, 20


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def fit(sample: np.ndarray, cells: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centroids by spherical k-means; cells that run empty start again at a row far from its centroid."""
    x, r = unit(sample.astype(np.float64)), np.random.default_rng(seed)
    centroids = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        own = near.argmax(1)
        for k in range(len(centroids)):
            mine = x[own == k]
            centroids[k] = mine.sum(0) if len(mine) else x[near.max(1).argmin()]
        centroids = unit(centroids)
    return centroids


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of these by distance."""
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def _book(x: np.ndarray, entries: int = 256, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """Plain k-means of one part."""
    r = np.random.default_rng(seed)
    book = x[r.choice(len(x), min(entries, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, book)
        n = np.bincount(own, minlength=len(book))
        for j in range(x.shape[1]):
            total = np.bincount(own, x[:, j], len(book))
            book[n > 0, j] = total[n > 0] / n[n > 0]
    return book


class Codebook:
    """Leaf cells with their centroids, the cells that were split with those they were split into, and a book for each part."""

    def __init__(self, centroids: np.ndarray, books: list[np.ndarray]):
        self.first, self.books = np.arange(len(centroids)), books
        self.centroids = centroids  # of all cells that there ever were, by number
        self.children: dict[int, np.ndarray] = {}

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def leaves(self) -> np.ndarray:
        return np.array([k for k in range(len(self.centroids)) if k not in self.children], np.int64)

    @classmethod
    def fitted(cls, sample: np.ndarray, cells: int) -> Codebook:
        width = sample.shape[1]
        x = unit(sample.astype(np.float64)) if len(sample) else np.zeros((1, width))
        centroids = fit(sample, cells) if len(sample) else np.zeros((1, width))
        left = x - centroids[(x @ centroids.T).argmax(1)]
        return cls(centroids, [_book(part) for part in np.array_split(left, max(1, width // PART), axis=1)])

    def place(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf cell of each unit vector, from the first cells, or from those where they are, downwards."""
        cell = self.first[(x @ self.centroids[self.first].T).argmax(1)] if at is None else at.copy()
        while (split := [k for k in np.unique(cell).tolist() if k in self.children]):
            for k in split:
                mine, below = np.flatnonzero(cell == k), self.children[k]
                cell[mine] = below[(x[mine] @ self.centroids[below].T).argmax(1)]
        return cell

    def code(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = np.array_split(x - self.centroids[cell], len(self.books), axis=1)
        return np.stack([_nearest(p, b) for p, b in zip(parts, self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, query: np.ndarray) -> list[np.ndarray]:
        """For each part the product of the query's part with every entry of its book."""
        return [b @ q for b, q in zip(self.books, np.array_split(query, len(self.books)), strict=True)]

    def near(self, query: Sequence[float], probes: int) -> list[int]:
        leaves = self.leaves()
        scores = self.centroids[leaves] @ unit(np.array([query], float))[0]
        return leaves[np.argsort(-scores, kind="stable")[:probes]].tolist()

    def split(self, cell: int, centroids: np.ndarray) -> None:
        self.children[cell] = len(self.centroids) + np.arange(len(centroids))
        self.centroids = np.concatenate([self.centroids, centroids])

    def rough(self, query: Sequence[float]) -> Column:
        """The score of a row by its columns cell and code."""
        q = unit(np.array([query], float))[0]
        base, tables = self.centroids @ q, self.tables(q)

        @F.arrow_udf("double")
        def score(cell: pa.Array, code: pa.Array) -> pa.Array:
            out = base[cell.to_numpy(zero_copy_only=False)]
            codes = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), len(tables))
            for j, t in enumerate(tables):
                out = out + t[codes[:, j]]
            return pa.array(out)

        return score(F.col("cell"), F.col("code"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(bytearray(pickle.dumps(self)),)], "bytes binary").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Codebook:
        return pickle.loads(bytes(spark.read.parquet(path).first()["bytes"]))

    def probes_for(self, rows: DataFrame, key: str, recall: float, k: int = 10) -> int:
        """How many cells a query needs so that about this part of its k nearest rows (key, vector, cell) lie in them, measured on TUNED rows as queries against all rows."""
        drawn = rows.where(_share(key, TUNED, rows.count())).where("vector is not null").select(F.col(key).alias("query_id"), F.col("vector").alias("query_vector"))
        near = search.semantic_batch(rows, drawn, k, -1.0, key).join(rows.select(key, "cell"), key).join(drawn, "query_id").select("query_vector", "cell").toArrow()  # k rows for each of them
        if not near.num_rows:
            return 1
        leaves = self.leaves()
        order = np.argsort(-(unit(_matrix(near.column("query_vector").combine_chunks(), self.width)) @ self.centroids[leaves].T), axis=1, kind="stable")
        rank = (leaves[order] == near.column("cell").to_numpy()[:, None]).argmax(1)
        return int(np.quantile(rank, recall, method="higher")) + 1


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of a list column; null, and lists of another length, as zeros."""
    out = np.zeros((len(column), dimensions))
    same = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
    out[same.to_numpy(zero_copy_only=False)] = column.filter(same).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return out


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.codebook = Codebook.load(spark, f"{self.path}/codebook")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "chunk_id", cells: int | None = None, most: int | None = None) -> VectorIndex:
        """vectors: key, vector and other columns. Cells number about the square root of the rows, unless given; `most` rows are in a cell, unless they are alike."""
        spark, n = vectors.sparkSession, vectors.count()
        book, rows = grown(vectors, path, key, n, cells, most)
        files = max(1, -(-n // FILE_ROWS))
        rows.repartitionByRange(files, "cell", F.xxhash64(key)).sortWithinPartitions("cell").write.parquet(f"{path}/rows")
        book.save(spark, f"{path}/codebook")
        clear(spark, path)
        return cls(spark, path, key)

    def rows(self, query: Sequence[float], probes: int | None = None) -> DataFrame:
        """The rows of the `probes` cells nearest to the query; of all, if None."""
        held = self.spark.read.parquet(f"{self.path}/rows")
        return held if probes is None or probes >= len(self.codebook.leaves()) else held.where(F.col("cell").isin(self.codebook.near(query, probes)))

    def search(self, query: Sequence[float], k: int = 10, probes: int | None = None, threshold: float = 0.0, as_of: int | None = None, max_age_days: int | None = None, path_prefix: str | None = None, **options) -> DataFrame:
        """As search.semantic. With probes, the best codes of the nearest cells (AGAIN for each row that is asked for) are scored by their vectors; filters come before any choice."""
        equal = {c: v for c, v in options.items() if c != "freshness_boost"}
        held = search.filtered(self.rows(query, probes), as_of, max_age_days, path_prefix, **equal)
        if probes is not None and len(query) == self.codebook.width:
            best = held.select(self.key, self.codebook.rough(query).alias("__rough")).orderBy(F.desc("__rough"), self.key).limit(AGAIN * max(k, 1)).select(self.key)
            held = held.join(F.broadcast(best), self.key, "left_semi")
        return search.semantic(held.drop("cell", "code"), query, k, threshold, self.key, as_of, options.get("freshness_boost", 0.0))

    def probes_for(self, recall: float, k: int = 10) -> int:
        """As Codebook.probes_for() over the rows of the index."""
        return self.codebook.probes_for(self.spark.read.parquet(f"{self.path}/rows"), self.key, recall, k)

    def batch(self, queries: DataFrame, k: int = 10, probes: int | None = None, threshold: float = 0.0) -> DataFrame:
        """query_id, key, score, rank: the k best of each query (query_id, query_vector) among the rows of its nearest cells; among all, without probes."""
        held = self.spark.read.parquet(f"{self.path}/rows")
        return search.semantic_batch(held, queries, k, threshold, self.key, None if probes is None else (lambda q: self.codebook.near(q, probes)))


def grown(vectors: DataFrame, path: str, key: str, n: int, cells: int | None = None, most: int | None = None) -> tuple[Codebook, DataFrame]:
    """A codebook for n rows, and the rows with cell and code; tables lie below path until clear()."""
    cells = cells or max(1, min(FIRST_CELLS, int(n**0.5)))
    most = most or max(1024, 4 * int(n**0.5))
    drawn = vectors.where(_share(key, SAMPLE, n)).select("vector").toArrow().column("vector")  # the bounded sample
    width = pc.max(pc.list_value_length(drawn)).as_py() or 1
    book = Codebook.fitted(_matrix(drawn.filter(pc.equal(pc.list_value_length(drawn), width)).combine_chunks(), width), cells)
    rows = placed(vectors, book, f"{path}/placed-0")
    for k in range(1, 64):
        large = rows.groupBy("cell").count().where(F.col("count") > most)
        split = [r for r in _fitted(rows, large, key, most).collect() if len(r["centroids"]) > 1]  # one row for each large cell
        if not split:
            break
        for r in split:
            book.split(r["cell"], np.array(r["centroids"]).reshape(-1, width))
        rows = placed(rows, book, f"{path}/placed-{k}")
    return book, rows


def clear(spark: SparkSession, path: str) -> None:
    """Remove the tables of grown()."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(base):
        if f.getPath().getName().startswith("placed-"):
            fs.delete(f.getPath(), True)


def _share(key: str, rows: int, of: int) -> Column:
    """About so many rows, evenly by a hash of the key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(min(1.0, rows / max(1, of)) * (1 << 20))


def placed(rows: DataFrame, book: Codebook, path: str) -> DataFrame:
    """rows with cell and code, as a table; those whose cell was split go down from it."""
    spark, again = rows.sparkSession, "cell" in rows.columns
    held = spark.sparkContext.broadcast(book)
    fields = [f for f in rows.schema.fields if f.name not in ("cell", "code")]
    schema = StructType([*fields, StructField("cell", IntegerType()), StructField("code", BinaryType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            x = unit(_matrix(b.column("vector"), own.width))
            cell = own.place(x, b.column("cell").to_numpy(zero_copy_only=False).astype(np.int64) if again else None)
            codes = [bytes(c) for c in own.code(x, cell)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(cell.astype(np.int32)), pa.array(codes, pa.binary())], [*(f.name for f in fields), "cell", "code"])

    rows.mapInArrow(assign, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _fitted(rows: DataFrame, large: DataFrame, key: str, most: int) -> DataFrame:
    """cell, centroids (flat): for each large cell those that it is split into, fitted to about SPLIT_SAMPLE of its rows."""

    def fit_one(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["vector"].to_numpy()).astype(np.float64)
        found = fit(x, min(16, 2 * -(-int(part["count"].iloc[0]) // most)))
        found = found[np.unique((unit(x) @ found.T).argmax(1))]  # without those that no row is nearest to
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "centroids": [found.ravel() if len(found) > 1 else found.ravel()[:0]]})

    share = F.pmod(F.xxhash64(F.lit("split"), key), F.lit(1 << 20)) < F.lit(SPLIT_SAMPLE << 20) / F.col("count")
    width = F.max(F.size("vector")).over(_of_cell())
    drawn = rows.join(F.broadcast(large), "cell").where(share).select("cell", "count", "vector").withColumn("width", width).where(F.size("vector") == F.col("width"))
    return drawn.groupBy("cell").applyInPandas(fit_one, "cell int, centroids array<double>")


def _of_cell():
    from pyspark.sql.window import Window

    return Window.partitionBy("cell")  # of the sample
