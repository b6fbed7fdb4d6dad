"""Pieces that the corpus operators share: shared scratch tables, size-checked broadcasts, crc splits."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.plans.session import materialise  # noqa: F401
from millrace.plans.session import shared_folder as scratch  # noqa: F401

#: Rows of a narrow table (a few dozen bytes each) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000

#: ASCII white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing lazy reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace/" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast df if counting shows it is within the bound; otherwise leave the join to shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: Column, rows: int | None = None, salts: int = 32) -> DataFrame:
    """Inner join on a key of which the left may have very many rows and the right has one row each.

    A small right side is broadcast; beyond that each of its rows goes to every salt, and spread deals the left rows over them."""
    n = right.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key)
    salted = right.withColumn("__salt", F.explode(F.lit(list(range(salts)))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def _is_scan(plan) -> bool:
    """Whether each row of a plan is one row of a file, at most once."""
    children = plan.children()
    if children.size() == 0:
        return plan.nodeName().startswith(("Relation", "LogicalRelation"))
    return children.size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and _is_scan(children.apply(0))


def free(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with as many signs added as make it one that docs has no column of, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def place(docs: DataFrame) -> tuple[Column, Column]:
    """The file and the row number of each row of a scan, though docs may have a column of the name of the metadata."""
    about = docs.metadataColumn("_metadata")
    return about.getField("file_path"), about.getField("row_index")


def located(docs: DataFrame) -> DataFrame:
    """docs itself if it is a scan of files, whose rows a file and a row number find; else (rows may come twice) a copy that is one."""
    if _is_scan(docs._jdf.queryExecution().analyzed()):
        try:
            docs.select(*place(docs)).schema  # noqa: B018
            return docs
        except AnalysisException:
            pass
    return materialise(docs, "located")


def row_keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, unique and the same whenever it is read: the rank of its file and its place there. docs has no column `name`.

    Files are ranked in one task, by name; there are far fewer of them than rows."""
    docs = located(docs)
    file, row, rank = free(docs, "__file", "__row", "__rank")
    at = place(docs)
    files = docs.select(at[0].alias(file)).distinct()
    ranked = materialise(files.withColumn(rank, F.row_number().over(Window.orderBy(file)).cast("long")), "files")
    out = docs.select("*", at[0].alias(file), at[1].alias(row))
    return out.join(small(ranked), file).select(*(out[c] for c in docs.columns), (F.shiftleft(ranked[rank], 40) + out[row]).alias(name))


def crc_split(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows held out: crc32 of the id as text leaves the remainder. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def tidy() -> None:
    """Give freed memory back to the system: workers are reused and would otherwise keep their largest size."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


@contextmanager
def lent(held: Broadcast):
    """The value of a broadcast, which the worker forgets at the end: workers are reused, and would keep the models of earlier stages."""
    try:
        yield held.value
    finally:
        held.__dict__.pop("_value", None)
        tidy()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about limit bytes of text (or one longer text)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        while at < n:
            to, total = at, 0
            while to < n and (to == at or total + sizes[to] <= limit):
                total += int(sizes[to])
                to += 1
            yield batch.slice(at, to - at)
            at = to
    tidy()


_PLAIN = np.arange(256, dtype=np.uint8)  # ASCII letters become lower case, other ASCII white space
for _c in range(128):
    _PLAIN[_c] = ord(chr(_c).lower()) if chr(_c).isalpha() else 32


def plain_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words between ASCII characters that are no letters, ASCII in lower case: the distinct ones, the place of each word
    of the texts among them, and where each text begins and ends. White space at the ends leaves empty words. Null counts as empty."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    size = int(np.frombuffer(offsets, np.int32, 1, 4 * len(texts))[0]) if len(texts) else 0
    plain = _PLAIN[np.frombuffer(data, np.uint8, size)] if size else np.zeros(0, np.uint8)
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(plain)))
    coded = lists.flatten().dictionary_encode()
    edges = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), edges - edges[0]


def ragged(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + width[0] - 1, begin[1], ..."""
    ends = np.cumsum(width)
    return np.repeat(begin - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)


def arrow_map(df: DataFrame, f: Callable[..., pa.RecordBatch], schema: str, column: str = "text", model: object = None) -> DataFrame:
    """mapInArrow over slices of bounded bytes; a model is broadcast and handed to f, and forgotten after each partition."""
    held = None if model is None else df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        if held is None:
            yield from map(f, slices(batches, column))
        else:
            with lent(held) as own:
                for part in slices(batches, column):
                    yield f(part, own)

    return df.mapInArrow(run, schema)
