"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). Candidate boundaries are keys drawn from the data; every round
counts the exact bytes below each candidate over all partitions and narrows the bracket of each boundary, until
a boundary is within the tolerance or no key is left between its brackets. Then the rows are exchanged once.
The law is `bytes`: shards hold nearly equal bytes. Equal texts are neighbours in the order; a group larger than
a shard is cut by doc_id.

Each shard consists of several ranges with splitters of their own, so that no task sorts a whole shard and the
slot of a row is its rank in its range plus the rows of the ranges before it.

Defined results: a null text has size 1 and crc32 0, like an empty one; a null doc_id sorts first; fully repeated
rows share a key, so they go to one range; a very long text is one row of its size, never cut, so a shard may exceed its
share by it; fewer rows than shards leave shards empty; an empty table gives an
empty result; other columns are carried along (those named as outputs are replaced).
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import discard, documents, materialise

SHARDS = 16
#: Of a shard's bytes, how far a shard boundary may be from its ideal place.
TOLERANCE = 0.0005
#: Keys drawn per open bracket and round (expected).
DRAWN = 32
#: Bytes that one task sorts, about. The driver holds the splitters and probes: some dozens for each range.
RANGE_BYTES = 512 << 20

_LOW = -(1 << 63)


def _pack_arrays(h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Sixteen bytes per key that compare as (h, i) does."""
    out = np.empty((len(h), 2), ">u8")
    for k, v in enumerate((h, i)):
        out[:, k] = v.view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S16")[:, 0]


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return _pack_arrays(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "id")))


def _pack(keys: list[tuple[int, int]]) -> np.ndarray:
    out = np.array([[h - _LOW, i - _LOW] for h, i in keys], np.uint64).reshape(-1, 2).astype(">u8")
    return out.view("S16")[:, 0]


def bytes_below(table: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) of the rows with key < probe, for each of the sorted probes."""
    packed, n = _pack(probes), len(probes)

    def counted(batches):
        size, rows = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for b in batches:
            at = np.searchsorted(packed, _keys(b), "right")
            size += np.bincount(at, b.column("size").to_numpy(zero_copy_only=False), n + 1).astype(np.int64)
            rows += np.bincount(at, minlength=n + 1)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(size[full]), pa.array(rows[full])], ["bin", "size", "rows"])

    size, rows = [0] * (n + 1), [0] * (n + 1)
    for r in table.select("h", "id", "size").mapInArrow(counted, "bin int, size long, rows long").groupBy("bin").agg(F.sum("size"), F.sum("rows")).collect():  # one row per probe
        size[r[0]], rows[r[0]] = r[1], r[2]
    return list(zip(np.cumsum(size[:n]).tolist(), np.cumsum(rows[:n]).tolist(), strict=True))


def draw(table: DataFrame, brackets: list[tuple[tuple[int, int], tuple[int, int], int]], seed: int) -> list[tuple[int, int]]:
    """About DRAWN keys of each disjoint, sorted bracket (low, high, rows inside): those whose mixed hash is small."""
    lows, highs = _pack([b[0] for b in brackets]), _pack([b[1] for b in brackets])
    rates = np.array([min(1.0, DRAWN / max(1, b[2])) for b in brackets])

    def pick(batches):
        for b in batches:
            keys = _keys(b)
            at = np.searchsorted(lows, keys, "left") - 1
            inside = (at >= 0) & (keys < highs[np.maximum(at, 0)])
            h, i = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "id"))
            z = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + i.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed * 0x94D049BB133111EB % (1 << 64))
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(29)
            take = inside & ((z >> np.uint64(11)).astype(float) * 2.0**-53 < rates[np.maximum(at, 0)])
            yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(i[take])], ["h", "id"])

    return sorted({(r[0], r[1]) for r in table.select("h", "id").mapInArrow(pick, "h long, id long").distinct().collect()})  # DRAWN a bracket


def splitters(table: DataFrame, total: int, rows: int, parts: int, strict: int, tolerance: float) -> list[tuple[int, int]]:
    """parts - 1 keys that cut table into parts of equal bytes; every strict-th as near as the tolerance asks, the others within a quarter of a part."""
    low, high = (_LOW, _LOW), (-_LOW - 1, -_LOW - 1)
    known = {low: (0, 0), high: (total, rows)}
    best: dict[int, tuple[int, int]] = {}
    spent: set[tuple] = set()  # brackets without a key between their ends
    for seed in count():  # each round draws keys within all open brackets, so it ends
        keys = sorted(known)
        sizes = [known[k][0] for k in keys]
        pending: dict[tuple, int] = {}
        for k in range(1, parts):
            want = total * k / parts
            j = min(max(1, bisect_left(sizes, want)), len(keys) - 1)
            lo, hi = keys[j - 1], keys[j]
            best[k] = lo if want - sizes[j - 1] <= sizes[j] - want else hi
            slack = (tolerance * strict if k % strict == 0 else 0.25) * total / parts
            if abs(known[best[k]][0] - want) > slack and (lo, hi) not in spent:
                pending[lo, hi] = known[hi][1] - known[lo][1]
        if not pending:
            return [best[k] for k in sorted(best)]
        drawn = draw(table, sorted((lo, hi, n) for (lo, hi), n in pending.items()), seed)
        spent |= {(lo, hi) for (lo, hi), n in pending.items() if n <= DRAWN and not any(lo < k < hi for k in drawn)}
        if drawn:
            known |= dict(zip(drawn, bytes_below(table, drawn), strict=True))


def _placer(spark, cuts: list[tuple[int, int]]):
    """A function of the columns h and id: how many cuts are <= the key. Only the keys go through Arrow, for a binary search in the broadcast cuts."""
    held = spark.sparkContext.broadcast(_pack(cuts))

    @F.pandas_udf("int")
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        keys = _pack_arrays(h.to_numpy(np.int64), i.to_numpy(np.int64))
        return pd.Series(np.searchsorted(held.value, keys, "right").astype(np.int32))

    return place


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with shard, slot and the range within the shard that a task wrote (`shard_range`)."""
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    i = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    table = materialise(docs.select(h.alias("h"), i.alias("id"), size.alias("size")), "shard-keys")
    total, rows = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    per_shard = max(1, -(-total // (shards * range_bytes)), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    parts = shards * per_shard
    cuts = splitters(table, total, rows, parts, per_shard, tolerance)
    distinct = sorted(set(cuts))
    below = dict(zip(distinct, bytes_below(table, distinct), strict=True))
    starts = [0, *(below[c][1] for c in cuts)]
    discard(table)
    offsets = [starts[k] - starts[k - k % per_shard] for k in range(parts)]
    frame = docs.drop("shard", "slot", "shard_range", "__h", "__i").withColumns({"__h": h, "__i": i})
    frame = frame.withColumn("shard_range", _placer(spark, cuts)(F.col("__h"), F.col("__i")))
    rank = F.row_number().over(Window.partitionBy("shard_range").orderBy("__h", "__i"))
    offset = F.element_at(F.lit(offsets), F.col("shard_range") + 1)
    return frame.withColumn("slot", offset.cast("long") + rank - 1).withColumn("shard", F.floor(F.col("shard_range") / per_shard).cast("int")).drop("__h", "__i")


def op10(spark, sf_dir):
    out = histogram_shards(documents(spark, sf_dir))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
