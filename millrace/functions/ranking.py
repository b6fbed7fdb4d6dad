"""Scores: cosine, freshness, blends, BM25. Times are seconds since the epoch; the present is always given."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
#: Days after which freshness has fallen to 1 / e, and what an unknown age counts.
HALF_WAY, UNKNOWN = 180.0, 0.5
OVERFETCH, LEAST_FETCH, MOST_FETCH = 4, 20, 200
PRESENCE = 0.5
K1, B = 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    """In double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """The cosine with a known vector, a batch of rows at a time; 0 if either is zero, null where the lengths differ."""
    q = np.array([float(x) for x in query])
    size = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        out, same = np.zeros(len(rows)), pc.fill_null(pc.equal(pc.list_value_length(rows), len(q)), False).to_numpy(zero_copy_only=False)
        x = rows.filter(pa.array(same)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(1, len(q)))
        sizes = np.sqrt(np.einsum("ij,ij->i", x, x)) * size
        out[same] = np.divide(x @ q, sizes, out=np.zeros(len(x)), where=sizes > 0) if len(q) else 0.0
        return pa.array(out, mask=~same)

    return score(a)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def cutoff(as_of: int, max_age_days: int | None) -> int | None:
    """The oldest time allowed; None or a negative age sets no limit."""
    return None if max_age_days is None or max_age_days < 0 else as_of - max_age_days * DAY


def freshness(modified: Column, as_of: int) -> Column:
    """Exponential decay; the future counts as now."""
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - modified).cast("double") / DAY)  # greatest skips nulls
    return F.when(modified.isNull(), UNKNOWN).otherwise(F.exp(-age / HALF_WAY))


def clamp(boost: float) -> float:
    return max(0.0, min(1.0, boost))


def blended(score: Column, fresh: Column, boost: float) -> Column:
    b = clamp(boost)
    return score * (1 - b) + fresh * b


def fetch_size(k: int, boost: float) -> int:
    return min(max(OVERFETCH * k, LEAST_FETCH), MOST_FETCH) if boost > 0 else k


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(tf: Column, df: Column, length: Column, n_docs: Column, mean_length: Column) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def typos_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2
