"""Centroid clustering: plain Lloyd rounds over integer vectors.

The centroids are broadcast. In each round mapInPandas computes, in NumPy, the squared differences of its vectors to
each centroid as integers, takes the nearest (argmin: of equal ones the lowest index) and sums its vectors by
centroid; these sums, at most one row for each centroid and partition, merge through groupBy, and only they come to
the driver. The last assignment is written once, its distances summed by cluster and joined back (one row a cluster).

Defined results: vectors with another number of components, or with one that is null, NaN or infinite, are left out, a
null vector too; a null vec_id hashes as empty text, comes last among equal hashes and keeps its row; repeated
rows are vectors of their own, and may start as two equal centroids; with fewer vectors than centroids each vector
starts one; an empty table gives an empty result; components beyond 2^26 after scaling (x beyond 262,144), whose
squared distances would not fit a long, count as 2^26 with their sign; sums of distances beyond a long count as the
largest long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lent, materialise

COMPONENTS = 64
CENTROIDS, ROUNDS = 40, 5
SCALE = 256
#: Components beyond this count as it: 64 squares of twice as much fit a long.
MOST = 1 << 26
#: Vectors that are compared at once: a block of them and its differences lie in memory.
BLOCK = 4096
_LONG = (1 << 63) - 1


def kept(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, vector of the rows whose vector has so many components, all of them finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.where((F.size(v) == components) & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def whole(vectors: pd.Series) -> np.ndarray:
    """floor(SCALE * x) of each component, one row a vector."""
    if not len(vectors):
        return np.zeros((0, 0), np.int64)
    x = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * SCALE)
    return np.clip(x, -MOST, MOST).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of each vector and the squared distance to it."""
    apart = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        apart[:, k] = np.einsum("ij,ij->i", d, d)
    own = apart.argmin(1)
    return own, apart[np.arange(len(x)), own]


def _assigned(parts: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[tuple[pd.Series, np.ndarray, np.ndarray, np.ndarray]]:
    for part in parts:
        for k in range(0, len(part), BLOCK):
            block = part.iloc[k : k + BLOCK]
            x = whole(block["vector"])
            yield block["vec_id"] if "vec_id" in block else None, x, *nearest(x, centroids)


def first_centroids(vectors: DataFrame, n: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """The n vectors with the smallest hash of their id, in its order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("vector", hashed.alias("hash"), F.col("vec_id").isNull().alias("none")).orderBy("hash", "none", "vector").limit(n).select("vector").collect()  # n rows
    return whole(pd.Series([np.array(r[0]) for r in rows]))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: of each non-empty one the floor of the mean of its vectors."""
    n, width = centroids.shape
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    names = [f"s{k}" for k in range(width)]

    def sums(parts):
        with lent(held) as own:
            count, total = np.zeros(n, np.int64), np.zeros((n, width), np.int64)
            for _, x, at, _ in _assigned(parts, own):
                count += np.bincount(at, minlength=n)
                for k in np.unique(at).tolist():
                    total[k] += x[at == k].sum(0)
        there = np.flatnonzero(count)
        if len(there):
            yield pd.DataFrame({"cluster": there, "n": count[there], **{c: total[there, k] for k, c in enumerate(names)}})

    partial = vectors.select("vector").mapInPandas(sums, f"cluster long, n long, {', '.join(f'{c} long' for c in names)}")
    merged = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()  # one row a centroid
    out = centroids.copy()
    for r in merged:
        out[r.cluster] = [r[c] // r.n for c in names]
    return out


def lloyd(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2) -> np.ndarray:
    """The final centroids, one row each. vectors: as kept() gives them."""
    centroids = first_centroids(vectors, n, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def found(parts):
        with lent(held) as own:
            for ids, _, at, apart in _assigned(parts, own):
                yield pd.DataFrame({"vec_id": ids.astype("Int64"), "cluster": at.astype(np.int32), "distance": apart})

    return vectors.mapInPandas(found, "vec_id long, cluster int, distance long")


def _capped(total: Column) -> Column:
    return F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("long")


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256."""
    spark = assigned.sparkSession
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    sums = [(r.cluster, r.own) for r in sums.collect()]  # one row a centroid
    total = min(_LONG, int(sum(s for _, s in sums)))
    digest = dict(names)
    about = spark.createDataFrame([(k, min(_LONG, int(s)), total, digest[k]) for k, s in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    vectors = kept(table, id_col, vector_col)
    centroids = lloyd(vectors, n, rounds, seed)
    return described(materialise(assign(vectors, centroids), "cluster-assigned"), centroids)


def op12(spark, sf_dir):
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = "select id, any_value(vec_id) as vec_id, any_value(x) as x, arg_min(k, d * 1000 + k) as k, min(d) as d from (select id, vec_id, x, k, {apart}::hugeint as d from v, {c}) group by id"
    parts = [
        f"""v as materialized (select row_number() over () as id, vec_id, list_transform(embedding, lambda e: floor(e::double * {SCALE})::bigint) as x from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {COMPONENTS})""",
        f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as k, x as c from v order by sha256('2:' || vec_id) limit {CENTROIDS})",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} as materialized ({near.format(apart=apart, c=f'c{r}')})")
        parts.append(f"m{r} as (select k, i, sum(e) as s, count(*) as n from (select k, unnest(x) as e, generate_subscripts(x, 1) as i from a{r}) group by k, i)")
        parts.append(f"n{r} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from m{r} group by k)")
        parts.append(f"c{r + 1} as materialized (select k, coalesce(n{r}.c, c{r}.c) as c from c{r} left join n{r} using (k))")
    parts.append(f"z as materialized ({near.format(apart=apart, c=f'c{ROUNDS}')})")
    return f"""with {', '.join(parts)}
select vec_id, k::int as cluster, d::bigint as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256 from z join c{ROUNDS} using (k)"""


ORACLE = _oracle()
