"""Centroid clustering of embeddings: float32 screening with rigorous error intervals, exact integers where they overlap.

Vectors are turned into integers, so that every distance, sum and centroid is exact and reruns agree on any cluster.
An assignment of a batch of vectors is

1. *Screening.* One float32 matrix product gives all x.c. A product of n terms, rounded in any order, is off by at most
   gamma(n + 2) * |x| * |c|, two roundings being those of x and c themselves, with gamma(m) = m u / (1 - m u) and u = 2^-24.
   So |c|^2 - 2 x.c, which orders the centroids of a vector, lies in an interval that is known without doubt. Centroids
   whose interval begins above the lowest end of an interval can't be nearest.
2. *Exact distances.* Where one centroid is left, it is the nearest. Where intervals overlap, those centroids' distances
   are computed again in 64-bit integers; of equal ones the lowest number is taken.

Tasks sum up the vectors of each centroid as they assign them and give one row a centroid, so a round shuffles only rows
of (centroid, component); the driver gets ``k * dimensions`` sums and sends back as many components, which is all that it
ever holds. The integers are stored once, below the shared folder, and read once a round.

Rows whose vector is null, has another number of components, or has one that is null or not finite are left out. A null
``vec_id`` is clustered like others, but starts no centroid unless too few rows have an id; repeated rows count as often
as they occur. Fewer rows than ``k`` make fewer centroids; no rows give an empty table. Vectors at equal distances go to
the lower number; vectors whose identifiers are equal start centroids in the order of their components. Components
of ``LARGEST`` or more are an error, as their distances may not fit a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.arrays import lean
from tamis.llm.common import settle, stored, table

#: Integer components are below this, so 64 squares of differences are below 2^62.
LARGEST = 1 << 27
#: Rows of one float32 product.
ROWS = 4096
ROUNDING = 2.0**-24


def integers(vectors: DataFrame, dimensions: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<int>) of the usable rows of (vec_id, embedding): floor(scale * x)."""
    usable = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    fits = F.forall("v", lambda x: F.abs(x) < LARGEST)
    return rows.select("vec_id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more"))).cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the k rows that come first by the digest of their identifier."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def shortlist(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Mask (vector, centroid) of the centroids that may be nearest, by intervals of |c|^2 - 2 x.c."""
    n = points.shape[1] + 2
    gamma = n * ROUNDING / (1 - n * ROUNDING)
    x, c = points.astype(np.float64), centroids.astype(np.float64)
    product = (points.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    sizes = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * np.sqrt(np.einsum("ij,ij->i", c, c))[None, :]
    squares = np.einsum("ij,ij->i", c, c)[None, :]
    # the last term is far above what the float64 steps here can be off
    reach = 2 * gamma * sizes + 2.0**-40 * (squares + sizes)
    value = squares - 2 * product
    return value - reach <= (value + reach).min(axis=1, keepdims=True)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to the centroid in the same row."""
    apart = points.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", apart, apart)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of each point's nearest centroid; of equal distances the lowest."""
    out = np.empty(len(points), dtype=np.int32)
    for at in range(0, len(points), ROWS):
        rows = points[at : at + ROWS]
        left = shortlist(rows, centroids)
        chosen = left.argmax(axis=1)
        open_ = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_):
            row, number = left[open_].nonzero()
            exact = np.full((len(open_), len(centroids)), np.iinfo(np.int64).max)
            exact[row, number] = distances(rows[open_[row]], centroids[number])
            chosen[open_] = exact.argmin(axis=1)  # the first of equal ones
        out[at : at + ROWS] = chosen
    return out


def _points(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def sums(rows: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(centroid, component) -> (vectors, sum) of the vectors nearest to each centroid that has any."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            points = _points(batch, dimensions)
            number = nearest(points, centroids)
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            heads = np.flatnonzero(np.diff(number[order], prepend=-1))
            if len(heads):
                total[number[order][heads]] += np.add.reduceat(points[order].astype(np.int64), heads, axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some.astype(np.int32)), "n": pa.array(count[some]), "sums": pa.array(list(total[some]), pa.list_(pa.int64()))})

    parts = rows.select("v").mapInArrow(lean(run), "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    whole = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    return {(r["cluster"], r["at"]): (r["n"], int(r["total"])) for r in whole.collect()}


def moved(centroids: np.ndarray, found: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    """Centroids at the floor of their vectors' mean; those without vectors stay."""
    out = centroids.copy()
    for (number, at), (n, total) in found.items():
        out[number, at] = total // n
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch, centroids.shape[1])
            number = nearest(points, centroids)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": pa.array(number), "distance": pa.array(distances(points, centroids[number]))})

    return rows.select("vec_id", "v").mapInArrow(lean(run), "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable row of (vec_id, embedding), stored; the final centroids)."""
    settle(vectors.sparkSession)
    rows = stored(integers(vectors, dimensions, scale), "vectors")
    centroids = first_centroids(rows, k, salt).reshape(-1, dimensions)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(centroids, sums(rows, centroids))
        return stored(assigned(rows, centroids), "assigned"), centroids
    return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters with their inertia and the digest of their centroid."""
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(number, own, sum(inertia.values()), digests[number]) for number, own in inertia.items()]
    named = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    parts = [
        "usable as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "parts as materialized (select r, generate_subscripts(v, 1) as p, unnest(v) as x from usable)",
        f"firsts as (select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as c, v from usable order by c limit {k})",
        "c0 as materialized (select c, generate_subscripts(v, 1) as p, unnest(v) as y from firsts)",
    ]
    near = lambda t: f"n{t} as materialized (select r, c, d from (select r, c, d, row_number() over (partition by r order by d, c) as place from (select r, c, sum((x - y) * (x - y)) as d from parts join c{t} using (p) group by r, c)) where place = 1)"
    for t in range(rounds):
        parts += [
            near(t),
            f"m{t} as materialized (select c, p, sum(x) as s, count(*) as n from n{t} join parts using (r) group by c, p)",
            f"c{t + 1} as materialized (select c, p, case when n is null then y else cast((s - ((s % n) + n) % n) // n as bigint) end as y from c{t} left join m{t} using (c, p))",
        ]
    parts += [near(rounds), f"digests as (select c, sha256(string_agg(cast(y as varchar), ',' order by p)) as centroid_sha256 from c{rounds} group by c)"]
    last = f"select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256 from n{rounds} join usable using (r) join digests using (c)"
    return "with " + ",\n".join(parts) + "\n" + last


SQL = _sql()
