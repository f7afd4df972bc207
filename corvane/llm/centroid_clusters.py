"""Centroid clustering of whole-number vectors: Lloyd's rounds with screening by block norms.

A vector is compressed once to the norms of its segments. For a vector v and a centroid c the sum over segments of
(|v_b| - |c_b|)**2 is at most their squared distance (Cauchy-Schwarz in each segment), and all of these bounds are one
product of short matrices. The centroid of the least bound gives a first exact distance; then only centroids whose bound does not
exceed the best exact distance so far get an exact distance in whole numbers, the smaller number winning ties. Bounds are
doubles, lowered by more than their rounding, so they only ever cost a comparison.

Vectors and norms are written once to the shared folder; a round reads them, and each task returns a count and a sum for each
cluster. The driver holds the centroids.

Edge cases: vectors that are null, hold null or non-finite components or have another number of components than ``dims``
are left out, and so are those with a component that scales to 2**27 or more, whose distances would not fit a long. Vectors
without an id begin no centroid; rows of one id stand in the order of their components; fewer than ``k`` vectors make fewer
centroids. An empty table gives an empty result. Extra columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io
from . import _vectors as V

BLOCKS = 16
#: What bounds are lowered by, in parts of the numbers they are made from and absolutely.
SLACK, LEAST = 1e-9, 1.0


def norms(x: np.ndarray, blocks: int) -> np.ndarray:
    """The norm of each of ``blocks`` segments of every row."""
    cuts = np.linspace(0, x.shape[1], min(blocks, x.shape[1]) + 1).astype(int)[:-1]
    return np.sqrt(np.add.reduceat((x * x).astype(np.float64), cuts, axis=1))


def nearest(x: np.ndarray, short: np.ndarray, centroids: np.ndarray, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every vector, its squared distance, and how many exact distances that took."""
    n = len(x)
    brief = norms(centroids, blocks)
    a, b = (short * short).sum(1)[:, None], (brief * brief).sum(1)[None, :]
    low = a - 2 * (short @ brief.T) + b - (SLACK * (a + b) + LEAST)
    at = low.argmin(1)
    d = x - centroids[at]
    best, made = (d * d).sum(1), n
    first = at.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= best) & (first != c))
        if len(rows):
            d = x[rows] - centroids[c]
            d = (d * d).sum(1)
            made += len(rows)
            nearer = (d < best[rows]) | (d == best[rows]) & (c < at[rows])
            at[rows[nearer]], best[rows[nearer]] = c, d[nearer]
    return at, best, made


def _compressed(table: DataFrame, carried: list[str], scale: int, dims: int) -> DataFrame:
    """(carried, v, norms): whole-number vectors and the norms of their segments."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.select(*carried).schema] + T._parse_datatype_string("v array<int>, norms array<double>").fields)
    held = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.whole(V.matrix(batch.column(held), dims), scale)
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], V.lists(x, pa.int32()), V.lists(norms(x, BLOCKS), pa.float64())], names=schema.names)

    return table.select(*carried, "v").mapInArrow(_io.lean(run), schema)


def _sums(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, count, sums) of each task."""
    k, dims = centroids.shape
    width = min(BLOCKS, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = V.matrix(batch.column(0), dims).astype(np.int64)
            at, _, _ = nearest(x, V.matrix(batch.column(1), width), centroids)
            order = np.argsort(at, kind="stable")
            ranked = at[order]
            if len(ranked):
                first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                sums[ranked[first]] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(at, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), V.lists(sums[used], pa.int64())], names=["cluster", "count", "sums"])

    return table.select("v", "norms").mapInArrow(_io.lean(run), "cluster int, count long, sums array<long>")


def _assigned(table: DataFrame, carried: list[str], centroids: np.ndarray) -> DataFrame:
    """(carried, cluster, distance)."""
    dims, held = centroids.shape[1], len(carried)
    width = min(BLOCKS, dims)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.select(*carried).schema] + T._parse_datatype_string("cluster int, distance long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, best, _ = nearest(V.matrix(batch.column(held), dims).astype(np.int64), V.matrix(batch.column(held + 1), width), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(at, pa.int32()), pa.array(best, pa.int64())], names=schema.names)

    return table.select(*carried, "v", "norms").mapInArrow(_io.lean(run), schema)


def centroid_clusters(df: DataFrame, vector: str = "embedding", id: str = "vec_id", k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, salt: str = "2:", keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """``keep`` (all columns but the vector if None) with ``__cv_cluster`` and ``__cv_distance``; the centroids.

    Centroids begin as the ``k`` vectors whose ids, after ``salt``, have the smallest SHA-256.
    """
    spark = df.sparkSession
    _io.bounded_batches(spark, rows=4096)
    names = [c for c in df.columns if c != vector] if keep is None else keep
    carried = [_io.OWN + f"k{i}" for i in range(len(names))]
    order = F.sha2(F.concat(F.lit(salt), F.col(id).cast("string")), 256)
    table = df.select(*[F.col(f"`{c}`").alias(c2) for c, c2 in zip(names, carried, strict=True)], order.alias("h"), F.col(vector).cast("array<double>").alias("v")).filter((F.size("v") == dims) & V.usable(F.col("v"), scale))
    first = [r.v for r in table.filter("h is not null").select("h", "v").orderBy("h", "v").limit(k).collect()]
    centroids = V.whole(np.array(first, np.float64).reshape(len(first), dims), scale)
    if not len(first):
        return df.select(*[f"`{c}`" for c in names], F.lit(None).cast("int").alias(_io.OWN + "cluster"), F.lit(None).cast("long").alias(_io.OWN + "distance")).filter(F.lit(False)), centroids
    table = _io.materialize(_compressed(table, carried, scale, dims))
    for _ in range(rounds):
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for c, n, x in V.summed(_sums(table, centroids), ["cluster"]):
            count[c], sums[c] = n, x
        centroids = V.floors(sums, count, centroids)
    out = _assigned(table, carried, centroids)
    return out.select(*[F.col(c2).alias(c) for c, c2 in zip(names, carried, strict=True)], F.col("cluster").alias(_io.OWN + "cluster"), F.col("distance").alias(_io.OWN + "distance")), centroids


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = centroid_clusters(_io.read(spark, sf_dir, "embeddings"), keep=["vec_id"])
    out = _io.materialize(out.select("vec_id", F.col(_io.OWN + "cluster").alias("cluster"), F.col(_io.OWN + "distance").alias("distance")))
    sizes = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a centroid
    total = sum(r.cluster_inertia for r in sizes)
    rows = [(r.cluster, r.cluster_inertia, total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sizes]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64) -> str:
    place = 1 << k.bit_length()
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS y FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, min(d) AS m FROM
  (SELECT vec_id, v, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - y[i]) * (v[i] - y[i]))) AS BIGINT) * {place} + c AS d FROM v, c{r}) GROUP BY vec_id, v)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s.y, c{r}.y) AS y FROM c{r} LEFT JOIN
  (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS y FROM (SELECT m % {place} AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY c) s USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, m // {place} AS distance, CAST(sum(m // {place}) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m // {place}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM (SELECT vec_id, m, m % {place} AS c FROM a{rounds}) JOIN c{rounds} USING (c)
"""


ORACLE = _oracle()
