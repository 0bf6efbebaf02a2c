"""Clustering around centroids with a filter of rotated coordinates (op 13).

Vectors become whole numbers, so every distance, sum and mean is exact and no result
depends on partitions or on the order of rows. The covariance, summed over partitions,
gives a rotation (its principal axes; the matrix has the width of a vector). With
every vector are stored its LEADING first rotated coordinates and the norm of the
others. For a centroid rotated in the same way,

    distance^2 >= (distance in the leading coordinates)^2 + (difference of the norms)^2,

so a pass computes these bounds for all centroids, the exact distance of the centroid
with the least bound, and exact distances in whole numbers for those centroids only whose
bound doesn't exceed it. A round is one pass over the stored table; every task returns
one sum per centroid and component, so only these are shuffled, and a large cluster is
as cheap as a small one. The driver sees the centroids alone.

Defined cases: only vectors of exactly DIM components take part, none of them null, non-finite
or 2^20 and above in size (their squared distances would not fit a long); a row
without id is assigned as others are but starts no centroid (and where no row has
an id the result is empty);
rows that repeat an id count one by one; of equal hashes (repeated ids) the smaller
vector starts first; with fewer vectors than centroids there are as many centroids as
vectors; equal distances go to the smaller number; a centroid without vectors stays;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import stored
from .registry import read_table, register

DIM = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
LEADING = 12
_LARGEST = float(1 << 20)
_SLACK = 1e-6  # of the sizes in a bound, against rounding in the rotation


def _matrix(column, dim: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def whole_numbers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<int>) of the vectors that take part: floor(scale * component)."""

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
            x = _matrix(column.take(pa.array(fits)), dim)
            good = (np.abs(x) < _LARGEST).all(axis=1)  # false for NaN
            ids = batch.column("vec_id").take(pa.array(fits[good]))
            x = np.floor(scale * x[good]).astype(np.int32)
            yield pa.record_batch([ids, pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dim, pa.array(x.ravel()))], names=["vec_id", "x"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id bigint, x array<int>")


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Principal axes of the vectors, the widest first, as columns."""

    def run(batches):
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = _matrix(batch.column("x"), dim).astype(float)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        at = np.arange(total.size, dtype=np.int32)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel())], names=["at", "s"])

    sums = rows.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((dim + 1) ** 2)
    total[sums.column("at").to_numpy()] = sums.column("s").to_numpy()
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def rotated(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the others."""
    y = x.astype(float) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


def with_bounds(rows: DataFrame, axes: np.ndarray, leading: int) -> DataFrame:
    """(vec_id, x, lead array<double>, rest double)."""

    def run(batches):
        for batch in batches:
            lead, rest = rotated(_matrix(batch.column("x"), len(axes)), axes, leading)
            lead = pa.ListArray.from_arrays(np.arange(len(lead) + 1, dtype=np.int32) * leading, pa.array(lead.ravel()))
            yield pa.record_batch([batch.column("vec_id"), batch.column("x"), lead, pa.array(rest)], names=["vec_id", "x", "lead", "rest"])

    return rows.mapInArrow(run, "vec_id bigint, x array<int>, lead array<double>, rest double")


def nearest_centroid(x, lead, rest, centroids, c_lead, c_rest) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row of whole numbers, and
    how many exact distances that took."""
    n = len(x)
    bound = (rest[:, None] - c_rest) ** 2
    for k in range(lead.shape[1]):
        bound += (lead[:, k, None] - c_lead[:, k]) ** 2
    size = (lead**2).sum(axis=1) + rest**2
    slack = _SLACK * (size[:, None] + (c_lead**2).sum(axis=1) + c_rest**2 + 1)
    cluster = bound.argmin(axis=1)
    distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
    rows, others = np.nonzero(bound - slack <= distance[:, None])
    again = others != cluster[rows]
    rows, others = rows[again], others[again]
    checked = ((x[rows] - centroids[others]) ** 2).sum(axis=1)
    # smaller distance first, then smaller number; the first guess stands among them
    rows, others, checked = np.concatenate([rows, np.arange(n)]), np.concatenate([others, cluster]), np.concatenate([checked, distance])
    order = np.lexsort((others, checked, rows))
    first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
    return others[first], checked[first], len(checked)


def _assigned(batches, centroids, axes, leading):
    """Per batch: ids, vectors, numbers and distances of the nearest centroids."""
    c_lead, c_rest = rotated(centroids, axes, leading)
    for batch in batches:
        x = _matrix(batch.column("x"), len(axes)).astype(np.int64)
        lead, rest = _matrix(batch.column("lead"), leading), batch.column("rest").to_numpy()
        if len(x):
            yield batch.column("vec_id"), x, *nearest_centroid(x, lead, rest, centroids, c_lead, c_rest)[:2]


def moved(rows: DataFrame, centroids: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors."""
    k, dim = centroids.shape

    def run(batches):
        total = np.zeros((k, dim + 1), np.int64)
        for _, x, cluster, _ in _assigned(batches, centroids, axes, leading):
            for c in np.unique(cluster):
                mine = x[cluster == c]
                total[c, :dim] += mine.sum(axis=0)
                total[c, dim] += len(mine)
        at = np.flatnonzero(total.ravel()).astype(np.int32)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], names=["at", "s"])

    # sums of 2^26 each: a decimal holds those of any table
    sums = rows.mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
    total = [[0] * (dim + 1) for _ in range(k)]
    for r in sums:
        total[r["at"] // (dim + 1)][r["at"] % (dim + 1)] = int(r["s"])
    return np.array([[s // t[dim] for s in t[:dim]] if t[dim] else old for t, old in zip(total, centroids.tolist())], np.int64).reshape(k, dim)


def first_centroids(rows: DataFrame, k: int, dim: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").orderBy(key, "x").limit(k).select("x").collect()
    return np.array([r.x for r in found], np.int64).reshape(-1, dim)


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, leading: int = LEADING) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    rows = stored(whole_numbers(vectors, dim, scale), "whole-vectors")
    centroids = first_centroids(rows, k, dim)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not len(centroids):  # no vector with an id
        return rows.sparkSession.createDataFrame([], schema), centroids
    axes = rotation(rows, dim)
    rows = stored(with_bounds(rows, axes, leading), "rotated-vectors")
    for _ in range(rounds):
        centroids = moved(rows, centroids, axes, leading)

    def run(batches):
        for ids, _, cluster, distance in _assigned(batches, centroids, axes, leading):
            yield pa.record_batch([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return stored(rows.mapInArrow(run, schema), "assigned-vectors"), centroids


_STEP = """
d{i} AS (SELECT v.row, c.cluster, sum((v.z - c.z) * (v.z - c.z)) AS distance FROM v JOIN c{i} c ON v.k = c.k GROUP BY v.row, c.cluster),
a{i} AS (SELECT row, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1),"""
_MOVE = """
m{i} AS (SELECT a.cluster, v.k, floor(sum(v.z)::DOUBLE / count(*))::BIGINT AS z FROM a{i} a JOIN v ON a.row = v.row GROUP BY a.cluster, v.k),
c{j} AS (SELECT c.cluster, c.k, coalesce(m.z, c.z) AS z FROM c{i} c LEFT JOIN m{i} m ON c.cluster = m.cluster AND c.k = m.k),"""
_SQL = (
    """
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS z FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row, vec_id, unnest(range(1, 65)) AS k, unnest(z)::BIGINT AS z FROM r),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM r WHERE vec_id IS NOT NULL QUALIFY cluster < 16),
c0 AS MATERIALIZED (SELECT s.cluster, v.k, v.z FROM s JOIN v ON s.row = v.row),"""
    + "".join((_STEP.format(i=i) + (_MOVE.format(i=i, j=i + 1) if i < ROUNDS else "")).replace(" AS (", " AS MATERIALIZED (") for i in range(ROUNDS + 1))
    + """
h AS (SELECT cluster, sha256(string_agg(z::VARCHAR, ',' ORDER BY k)) AS centroid_sha256 FROM c3 GROUP BY cluster)
SELECT r.vec_id, a.cluster::INT AS cluster, a.distance::BIGINT AS distance,
  (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a3 a JOIN r ON a.row = r.row JOIN h ON a.cluster = h.cluster
"""
)


@register("op13_centroid_clustering", _SQL)
def op13_centroid_clustering(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    rows, centroids = clusters(vectors)
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # one row a centroid
    of = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    of = spark.createDataFrame(of, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
