"""Centroid clustering in exact whole numbers, screened by float32 products with rigorous intervals of their rounding error."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import column_of, remove, written
from needledrop.llm.vectors import SUMS, as_long, finite, floors, largest, matrix, means, narrowed, per_task, smallest, summed, total_long

#: Products (vectors times centroids) that a task holds at a time.
PRODUCTS = 1 << 21
#: Half a unit in the last place of a float32, of a double.
U32, U64 = 2.0**-24, 2.0**-53


def within(dim: int) -> int:
    """Components up to this size have squared distances that fit in a long, and products far below the largest float32."""
    return int((2**60 // dim) ** 0.5) // 2


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|^2 - 2 x.c, which orders centroids as their distance does, for every vector and centroid.

    A float32 product of n terms, added up in any order, is off by at most g |x|.|c| with g = (n+2) u / (1 - (n+2) u)
    (u for each rounding of a factor, of a product and of each sum), and |x|.|c| is at most the product of the lengths.
    The lengths, |c|^2 and the bounds themselves are doubles: 16 of their roundings are added for good measure.
    """
    g = (x.shape[1] + 2) * U32
    g = g / (1 - g) * (1 + 16 * U64)
    xd, cd = x.astype(np.float64), c.astype(np.float64)
    lengths = np.sqrt((xd * xd).sum(axis=1))[:, None] * np.sqrt((cd * cd).sum(axis=1))[None, :] * (1 + (x.shape[1] + 16) * U64)
    square = (cd * cd).sum(axis=1)[None, :]
    value = square - 2 * (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    off = 2 * g * lengths + (x.shape[1] + 16) * U64 * (square + 2 * lengths)
    return value - off, value + off


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centroid, the smallest of equally near ones; x, c: whole numbers."""
    if x.dtype == object or c.dtype == object or max(largest(x), largest(c)) > within(x.shape[1]):
        return exactly_nearest(x.astype(object), c.astype(object))
    out = np.empty(len(x), np.int64)
    step = max(1, PRODUCTS // len(c))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        low, high = intervals(part, c)
        near = low <= high.min(axis=1, keepdims=True)
        best = near.argmax(axis=1)
        for some in np.array_split(rows := np.flatnonzero(near.sum(axis=1) > 1), max(1, len(rows) * len(c) // (PRODUCTS >> 4))):
            if len(some):
                i, j = np.nonzero(near[some])  # by vector, then by centroid: the first minimum is the smallest number
                d = ((part[some[i]] - c[j]) ** 2).sum(axis=1)
                starts = np.flatnonzero(np.diff(i, prepend=-1))
                first = np.where(d == np.minimum.reduceat(d, starts)[i], np.arange(len(d)), len(d))
                best[some] = j[np.minimum.reduceat(first, starts)]
        out[at : at + step] = best
    return out


def exactly_nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """nearest() for numbers of any size, one vector at a time."""
    return np.array([min(range(len(c)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(row, c[k], strict=True)), k)) for row in x], dtype=np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to that of c, exact."""
    if x.dtype == object or c.dtype == object or max(largest(x), largest(c)) > within(x.shape[1]):
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(axis=1)


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for the vectors of dim finite components.

    Components become floor(scale * x), exact whatever their size. Centroids start as the k vectors with the smallest
    sha256 of "seed:vec_id"; each round assigns every vector to its nearest one and moves the centroids to the floors of
    their means; then vectors are assigned once more. All decisions are those of whole numbers: float32 products only
    leave out centroids that can't be the nearest, by bounds of their rounding error; what the bounds can't part is
    compared exactly, ties go to the smaller number. A task returns one exact sum for each centroid and component; the
    driver holds k centroids and nothing that grows with the input.

    Other vectors (null, empty, another length, null or non-finite components) are left out. Rows with the same vec_id are
    vectors of their own; as starts those with equal hashes come in the order of their bytes, those without vec_id last.
    Fewer than k vectors: as many centroids. An empty table gives no row. Extra columns are ignored. Distances and sums
    beyond the largest long are shown as the largest long; decisions aren't touched by that.
    """
    rows, kind = finite(vectors, F.col("vec_id").cast("long").alias("vec_id"))
    rows = written(rows.where(F.octet_length("data") == dim * np.dtype(kind).itemsize), "cluster-vectors")
    ticket = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = smallest(rows, F.coalesce(ticket, F.lit("~")), k)
    schema = "vec_id long, cluster int, distance long"
    if not starts:
        return vectors.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = floors(np.stack([np.frombuffer(x, kind) for x in starts]).astype(np.float64), scale)
    k, shape = len(centroids), (len(centroids), dim + 1)

    def sums(batch: pa.RecordBatch, c: np.ndarray) -> np.ndarray:
        x = floors(matrix(column_of(batch, "data"), kind), scale)
        to = nearest(x, c)
        out = np.zeros(shape, dtype=object)
        order = np.argsort(to, kind="stable")
        names, at = np.unique(to[order], return_index=True)
        out[names, :dim] = np.add.reduceat(x[order] if largest(x) < 2**40 else x[order].astype(object), at, axis=0)
        out[names, dim] = np.diff(at, append=len(x))
        return out

    for _ in range(rounds):
        c = narrowed(centroids)
        centroids = means(centroids, summed(rows.mapInArrow(per_task(lambda batch, c=c: sums(batch, c), shape), SUMS), shape))
    final = narrowed(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = floors(matrix(column_of(batch, "data"), kind), scale)
                to = nearest(x, final)
                yield pa.RecordBatch.from_arrays([column_of(batch, "vec_id"), pa.array(to.astype(np.int32)), pa.array(as_long(distances(x, final[to])))], names=["vec_id", "cluster", "distance"])

    found = written(rows.mapInArrow(assign, schema), "clusters")
    remove(rows)
    digests = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centroids.tolist()]
    names = vectors.sparkSession.createDataFrame([*enumerate(digests)], "_c int, centroid_sha256 string")
    inertia = found.groupBy(F.col("cluster").alias("_k")).agg(total_long("distance").alias("cluster_inertia"))
    whole = found.agg(total_long("distance").alias("inertia"))
    each = F.broadcast(inertia.crossJoin(whole).join(names, F.col("_k") == F.col("_c")))  # k rows
    return found.join(each, F.col("cluster") == F.col("_k")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    """What op11 gives, for DuckDB: all distances of every round."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q"
        " FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, v.vec_id, v.q, c.c, {far} AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(q) AS x FROM a{i}) GROUP BY c, i)")
            parts.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.q, ',')) AS centroid_sha256
FROM {last} a JOIN c{rounds} z ON a.c = z.c"""


SQL = _sql()
