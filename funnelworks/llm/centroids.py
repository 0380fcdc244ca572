"""Centroid clustering with Ptolemaic pivots.

Vectors of whole numbers are assigned to their nearest centroid (squared
Euclidean distance, ties to the smaller number), and centroids become the
floored means of their vectors, for a number of rounds.

Pivots are the first centroids, so a later centroid mostly has a pivot close
by.  Every vector's distances to the pivots are computed once and stored with
it.  For a pair of pivots p and q, Ptolemy's inequality bounds the distance of
vector x to centroid c from below:

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

The fixed pairs join each pivot to the one farthest from it.  Bounds are
rounded down by more than the arithmetic can be off; the centroid of the least
bound is measured first, then every other one whose bound does not exceed that
distance, all in whole numbers.  So the result is that of comparing everything.

Per round a task sends one sum a centroid and component; centroids and pivots
are the only data of the driver.

Defined results: vectors that are null, of another length, or with a null, NaN
or infinite component are left out; equal vec_ids are vectors of their own
(first centroids of equal hash: in order of their components); a null vec_id
is hashed as empty text; fewer vectors than ``CLUSTERS`` give as many
centroids; an empty table gives no rows; components of ``LIMIT`` or more after
scaling are an error, as the squared distance would not fit a long; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import discard, stored, table

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = "1"
LIMIT = 1 << 27
#: Above the relative error of a bound: a few roundings of 2**-53 each.
SLACK = 2.0**-48
PIECE_ROWS = 2048


@dataclass(frozen=True)
class Pivots:
    """``at``: pivots as rows; ``pairs``: (p, q, distance) with distance above 0."""

    at: np.ndarray
    pairs: tuple[tuple[int, int, float], ...]

    @staticmethod
    def of(vectors: np.ndarray) -> Pivots:
        apart = distances(vectors, vectors)
        far = [(p, int(apart[p].argmax())) for p in range(len(vectors))]
        return Pivots(vectors, tuple((p, q, float(apart[p, q])) for p, q in far if apart[p, q] > 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to those of ``y``."""
    out = np.empty((len(x), len(y)))
    for j, other in enumerate(y):
        out[:, j] = np.sqrt(_squared(x, other[None, :]))
    return out


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def lower_bounds(cached: np.ndarray, to_pivot: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Of every vector (row) and centroid (column), from their distances to the pivots."""
    least = np.zeros((len(cached), len(to_pivot)))
    for p, q, apart in pivots.pairs:
        one = cached[:, p, None] * to_pivot[None, :, q]
        two = cached[:, q, None] * to_pivot[None, :, p]
        bound = (np.abs(one - two) - SLACK * (one + two)) / apart
        np.maximum(least, bound * (1 - SLACK), out=least)
    return least


def nearest(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row, the squared distance, and how many
    distances were computed."""
    every = np.arange(len(x))
    bound = lower_bounds(cached, distances(centroids, pivots.at), pivots)
    guess = bound.argmin(1)
    first = _squared(x, centroids[guess])
    left = bound * bound * (1 - SLACK) <= first[:, None] * (1 + SLACK)
    left[every, guess] = False
    rows, columns = left.nonzero()
    found = np.full(left.shape, np.iinfo(np.int64).max)
    found[every, guess] = first
    found[rows, columns] = _squared(x[rows], centroids[columns])
    cluster = found.argmin(1)  # the first of equal ones
    return cluster, found[every, cluster], len(x) + len(rows)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as binary values that sort like their components."""
    return pa.array([row.tobytes() for row in (x + (1 << 31)).astype(">u4")], pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u4").astype(np.int64).reshape(-1, width) - (1 << 31)


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the packed floor(scale * component), of the vectors that
    have all components.  ``vectors``: vec_id, embedding."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
            batch = batch.filter(right)
            parts = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            whole = np.isfinite(parts).all(1)
            scaled = np.floor(parts[whole] * scale)
            if (np.abs(scaled) >= LIMIT).any():
                raise ValueError(f"a component is {LIMIT} or more after scaling")
            ids = batch.column(0).filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([ids, _packed(scaled.astype(np.int64))], names=["vec_id", "x"])

    asked = vectors.select("vec_id", "embedding")
    return asked.mapInArrow(take, f"vec_id {asked.schema['vec_id'].dataType.simpleString()}, x binary")


def first_centroids(kept: DataFrame, clusters: int, seed: str, dimensions: int) -> np.ndarray:
    """The vectors of the least hashes, in that order."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(told, 256).alias("hash"), "x").orderBy("hash", "x").limit(clusters).collect()
    return _unpacked(pa.array([bytes(r["x"]) for r in rows], pa.binary()), dimensions)


def with_pivot_distances(kept: DataFrame, pivots: Pivots) -> DataFrame:
    width = pivots.at.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_unpacked(batch.column(1), width), pivots.at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in far], pa.binary())], names=["vec_id", "x", "far"])

    return kept.mapInArrow(measure, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, x binary, far binary")


def _pieces(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: Pivots):
    """(ids, components, nearest(...)) of the rows, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            piece = batch.slice(at, PIECE_ROWS)
            x = _unpacked(piece.column(1), centroids.shape[1])
            cached = np.frombuffer(b"".join(piece.column(2).to_pylist())).reshape(len(x), -1)
            yield piece.column(0), x, nearest(x, cached, centroids, pivots)


def moved(vectors: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The centroids after one round over ``vectors`` (vec_id, x, far)."""
    k, width = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, x, (cluster, _, _) in _pieces(batches, centroids, pivots):
            order = cluster.argsort(kind="stable")
            there, begin = np.unique(cluster[order], return_index=True)
            total[there] += np.add.reduceat(x[order], begin, axis=0)
            count += np.bincount(cluster, minlength=k)
        numbers = np.repeat(np.arange(k), width), np.tile(np.arange(width), k)
        columns = [*numbers, total.ravel(), np.repeat(count, width)]
        some = columns[3] > 0
        yield pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in columns], names=["cluster", "component", "total", "n"])

    summed = vectors.mapInArrow(add_up, "cluster long, component long, total long, n long").groupBy("cluster", "component")
    out = centroids.copy()
    for r in summed.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # centroids x components rows
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, pivots: Pivots) -> DataFrame:
    """vec_id, cluster, distance (squared) and measured, the distances
    computed for the row's piece, told with its first row."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, (cluster, distance, measured) in _pieces(batches, centroids, pivots):
            told = np.zeros(len(cluster), np.int64)
            told[:1] = measured
            arrays = [ids, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(told)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance", "measured"])

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, measured long"
    return vectors.mapInArrow(assign, schema)


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """The assignment of ``vectors`` (vec_id, embedding) as stored by
    ``assigned``, and the final centroids."""
    kept = whole_vectors(vectors, dimensions, scale)
    centroids = first_centroids(kept, clusters, seed, dimensions)
    pivots = Pivots.of(centroids)
    measured = stored(with_pivot_distances(kept, pivots), "pivot-distances")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(measured, centroids, pivots)
    out = stored(assigned(measured, centroids, pivots), "assigned")
    discard(measured)
    return out, centroids


def op13_ptolemaic_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
    whole = sum(int(r["s"]) for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(r["cluster"], int(r["s"]), whole, digest[r["cluster"]]) for r in sums]
    centres = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(centres), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql_round(n: int) -> str:
    """CTEs: the assignment to centroids ``c<n>``, and the centroids after it."""
    return f"""
d{n} AS (
  SELECT k.r, k.vec_id, k.x, c.c, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (k.x[i] - c.x[i]) * (k.x[i] - c.x[i]))) AS d
  FROM kept k, c{n} c
), a{n} AS (SELECT r, min({{'d': d, 'c': c}}) AS best, first(vec_id) AS vec_id, first(x) AS x FROM d{n} GROUP BY r),
m{n} AS (
  SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, unnest(range(1, {DIMENSIONS + 1})) u(i) GROUP BY best.c, i
), f{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{n} GROUP BY c),
c{n + 1} AS (SELECT c{n}.c, coalesce(f{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN f{n} USING (c))"""


OP13_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::HUGEINT) AS x
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x
  FROM kept QUALIFY c < {CLUSTERS}
), {", ".join(_sql_round(n) for n in range(ROUNDS + 1))}
SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance,
       (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c{ROUNDS}.x, lambda v: v::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = best.c
"""
