"""Centroid clustering of integer vectors with a PCA-rotated filter before the exact distances.

Vectors are turned into integers ``floor(scale * x)``; centroids start as the vectors whose ids have the
smallest sha256, each round assigns every vector to its nearest centroid (squared Euclidean distance, ties to
the smaller number) and moves each non-empty centroid to the exact floor of its vectors' mean.

Method: one pass sums the vectors' moments; the eigenvectors of the 64 x 64 covariance rotate every vector.  Of
the rotated vector the ``leading`` coordinates and the norm of the rest are stored.  For a vector x and a
centroid c the squared distance of the leading coordinates plus the squared difference of the two norms is never
above the squared distance of x and c, as the rotation keeps distances and the rests differ by at least the
difference of their norms.  A centroid whose bound (less a margin for rounding) exceeds the exact distance of
the centroid with the smallest bound can't win; the survivors are verified in integers.

Distribution: rotated vectors are written once to the shared folder; each round is one pass over them, whose
tasks return one partial sum per centroid and component, so a centroid that holds a third of all rows costs no
more than others.  The driver holds the centroids and the moments only (fixed size).

Defined cases:
* a vector that is null, has another length, or holds a null, NaN or infinity is left out; so is none else;
* repeated ids and rows count one by one; equal ids (and so hashes) start in ascending order of their vectors;
  rows without an id have no hash: they are assigned, and start a centroid only where too few rows have one;
* fewer kept vectors than ``k`` give as many centroids; an empty table gives no rows;
* components of any finite size are exact (beyond 2^26 in Python integers, and then without the filter);
  a distance or inertia that doesn't fit a long is null;
* other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensortwin.llm.common import ship, slices, stored

COMPONENTS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Rotated coordinates that are stored beside the norm of the rest.
LEADING = 16
#: Integers up to this absolute value take the vectorised path: 64 squares of their differences fit a long.
NARROW = 1 << 26
#: Part of the squared norms by which a bound may be off through rounding (doubles are good to about 1e-15).
MARGIN = 1e-9
#: Partial sums are split into limbs of so many bits, so that Spark adds them exactly in longs.
LIMB_BITS = 40


def usable(vector: Column, components: int = COMPONENTS) -> Column:
    """The vector has the right length and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
            components: int = COMPONENTS, scale: int = SCALE, leading: int = LEADING) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of every kept vector, written to the shared folder, and the final
    centroids."""
    ship(df.sparkSession)
    kept = df.select(F.col(id).alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(usable(F.col("x"), components))
    narrow = F.forall("x", lambda x: F.abs(x) <= (NARROW - 1) / scale)
    whole = kept.select("vec_id", F.when(narrow, F.transform("x", lambda x: F.floor(x * scale).cast("int"))).alias("ints"),
                        F.when(~narrow, F.col("x")).alias("wide"))
    axes = _axes(whole, components)
    rows = stored(whole.mapInArrow(_rotate(axes, leading), T.StructType(
        [*whole.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])), "centroid-rows")
    first = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k)
    centers = [[math.floor(Fraction(v) * scale) for v in r.x] for r in first.collect()]  # k vectors
    for _ in range(rounds if centers else 0):
        centers = _moved(rows, centers, axes, leading, scale)
    out = T.StructType([whole.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return stored(rows.mapInArrow(_assign(centers, axes, leading, scale), out), "centroid-clusters"), centers


def digest(assigned: DataFrame, centers: list[list[int]]) -> DataFrame:
    """The assigned rows with the inertia of their cluster and of all, and a digest of their centroid."""
    spark = assigned.sparkSession
    known = F.count("distance") == F.count(F.lit(1))  # a sum is unknown where one distance is
    per = assigned.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()  # k rows
    total = None if any(r.s is None for r in per) else sum(int(r.s) for r in per)

    def as_long(value) -> int | None:
        return int(value) if value is not None and value < 1 << 63 else None

    facts = [(r.cluster, as_long(r.s), as_long(total), hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()) for r in per]
    side = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# -- rotation -------------------------------------------------------------------------------------
def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The non-null lists of a column as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _axes(whole: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, by falling variance of the vectors along them."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width + width + 1)
        for batch in batches:
            x = _matrix(batch.column("ints"), width).astype(np.float64)
            total += np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["m"])

    sums = (whole.select("ints").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("at", "v"))
            .groupBy("at").agg(F.sum("v").alias("v")).collect())  # width * width + width + 1 rows
    m = np.zeros(width * width + width + 1)
    for r in sums:
        m[r.at] = r.v
    n = max(m[-1], 1.0)
    mean = m[width * width : -1] / n
    values, vectors = np.linalg.eigh(m[: width * width].reshape(width, width) / n - np.outer(mean, mean))
    return np.ascontiguousarray(vectors[:, np.argsort(-values)])


def _parts(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the norm of the others."""
    turned = x @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(1))


def _rotate(axes: np.ndarray, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ints = batch.column("ints")
                there = ints.is_valid().to_numpy(zero_copy_only=False)
                lead, rest = _parts(_matrix(ints, len(axes)).astype(np.float64), axes, leading)
                offsets = np.concatenate([[0], np.cumsum(there) * leading]).astype(np.int32)
                norms = np.zeros(len(there))
                norms[there] = rest
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lead.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(norms, pa.float64())], names=[*batch.schema.names, "lead", "rest"])

    return run


# -- assignment ------------------------------------------------------------------------------------
def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centers: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of every row of ``x`` (all within ``NARROW``), and the number of
    exact distances that took."""
    c_lead, c_rest = _parts(centers.astype(np.float64), axes, lead.shape[1])
    size = (lead**2).sum(1) + rest**2
    c_size = (c_lead**2).sum(1) + c_rest**2
    bound = np.maximum(size[:, None] + c_size - 2 * (lead @ c_lead.T + np.outer(rest, c_rest)), 0) - MARGIN * (size[:, None] + c_size) - MARGIN
    which = bound.argmin(1)
    best = ((x - centers[which]) ** 2).sum(1)
    exact = len(x)
    guess = which.copy()
    for j in range(len(centers)):
        rows = np.flatnonzero((bound[:, j] <= best) & (guess != j))
        if len(rows):
            d = ((x[rows] - centers[j]) ** 2).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (j < which[rows]))
            best[rows[better]], which[rows[better]] = d[better], j
            exact += len(rows)
    return which, best, exact


def _nearest_plain(x: list[int], centers: list[list[int]]) -> tuple[int, int]:
    d, j = min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers))
    return j, d


def _clusters(batch: pa.RecordBatch, centers: list[list[int]], axes: np.ndarray, leading: int, scale: int):
    """Of one batch: (row numbers, vectors, cluster, distance) of the narrow rows as arrays, and the same as lists
    of the others."""
    there = batch.column("ints").is_valid().to_numpy(zero_copy_only=False)
    x = _matrix(batch.column("ints"), len(axes)).astype(np.int64)
    wide = [(int(i), [math.floor(Fraction(v) * scale) for v in batch.column("wide")[int(i)].as_py()]) for i in np.flatnonzero(~there)]
    at = np.flatnonzero(there)
    if any(abs(v) > NARROW for c in centers for v in c):  # a wide vector has drawn a centroid away
        wide += [(int(i), row) for i, row in zip(at, x.tolist(), strict=True)]
        at, x = at[:0], x[:0]
    which, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(x):
        lead = _matrix(batch.column("lead"), leading)
        rest = batch.column("rest").to_numpy(zero_copy_only=False)[at]
        which, best, _ = nearest(x, lead, rest, np.array(centers, np.int64), axes)
    return (at, x, which, best), [(i, row, *_nearest_plain(row, centers)) for i, row in wide]


def _assign(centers: list[list[int]], axes: np.ndarray, leading: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                (at, _, which, best), wide = _clusters(batch, centers, axes, leading, scale)
                clusters, distances = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
                clusters[at], distances[at] = which, best
                unknown = np.zeros(batch.num_rows, bool)
                for i, _, j, d in wide:
                    clusters[i], unknown[i] = j, d >= 1 << 63
                    distances[i] = 0 if unknown[i] else d
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(clusters), pa.array(distances, pa.int64(), mask=unknown)],
                                                 names=["vec_id", "cluster", "distance"])

    return run


def _moved(rows: DataFrame, centers: list[list[int]], axes: np.ndarray, leading: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floors of the exact means; those without vectors stay."""
    k, width = len(centers), len(axes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (width + 1) for _ in range(k)]
        for whole in batches:
            for batch in slices(whole):
                (_, x, which, _), wide = _clusters(batch, centers, axes, leading, scale)
                part = np.zeros((k, width + 1), np.int64)
                np.add.at(part, which, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
                for j in range(k):
                    total[j] = [a + b for a, b in zip(total[j], part[j].tolist(), strict=True)]
                for _, row, j, _ in wide:
                    total[j] = [a + b for a, b in zip(total[j], [*row, 1], strict=True)]
        found = [(j, at, limb, v) for j in range(k) if total[j][-1] for at, s in enumerate(total[j]) for limb, v in enumerate(_limbs(s))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                                             names=["cluster", "at", "limb", "v"])

    parts = rows.mapInArrow(sums, "cluster int, at int, limb int, v long").groupBy("cluster", "at", "limb").agg(F.sum("v").alias("v"))
    total = [[0] * (width + 1) for _ in range(k)]
    for r in parts.collect():  # k * (components + 1) rows, times the limbs of the largest sum
        total[r.cluster][r.at] += r.v << (LIMB_BITS * r.limb)
    return [[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(total, centers, strict=True)]


def _limbs(value: int) -> list[int]:
    """``value`` in base 2^LIMB_BITS, low limbs first, each with the sign of ``value``."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest or not out:
        out.append(sign * (rest & ((1 << LIMB_BITS) - 1)))
        rest >>= LIMB_BITS
    return out
