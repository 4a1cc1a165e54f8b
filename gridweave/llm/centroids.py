"""Centroid clustering in whole numbers, with distances screened by the norms of segments.

Vectors become integers, so sums, means and distances are exact and don't depend on how rows are
dealt. A vector is compressed once to two numbers a segment, its sum and the norm of what is
left when the segment's mean is taken off. By Cauchy-Schwarz the compressed distance is never
above the real one, so a centroid whose compressed distance exceeds a distance already known
can't be the nearest; only the others get exact distances.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.workspace import Workspace

CENTROIDS, ROUNDS, COMPONENTS = 40, 5, 64
#: Components of a segment.
SEGMENT = 8
#: Rows worked on at once.
CHUNK = 4096
#: Squared norms below this keep all distances, and sums of 2^31 distances of usual size, in 64 bits.
MOST_SQUARED = 1 << 60


def compress(x: np.ndarray) -> np.ndarray:
    """Rows of integers as rows of doubles whose distances bound theirs from below.

    Per segment: its sum over the root of its length, and the norm of the rest.
    """
    out = []
    for s in range(0, x.shape[1], SEGMENT):
        part = x[:, s : s + SEGMENT].astype(np.float64)
        mean = part.mean(1, keepdims=True)
        rest = part - mean
        out += [mean[:, 0] * part.shape[1] ** 0.5, np.sqrt((rest * rest).sum(1))]
    return np.stack(out, 1)


def assign(x: np.ndarray, small: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, exact distances taken) of integer rows with their compressed forms.

    Ties go to the smaller number. The bound has a slack for rounding, which lets more through, never less.
    """
    c_small = compress(centroids)
    bound = (small * small).sum(1)[:, None] + (c_small * c_small).sum(1)[None] - 2 * (small @ c_small.T)
    slack = 1e-9 * ((small * small).sum(1)[:, None] + (c_small * c_small).sum(1)[None] + 1)
    low = bound - slack
    guess = low.argmin(1)
    d = x - centroids[guess]
    known = (d * d).sum(1)
    row, k = np.nonzero(low <= known[:, None])
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    for s in range(0, len(row), 16 * CHUNK):
        r, j = row[s : s + 16 * CHUNK], k[s : s + 16 * CHUNK]
        d = x[r] - centroids[j]
        exact[r, j] = (d * d).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(len(x)), best], len(row)


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def prepare(vectors: DataFrame, components: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, order, whole, small): the kept vectors as packed integers and their compressed forms."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.coalesce((F.size("v") == components) & finite, F.lit(False)))
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.floor(256 * np.asarray(b.column(1).flatten(), np.float64)).reshape(len(b), components)
            if len(x) and ((x * x).sum(1) >= MOST_SQUARED).any():
                raise OverflowError("a vector is too long for exact 64-bit distances")
            x = x.astype(np.int64)
            small = compress(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in small], pa.binary())], ["vec_id", "whole", "small"])

    return rows.mapInArrow(run, f"vec_id {id_type}, whole binary, small binary")


def _assigned(rows: DataFrame, centroids: np.ndarray, totals: bool) -> DataFrame:
    """Each row's cluster and distance, or with ``totals`` each batch's counts and sums by cluster and component."""
    k, width = centroids.shape
    id_type = rows.schema["vec_id"].dataType.simpleString()
    shape = "cluster int, n long, sums array<long>" if totals else f"vec_id {id_type}, cluster int, distance long"

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for s in range(0, len(b), CHUNK):
                part = b.slice(s, CHUNK)
                x = _matrix(part.column(1), np.int64, width)
                small = _matrix(part.column(2), np.float64, -1)
                best, far, _ = assign(x, small, centroids)
                if totals:
                    count += np.bincount(best, minlength=k)
                    for j in np.unique(best):
                        sums[j] += x[best == j].sum(0)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])
        if totals:
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.int64()), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return rows.select("vec_id", "whole", "small").mapInArrow(run, shape)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Clusters of integer vectors after ``rounds`` of assigning and averaging, and a last assignment.

    Returns a row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 (of the final centroid's components as decimals joined by commas). Vectors that are
    null, of another length than ``components``, or hold null or non-finite components are left out.
    Centroids start as the vectors with the smallest SHA-256 of ``2:<id>``; rows that repeat an id
    are ordered by the bytes of their components, a null id comes last. With fewer vectors than ``k`` there are
    as many centroids as vectors; equal distances go to the smaller number, a cluster left empty
    keeps its centroid. An empty table gives an empty result; other columns are not read. A vector
    with a squared norm of 2^60 or more in whole numbers is an error, since distances would leave 64 bits.

    A round sends the driver one row for each centroid and component, whatever the table's size.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark)
    rows = ws.save(prepare(vectors, components, id_col, vec_col))
    start = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    # rows that repeat an id have an order of their bytes
    first = rows.orderBy(start.asc_nulls_last(), "whole").limit(k).select("whole").collect()
    if not first:
        return ws.finish(rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")))
    centroids = np.stack([np.frombuffer(r[0], np.int64) for r in first])
    for _ in range(rounds):
        parts = _assigned(rows, centroids, totals=True)
        cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in cells.collect():  # a row a centroid and component
            centroids[r.cluster, r.at] = r.s // r.n
    out = ws.save(_assigned(rows, centroids, totals=False))
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    found = [(r.cluster, r.cluster_inertia) for r in inertia.collect()]  # a row a centroid
    total = sum(x for _, x in found)
    told = spark.createDataFrame([(i, x, total, dict(digests)[i]) for i, x in found], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ws.finish(out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
