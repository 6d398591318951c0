"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector carries, from round to round in a table of the shared folder, its centroid, one upper bound of the distance to
it and one lower bound of the distance to the second nearest. When centroids move, the upper bound grows by the own
centroid's drift and the lower bound shrinks by the largest drift of the others. Where the upper bound stays below the
lower one (or below half the distance from the own centroid to its nearest neighbour) the assignment can't have changed;
else the own distance is computed anew, and vectors that are still ambiguous are scanned against all centroids in exact
integers, ties to the smaller number. Bounds are rounded outwards, so rounding never decides.

A round reads the table once and writes it once, without a shuffle of vectors: tasks sum their vectors by centroid, and
only those sums (a row for each task and centroid) are gathered. Sums are exact: 38-digit decimals.

Vectors take part if they have exactly `dims` components, none null, not finite, or beyond 524,288 in size (whose squared
distances needn't fit a long). Null ids take part but never start a centroid. Repeated rows: each counts; of a repeated id
the smaller vector starts first. Fewer vectors than centroids: as many centroids as there are vectors with an id; none: no
rows. Empty clusters keep their centroid. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = 1 << 27
#: Bounds are widened by this, relatively: more than the rounding of a square root and a few sums.
SLACK = 1e-12
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>) of the rows of vectors(vec_id, embedding) that take part."""
    v = F.col("embedding").cast("array<double>")
    scaled = F.transform(v, lambda x: F.floor(x * scale))
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<int>").alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x by rows of c), as long."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most < 1 << 20:  # all products and sums are whole numbers below 2**53
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c[cluster]
    return (d * d).sum(1)


class Step:
    """The centroids of a round, and how far each came from those before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        near = np.sqrt(squared(now, now).astype(np.float64))
        np.fill_diagonal(near, np.inf)
        self.half = near.min(1) / 2 * (1 - SLACK)
        drift = np.zeros(len(now)) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.drift = drift
        #: The largest drift among the other centroids, for each.
        top = np.argsort(-drift, kind="stable")
        self.others = np.full(len(now), drift[top[0]])
        self.others[top[0]] = drift[top[1]] if len(now) > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact: nearest centroid, and both bounds anew."""
        d = squared(x, self.now)
        cluster = d.argmin(1)  # the first of equals
        rows = np.arange(len(x))
        upper = np.sqrt(d[rows, cluster].astype(np.float64)) * (1 + SLACK)
        if d.shape[1] == 1:
            return cluster, upper, np.full(len(x), np.inf)
        d[rows, cluster] = np.iinfo(np.int64).max
        return cluster, upper, np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The state after the centroids moved, and how many vectors were scanned."""
        cluster, upper, lower = cluster.copy(), (upper + self.drift[cluster]) * (1 + SLACK), (lower - self.others[cluster]) * (1 - SLACK)
        lower = np.where(lower < 0, -np.inf, lower)
        limit = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= limit)
        upper[open_] = np.sqrt(own_squared(x[open_], self.now, cluster[open_]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[upper[open_] >= limit[open_]]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return cluster, upper, lower, len(open_)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _state(rows: DataFrame, step: Step, dims: int) -> DataFrame:
    """rows (STATE, or without bounds before the first round) after assignment to the step's centroids."""
    fresh = "cluster" not in rows.columns

    def run(batches):
        for b in batches:
            x = _vectors(b.column(1), dims)
            state = step.scan(x) if fresh else step.assign(x, *(b.column(c).to_numpy() for c in (2, 3, 4)))[:3]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s, t) for s, t in zip(state, (pa.int32(), pa.float64(), pa.float64()), strict=True))], ["vec_id", "v", "cluster", "upper", "lower"])

    return rows.mapInArrow(C.tidy(run), STATE)


def _moved(rows: DataFrame, now: np.ndarray) -> np.ndarray:
    """Centroids after the assignment in rows: exact floors of means; a row for each task and centroid is all that is summed."""
    k, dims = now.shape

    def run(batches):
        sums, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for b in batches:
            x, cluster = _vectors(b.column(1), dims).astype(np.int64), b.column(2).to_numpy()
            for c in np.unique(cluster):
                own = x[cluster == c]
                sums[c] += own.sum(0).astype(object)
                n[c] += len(own)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array([[str(s) for s in sums[c]] for c in used], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    part = rows.mapInArrow(C.tidy(run), "cluster int, n long, sums array<string>").select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    out = now.copy()
    for r in part.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # centroids x dims rows
        out[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return out


def centroids(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each row that takes part."""
    rows = C.stored(integers(vectors, dims, scale))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return rows.sparkSession.createDataFrame([], result)
    now, before = np.array([r["v"] for r in first], np.int64), None
    for _ in range(rounds):
        kept, rows = rows, C.stored(_state(rows, Step(now, before), dims))
        C.discard(kept)
        before, now = now, _moved(rows, now)
    last, step = now, Step(now, before)

    fresh = rounds == 0

    def run(batches):
        for b in batches:
            x = _vectors(b.column(1), dims)
            cluster = step.scan(x)[0] if fresh else step.assign(x, *(b.column(c).to_numpy() for c in (2, 3, 4)))[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(own_squared(x, last, cluster))], ["vec_id", "cluster", "distance"])

    found = C.stored(rows.mapInArrow(C.tidy(run), "vec_id long, cluster int, distance long"))
    C.discard(rows)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    whole = sum(sums.values())
    fits = lambda s: s if s < 1 << 63 else None
    about = [(c, fits(s), fits(whole), hashlib.sha256(",".join(map(str, last[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
