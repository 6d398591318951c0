"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into shards of about SHARD_ROWS rows by a hash of their id. In a shard, each tree is a sorted array of
64-bit strings, signs of orthogonal projections of its own. A query descends in every tree to its longest-prefix match and
then ascends synchronously: all trees give up a bit, one tree after the other, until together they hold as many members as
a shard's CANDIDATES and SHARE ask for; the best of those in single precision, with a margin for its error, are scored
exactly (double precision, one order of summation). A shard's vectors are held once, and the queries (a stated set) stream
past them in blocks of QUERY_BLOCK; a query's best over all shards are kept. The index holds every row; nothing is fitted.
Projections are seeded.

Equal vectors are one member of the trees with a list of their ids, of which at most k + 1 (the smallest) can be among a
query's k best, so groups of copies cost nothing and ties go to the smaller id exactly.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors meet
those of their own length only. Components of any size are fine, as the search works on scaled copies. Rows repeating an id
and vector count once; of a query id's different vectors the smallest is asked; a query is never its own neighbour. An empty
table or query set gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARD_ROWS, QUERY_BLOCK = 16384, 1024
TREES, BITS, SEED = 256, 64, 20
#: Of a shard's n members a query looks at about CANDIDATES + SHARE n different ones. Directions without structure in 64
#: dimensions need that for a recall of over 0.9 of the 20 nearest; structured ones need less.
CANDIDATES, SHARE = 700, 0.33


def planes(dims: int, trees: int, seed: int) -> np.ndarray:
    """(trees, dims, BITS) projections; within a tree orthogonal, in sets of as many as there are dimensions."""
    g = np.random.default_rng(seed)
    out = np.empty((trees, dims, BITS), np.float32)
    for t in range(trees):
        for at in range(0, BITS, dims):
            part = np.linalg.qr(g.standard_normal((dims, dims)))[0]
            out[t, :, at : at + dims] = part[:, : BITS - at]
    return out


class Forest:
    """Sorted arrays of hash strings over the distinct vectors x (rows)."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.planes = planes(x.shape[1], trees, seed)
        self.strings, self.order = [], []
        x = x.astype(np.float32)
        for t in range(trees):
            s = self.hashes(x, t)
            o = np.argsort(s, kind="stable").astype(np.int32)
            self.strings.append(s[o])
            self.order.append(o)

    def hashes(self, x: np.ndarray, t: int) -> np.ndarray:
        return np.packbits(x @ self.planes[t] > 0, axis=1).view(">u8").ravel().astype(C.U64)

    def ranges(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) by query and tree: the ranges of the longest common prefixes at which all trees together hold least;
        the last bit is given up by as many trees as it takes."""
        trees, n = len(self.order), len(self.order[0])
        q = q.astype(np.float32)
        own = [self.hashes(q, t) for t in range(trees)]
        low, high = np.zeros((len(q), trees), np.int64), np.full((len(q), trees), n, np.int64)
        before_a = before_b = np.zeros((len(q), trees), np.int64)
        left = np.arange(len(q))
        for bits in range(min(BITS, int(n).bit_length() + 8), -1, -1):
            if not len(left):
                break
            tail = C.U64((1 << (BITS - bits)) - 1)
            a = np.column_stack([np.searchsorted(s, o[left] & ~tail, "left") for s, o in zip(self.strings, own, strict=True)])
            b = np.column_stack([np.searchsorted(s, o[left] | tail, "right") for s, o in zip(self.strings, own, strict=True)])
            done = (b - a).sum(1) >= least
            if done.any():
                gain = (b - a - before_b + before_a)[done]
                need = least - (before_b - before_a)[done].sum(1)
                taken = np.cumsum(gain, 1) - gain < need[:, None]  # trees that give up this bit
                low[left[done]] = np.where(taken, a[done], before_a[done])
                high[left[done]] = np.where(taken, b[done], before_b[done])
            before_a, before_b, left = a[~done], b[~done], left[~done]
        return low, high

    def candidates(self, q: np.ndarray, different: int):
        """Members by query, about so many different ones: trees overlap as independent ones do."""
        n = len(self.order[0])
        if different >= n:
            for _ in range(len(q)):
                yield np.arange(n)
            return
        low, high = self.ranges(q, -np.log(1 - different / n) * n)
        for i in range(len(q)):
            held = np.zeros(n, bool)
            for o, a, b in zip(self.order, low[i], high[i], strict=True):
                held[o[a:b]] = True
            yield np.flatnonzero(held)


class Shard:
    """The vectors of a shard, of one length, ready to be asked."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int, least: int, share: float):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, member = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
        self.by = np.argsort(member, kind="stable")
        self.starts = np.searchsorted(member[self.by], np.arange(len(first) + 1))
        points = x[first]
        self.columns = np.ascontiguousarray(points.T)
        scaled = points * 2.0 ** -np.frexp(np.abs(points).max())[1]
        # one coordinate more makes all lengths equal: then the largest inner product has the smallest angle
        squares = (scaled**2).sum(axis=1)
        self.size = float(np.sqrt(squares.max()))
        self.forest = Forest(np.column_stack([scaled, np.sqrt(np.maximum(0, squares.max() - squares))]), trees)
        self.rough = scaled.astype(np.float32)
        self.different = int(least + share * len(points))
        self.scored = 0

    def ask(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        """(query_ids, vec_ids, scores): the k best found of each query."""
        scaled = q * 2.0 ** -np.frexp(np.abs(q).max(axis=1))[1].astype(float)[:, None]
        q32, out = scaled.astype(np.float32), []
        for i, found in enumerate(self.forest.candidates(np.column_stack([scaled, np.zeros(len(q))]), self.different)):
            self.scored += len(found)
            if len(found) > k + 1:
                near = self.rough[found] @ q32[i]
                margin = 4e-7 * self.rough.shape[1] * float(np.linalg.norm(scaled[i])) * self.size
                found = found[near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - margin]
            score = (self.columns[:, found] * q[i][:, None]).sum(axis=0)
            n = np.minimum(self.starts[found + 1] - self.starts[found], k + 1)
            at = np.repeat(self.starts[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            near, score = self.ids[self.by[at]], np.repeat(score, n)
            other = near != query_ids[i]
            near, score = near[other], score[other]
            best = np.lexsort((near, -score))[:k]
            out.append((np.full(len(best), query_ids[i]), near[best], score[best]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), dim of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, least: int = CANDIDATES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding) its k nearest of vectors found."""
    vectors, queries = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"), F.size(F.min("v")).alias("dim"))
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    here = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "dim", F.lit(False).alias("asks"), "vec_id", "v")
    ask = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "dim", F.lit(True).alias("asks"), "vec_id", "v")
    rows = here.unionByName(ask).repartition("shard").sortWithinPartitions("shard", "dim", "asks", "vec_id")

    def run(batches):
        now, held, shard, waiting, last = None, [], None, [], None

        def answered():
            ids, q = np.array([x for x, _ in waiting]), np.stack([v for _, v in waiting])
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(shard.ask(ids, q, k), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        for b in batches:
            shard_no, dim, asks, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            values, offsets = b.column(4).flatten().to_numpy(), np.concatenate([[0], np.cumsum(dim)])
            for i in range(b.num_rows):
                v = values[offsets[i] : offsets[i + 1]]
                if (shard_no[i], dim[i]) != now:
                    if waiting:
                        yield answered()
                    now, held, shard, last = (shard_no[i], dim[i]), [], None, None
                if not asks[i]:
                    if last is None or last[0] != ids[i] or not np.array_equal(last[1], v):
                        last = (ids[i], v.copy())
                        held.append(last)
                    continue
                if shard is None and held:
                    shard = Shard(np.array([x for x, _ in held]), np.stack([x for _, x in held]), trees, least, share)
                    held = []
                if shard is not None:
                    waiting.append((ids[i], v.copy()))
                    if len(waiting) >= QUERY_BLOCK:
                        yield answered()
        if waiting:
            yield answered()

    found = rows.mapInArrow(C.tidy(run), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
