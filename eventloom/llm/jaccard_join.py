"""N-gram Jaccard join on a count-vector R-tree.

Every text becomes the set of its distinct k-word shingles, named by a 63-bit digest of the set, so copies are one member
from the start. Shingles are hashed into GROUPS groups, or more where a text is long (about PER_GROUP in each); the counts
by group are a point. For two points the sum of the coordinates' minima, at the coarser of their resolutions, bounds the
overlap from above, and for an R-tree node the same sum with the node's coordinate maxima bounds the overlap with anything
below it.

The R-trees are sharded: one for each set of members that share a key, where a member's keys are the first
n - ceil(t n) + 1 of its shingles in one global order (any order is right; shingles that a bounded sample shows to be
frequent come last, so that common passages make no shards). Two texts of similarity t share such a key, so each qualifying
pair meets in some tree. A tree gives the components of its bound's graph, as stars: rows in proportion to its members, not
to its pairs. Components over all trees are families; each pair that qualifies lies in one family.

A family of up to WHOLE weight is verified in one task on the sets themselves. A heavier one is dealt into shards, by bands
of size (texts that link are in one band or in neighbouring ones) and by digest: each shard is verified; then one member of
each component found goes to the other shards of its band and the neighbouring ones; then, as only a pair with a member
outside the family's largest component can still be missing, the other members of such components go there.
Pairs already in one component are never verified, so copies aren't expanded into pairs, and no link between components is
lost.

Nulls and empty texts: an empty set, linked with nothing. Null ids: a row each, never the smallest id. Repeated rows:
kept, each a row. Ties have no influence. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GROUPS, PER_GROUP = 64, 20
LEAF, FAN = 32, 8
#: Documents, at most about, in the sample that finds frequent shingles, and how many of those are used at most.
SAMPLE_DOCS, HOT_KEYS, HOT_SHARE = 4000, 1 << 16, 500
#: Weight (shingles, and MEMBER for each member) that one task verifies together.
WHOLE, MEMBER = 6_000_000, 200
#: Pairs, and counts of pairs, that a task bounds at a time.
PAIRS, CELLS = 250_000, 1_000_000
#: Groups, as a power of two, of the counts that bound pairs within a family.
FINE_BITS = 8


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """Shingles of at least a 500th of a bounded sample's texts, ascending; decides the order of keys only, never a result."""
    total = texts.count()
    sample = texts.sample(False, min(1.0, SAMPLE_DOCS / max(total, 1)), 7)

    def run(batches):
        for b in batches:
            for _, data, offsets in C.text_blocks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(C.distinct_shingles(data, offsets, k)[0].view(np.int64))], ["h"])

    least = max(4, min(total, SAMPLE_DOCS) // HOT_SHARE)
    rows = sample.mapInArrow(C.tidy(run), "h long").groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(HOT_KEYS).select("h").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64)).view(C.U64)


def point(h: np.ndarray) -> bytes:
    """Counts of shingles by their leading bits, behind the number of bytes of each."""
    groups = GROUPS
    while groups * PER_GROUP < len(h) and groups < 1 << 16:
        groups *= 2
    counts = np.bincount((C.mix(h) >> C.U64(64 - (groups.bit_length() - 1))).astype(np.int64), minlength=groups)
    width = 1 if counts.max(initial=0) < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def points(docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n and digest for each row; prefix and point too where the digest is new in its task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            for i, data, offsets in C.text_blocks(batch.column(1)):
                m = len(offsets) - 1
                h, d = C.distinct_shingles(data, offsets, k)
                n = np.bincount(d, minlength=m)
                ends = np.cumsum(n)
                digest = np.zeros(m, C.U64)
                some = np.flatnonzero(n)
                if len(h):
                    digest[some] = C.mix(np.add.reduceat(C.mix(h), (ends - n)[some]) + n[some].astype(C.U64)) >> C.U64(1)
                new = np.zeros(m, bool)
                for r in some:
                    if (x := int(digest[r])) not in seen:
                        seen.add(x)
                        new[r] = True
                key = h >> C.U64(1)
                if len(hot) and len(h):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    key |= (hot[at] == h).astype(C.U64) << C.U64(62)
                order = np.lexsort((key, d))
                key, rank = key[order], np.arange(len(h)) - np.repeat(ends - n, n)
                first = np.where(new, n - -(-num * n // den) + 1, 0)
                take = rank < np.repeat(first, n)
                offs = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, m),
                        hashes.slice(i, m),
                        pa.array(n),
                        pa.array(digest.view(np.int64), mask=n == 0),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(key[take].view(np.int64))),
                        pa.array([point(h[ends[r] - n[r] : ends[r]]) if x else None for r, x in enumerate(new)], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n", "digest", "prefix", "point"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(C.tidy(run), "doc_id long, text_hash long, n long, digest long, prefix array<long>, point binary")


def _trees(t: pa.Table):
    """Of the (key, digest) of some keys: the rows whose key another digest has as well. The key gives way to a hash of all its
    members, so that keys of the same members name one tree (a collision only makes a tree larger)."""
    key, digest = t["key"].to_numpy(), t["digest"].to_numpy()
    order = np.lexsort((digest, key))
    key, digest = key[order], digest[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
    key, digest = key[once], digest[once]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    tree = C.mix(np.add.reduceat(C.mix(~digest.view(C.U64)), starts) + sizes.astype(C.U64))
    several = np.flatnonzero(sizes > 1)
    chosen = np.zeros(len(starts), bool)
    chosen[several[np.unique(tree[several], return_index=True)[1]]] = True
    keep = np.repeat(chosen, sizes)
    yield from C.batches_of(pa.table({"key": np.repeat(tree, sizes)[keep].view(np.int64), "digest": digest[keep]}))


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each node's smallest known companion, a fixed point) after joining the nodes a with the nodes b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


class Points:
    """Texts of a task as points: sizes, and counts by group at each text's own resolution and at that of GROUPS."""

    def __init__(self, n: np.ndarray, points: list[bytes], num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.own = [np.frombuffer(x, f"<u{x[0]}", offset=1) for x in points]
        self.size = np.array([len(x) for x in self.own], np.int64)
        self.vec = self._matrix(np.arange(len(n)), GROUPS)
        self.finer: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _matrix(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(rows), size), np.int32)
        for have in np.unique(self.size[rows]):
            some = np.flatnonzero(self.size[rows] == have)
            out[some] = np.stack([self.own[i] for i in rows[some]]).reshape(len(some), size, -1).sum(2)
        return out

    def counts(self, i: np.ndarray) -> np.ndarray:
        return self.vec[i]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and the sum of coordinate minima allow similarity num / den."""
        na, nb = self.n[a], self.n[b]
        ok = self.num * np.maximum(na, nb) <= self.den * np.minimum(na, nb)
        self._bounded(ok, a, b, self.vec, a, b, np.flatnonzero(ok))
        finest = np.minimum(self.size[a], self.size[b])
        for size in np.unique(finest[ok & (finest > GROUPS)]).tolist():
            if size not in self.finer:
                rows = np.flatnonzero(self.size >= size)
                at = np.zeros(len(self.n), np.int64)
                at[rows] = np.arange(len(rows))
                self.finer[size] = at, self._matrix(rows, size)
            at, vec = self.finer[size]
            self._bounded(ok, a, b, vec, at[a], at[b], np.flatnonzero(ok & (finest == size)))
        return ok

    def _bounded(self, ok, a, b, vec, ra, rb, at) -> None:
        for x in np.array_split(at, len(at) * vec.shape[1] // CELLS + 1):
            bound = np.minimum(vec[ra[x]], vec[rb[x]]).sum(1)
            ok[x] = (self.num + self.den) * bound >= self.num * (self.n[a[x]] + self.n[b[x]])


def rtree_pairs(p: Points, members: np.ndarray, asking: np.ndarray, leaf: int = LEAF):
    """Pairs (asking, member), different, that the bound allows, all of an asking point at once; found level by level in an
    R-tree packed over members."""
    order = members[np.lexsort((p.vec[members, 0], p.n[members] // 4))]
    levels = []
    low, high, top = p.n[order], p.n[order], p.counts(order)
    fan = leaf
    while True:
        cuts = np.arange(0, len(low), fan)
        low, high, top = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(top, cuts, axis=0)
        levels.append((low, high, top, fan))
        if len(low) == 1:
            break
        fan = FAN
    for block in np.array_split(asking, len(asking) * len(members) // PAIRS + 1):  # so many pairs at a time at most
        q, node = block, np.zeros(len(block), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            low, high, top, fan = levels[depth]
            nq = p.n[q]
            ok = (p.num * low[node] <= p.den * nq) & (p.num * nq <= p.den * high[node])
            at = np.flatnonzero(ok)
            for x in np.array_split(at, len(at) // 50_000 + 1):
                bound = np.minimum(p.counts(q[x]), top[node[x]]).sum(1)
                ok[x] = (p.num + p.den) * bound >= p.num * (nq[x] + low[node[x]])
            q, node = q[ok], node[ok]
            below = len(order) if depth == 0 else len(levels[depth - 1][0])
            q = np.repeat(q, fan)
            node = (node[:, None] * fan + np.arange(fan)).ravel()
            q, node = q[node < below], node[node < below]
        member = order[node]
        ok = q != member
        ok[ok] = p.fits(q[ok], member[ok])
        yield q[ok], member[ok]


def _stars(num: int, den: int):
    """(a, b): each member of a tree with the smallest digest of its component in the graph of pairs that the bound allows."""
    leaf = LEAF

    def run(t: pa.Table):
        digests, at, local = np.unique(t["digest"].to_numpy(), return_index=True, return_inverse=True)
        one = t.take(pa.array(at))
        p = Points(one["n"].to_numpy(), one["point"].to_pylist(), num, den)
        key = t["key"].to_numpy()
        order = np.lexsort((local, p.n[local], key))
        key, local = key[order], local[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        lead_at = np.repeat(starts + sizes // 2, sizes)  # a member of middle size

        def fits(a, b):
            u, back = np.unique(np.minimum(a, b).astype(np.int64) << 32 | np.maximum(a, b), return_inverse=True)
            return p.fits(u >> 32, u & 0xFFFFFFFF)[back] if len(u) else np.zeros(0, bool)

        rows = np.arange(len(key))
        attached = fits(local[lead_at], local)
        label = united(rows.copy(), rows[attached], lead_at[attached])
        for s in range(3, leaf + 1):
            for some in np.array_split(starts[sizes == s], int((sizes == s).sum()) * s * s // PAIRS + 1):
                i, j = np.triu_indices(s, 1)
                a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = label[a] != label[b]
                a, b = a[ok], b[ok]
                ok = fits(local[a], local[b])
                label = united(label, a[ok], b[ok])
        for g in np.flatnonzero(sizes > leaf):
            own = slice(starts[g], starts[g] + sizes[g])
            members = local[own]
            ask = members[~attached[own]]
            if not len(ask):
                continue
            by = np.argsort(members)
            inner = np.unique(label[own], return_inverse=True)[1]
            first = np.unique(inner, return_index=True)[1]
            inner = first[inner]
            for a, b in rtree_pairs(p, members, ask, leaf):
                inner = united(inner, by[np.searchsorted(members[by], a)], by[np.searchsorted(members[by], b)])
            label[own] = starts[g] + inner
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, label, digests[local])
        a, b = digests[local], least[label]
        ok = a != b
        edges = np.unique(np.stack([a[ok], b[ok]], 1), axis=0)
        yield from C.batches_of(pa.table({"a": edges[:, 0], "b": edges[:, 1]}))

    return run


def links(sets: list[np.ndarray], roots: np.ndarray, asks: np.ndarray, num: int, den: int, bits: int = FINE_BITS):
    """Links (x, y) between members of different components, enough to join all that qualifying pairs with an asking member
    join. A member is bounded against the others of other components, and what passes is verified, the closest first."""
    if len(sets) < 2 or (roots == roots[0]).all():
        return
    comp = np.unique(roots, return_inverse=True)[1]
    n = np.array([len(s) for s in sets])
    counts = np.zeros((len(sets), 1 << bits), np.uint16)
    for i, s in enumerate(sets):
        counts[i] = np.minimum(np.bincount((C.mix(s) >> C.U64(64 - bits)).astype(np.int64), minlength=1 << bits), 65535)
    order = np.argsort(n, kind="stable")
    sorted_n, done = n[order], np.zeros(len(n), bool)
    for x in np.roll(order, -(len(order) // 2))[asks[np.roll(order, -(len(order) // 2))]].tolist():  # from a member of middle size
        low = np.searchsorted(sorted_n, -(-num * n[x] // den), "left")
        high = np.searchsorted(sorted_n, den * n[x] // num, "right")
        others = order[low:high]
        others = others[(comp[others] != comp[x]) & ~done[others]]
        done[x] = True  # others that ask have met x now
        if not len(others):
            continue
        bound = np.concatenate([np.minimum(counts[o], counts[x]).sum(1, dtype=np.int64) for o in np.array_split(others, len(others) // 4096 + 1)])
        ok = (num + den) * bound >= num * (n[others] + n[x])
        others, bound = others[ok], bound[ok]
        for y in others[np.argsort(-bound, kind="stable")].tolist():
            if comp[y] == comp[x]:
                continue
            at = np.minimum(np.searchsorted(sets[x], sets[y]), n[x] - 1)
            both = int((sets[x][at] == sets[y]).sum())
            if (num + den) * both >= num * int(n[x] + n[y]):
                comp[comp == comp[y]] = comp[x]
                yield x, y


def _verify(k: int, num: int, den: int):
    """Rows (family, shard, digest, root, ask, text), sorted by the first three: links found within each (family, shard)."""
    bits = FINE_BITS

    def run(batches):
        now, sets, digests, roots, asks = None, [], [], [], []

        def solved():
            found = [(digests[x], digests[y]) for x, y in links(sets, np.array(roots), np.array(asks), num, den, bits)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            family, shard, digest, root, ask = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            for i, data, offsets in C.text_blocks(batch.column(5)):
                h, d = C.distinct_shingles(data, offsets, k)
                ends = np.searchsorted(d, np.arange(len(offsets)))
                for r in range(len(offsets) - 1):
                    at = (family[i + r], shard[i + r])
                    if at != now:
                        if len(sets) > 1:
                            yield solved()
                        now, sets, digests, roots, asks = at, [], [], [], []
                    if digests and digests[-1] == digest[i + r]:  # a repeated row
                        asks[-1] |= ask[i + r]
                        continue
                    sets.append(h[ends[r] : ends[r + 1]].copy())
                    digests.append(digest[i + r])
                    roots.append(root[i + r])
                    asks.append(bool(ask[i + r]))
        if len(sets) > 1:
            yield solved()

    return run


def _texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members(..., want_id, text_hash), stored, with the text of each."""
    of = C.likely(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), "text_hash", members)
    # a null id is told apart by the text's hash alone, so that the join has equal keys throughout
    of = of.withColumn("doc_id", F.coalesce("doc_id", F.lit(C.NO_ID)))
    roles = C.sized(members).withColumnRenamed("want_id", "doc_id")
    return of.join(roles, ["doc_id", "text_hash"]).drop("doc_id", "text_hash")


def _solved(members: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links (a, b), stored, among members(family, shard, digest, root, ask, want_id, text_hash)."""
    rows = _texts(members, docs).select("family", "shard", "digest", "root", "ask", "text")
    rows = rows.repartition("family", "shard").sortWithinPartitions("family", "shard", "digest")
    return C.stored(rows.mapInArrow(C.tidy(_verify(k, num, den)), "a long, b long"))


def _rooted(members: DataFrame, links_: DataFrame) -> DataFrame:
    """members with the root of their component by the links."""
    roots = C.components(links_).toDF("digest", "__root")
    return members.drop("root").join(roots, "digest", "left").withColumn("root", F.coalesce("__root", "digest")).drop("__root")


def _heavy(members: DataFrame, first: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links that the shards of heavy families miss. members: of families of several shards; first: links within shards."""
    cols = ["family", "shard", "digest", "root", "ask", "want_id", "text_hash"]
    shards = C.stored(members.select("family", F.col("band").alias("near"), "shard").distinct())

    def visiting(guests: DataFrame) -> DataFrame:
        near = guests.withColumn("home", F.col("shard")).drop("shard").withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        return near.join(shards, ["family", "near"]).where("shard <> home").withColumn("ask", F.lit(True)).select(*cols)

    def residents(rows: DataFrame) -> DataFrame:
        return rows.withColumn("ask", F.lit(False)).select(*cols)

    first = C.stored(first.join(members.select(F.col("digest").alias("a")), "a", "left_semi"))
    ours = C.stored(_rooted(members, first))
    spoke = F.col("digest") == F.col("root")  # a component is within a shard: its smallest member speaks for it
    found = _solved(C.stored(residents(ours).unionByName(visiting(ours.where(spoke)))), docs, k, num, den)
    joined = C.stored(_rooted(ours.withColumn("__spoke", spoke), first.unionByName(found)))
    sizes = joined.groupBy("family", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("family").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    rest = joined.join(main, "family").where("root <> main and not __spoke").drop("main", "__spoke")
    more = _solved(C.stored(residents(joined).unionByName(visiting(rest))), docs, k, num, den)
    return C.stored(found.unionByName(more))


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text): components of the links den * overlap >= num * union."""
    return labelled(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """jaccard_join() with text_hash (of the text, null without) and root, which names a row's component by its texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with C.small_batches(docs.sparkSession):  # texts of a large family may all be long
        return _labelled(docs, k, num, den)


def _labelled(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    hot = _frequent(docs.select("text"), k)
    table = C.stored(points(docs, k, num, den, hot))
    new = table.where("point is not null")
    keys = C.stored(new.select(F.explode("prefix").alias("key"), "digest").repartition("key").sortWithinPartitions("key").mapInArrow(C.tidy(C.by_key(_trees)), "key long, digest long"))
    place = new.groupBy("digest").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    tree = keys.repartition("digest").dropDuplicates(["key", "digest"]).join(place, "digest").select("key", "digest", "n", "point")
    stars = C.stored(tree.repartition("key").sortWithinPartitions("key").mapInArrow(C.tidy(C.by_key(_stars(num, den))), "a long, b long").distinct())
    C.discard(keys)
    family = C.components(stars).toDF("digest", "family")
    text = table.where("digest is not null").groupBy("digest").agg(F.min(F.struct("text_hash", F.coalesce("doc_id", F.lit(C.NO_ID)).alias("want_id"), "n")).alias("x"))
    family = C.stored(text.join(C.sized(C.stored(family)), "digest").select("digest", "family", "x.*"))
    weight = F.sum(F.col("n") + MEMBER)
    heavy = family.groupBy("family").agg((weight > WHOLE).alias("heavy"))
    band = F.when(F.col("heavy"), F.floor(F.log("n") / F.lit(math.log(den / num) * (1 + 1e-9)))).otherwise(F.lit(0))
    family = C.stored(family.join(heavy, "family").withColumn("band", band))
    parts = family.groupBy("family", "band").agg(F.ceil(weight / F.lit(WHOLE)).alias("parts"))
    shard = F.col("band") * F.lit(1 << 32) + F.pmod(F.xxhash64("digest"), F.col("parts"))
    members = family.join(parts, ["family", "band"]).withColumn("shard", F.when(F.col("heavy"), shard).otherwise(F.lit(0).cast("long")))
    members = C.stored(members.select("family", "heavy", "band", "shard", "digest", F.col("digest").alias("root"), F.lit(True).alias("ask"), "want_id", "text_hash"))
    found = _solved(members, docs, k, num, den)
    several = members.where("heavy")
    if not several.isEmpty():
        found = C.stored(found.unionByName(_heavy(several, found, docs, k, num, den)))
    roots = C.stored(C.components(found).toDF("digest", "root"))
    rows = table.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest").join(C.sized(roots), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = C.stored(rows.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "text_hash", "root"))
    C.discard(table, stars, family, members, found, roots)
    return out
