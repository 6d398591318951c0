"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item has a SimHash of its words and a bag of word shingles (weights: counts). A document's windows for an item
are all runs of the item's number of words, cut at the text's ends: a shorter text is a window as a whole, and a run that
begins before the text or ends behind it counts with the words it has. An item is found where the weighted Jaccard
similarity of the two bags of shingles, taken exactly, is at least the threshold; windows of other lengths are not tried.
Two ways lead to a window. SimHash: uncut windows that share a shingle with some item of that length are looked up in a
multi-index: the 64 bits are cut into RADIUS + 1 blocks, fingerprints that differ in at most RADIUS bits agree in one block
at least, so looking up each block finds all fingerprints within the radius. Counts: every window, cut or not, with as many
shared shingles as the threshold needs at least, so nothing is lost beyond the radius.

A benchmark of up to ITEM_BYTES is broadcast, indexed, and documents are not shuffled. A larger one stays distributed: a
pair that qualifies shares one of the item's first n - ceil(t n) + 1 shingles, in the order of how many items have them, so
an equi-join of these with the documents' shingles gives the candidates; each text meets its candidates' texts in one task
and is searched by the same code. Nothing is lost either way.

Null or empty texts match nothing; items without words are left out; an item of fewer words than a shingle is one shingle.
Null and repeated ids are carried as they are; a document's row stays one row. Ties: items are listed by id, an id as often
as it has different texts that are found. An empty benchmark leaves every document clean; empty documents give no rows.
matches() replaces columns of the names it adds and keeps the others; decontaminate() keeps all columns. Memory follows the
length of a text, not the product with an item's length or with the items that share a shingle.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

RADIUS = 12
#: Bytes of benchmark text that are broadcast, and hits of shared shingles that are looked at together.
ITEM_BYTES, HITS = 8 << 20, 4_000_000


def fingerprints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of the windows of so many words at starts."""
    out = [np.zeros(0, C.U64)]
    for part in np.array_split(starts, len(starts) * size // 100_000 + 1):
        if len(part):
            bits = np.unpackbits(words[part[:, None] + np.arange(size)].view(np.uint8).reshape(len(part), size, 8), axis=2, bitorder="little")
            out.append(np.packbits(2 * bits.sum(1, dtype=np.int32) > size, axis=1, bitorder="little").view(C.U64).ravel())
    return np.concatenate(out)


class Items:
    """A block of benchmark items, indexed."""

    def __init__(self, rows: list[tuple[int, str]], k: int, radius: int = RADIUS):
        self.k, self.radius, self.rows = k, radius, rows
        self._parts: list[Items] | None = None
        self.by_length: dict[int, list[int]] = {}
        self.ids, self.bags, prints, keys, lengths, owners = [], [], [], [], [], []
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            offsets = np.array([0, len(data)])
            words, _, _ = C.word_hashes(data, offsets)
            if not len(words):
                continue
            h = np.sort(C.shingles(data, offsets, k)[0])
            self.by_length.setdefault(len(words), []).append(len(self.ids))
            keys.append(np.unique(h))
            lengths.append(np.full(len(keys[-1]), len(words)))
            owners.append(np.full(len(keys[-1]), len(self.ids)))
            self.ids.append(item_id)
            self.bags.append(h)
            prints.append(fingerprints(words, np.array([0]), len(words))[0])
        self.prints = np.array(prints, C.U64)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, C.U64)
        self.lengths = np.concatenate(lengths) if keys else np.zeros(0, np.int64)
        self.owners = np.concatenate(owners) if keys else np.zeros(0, np.int64)
        self.sizes = np.zeros(len(self.ids), np.int64)
        self.sizes[self.owners] = self.lengths
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.lengths, self.owners = self.keys[order], self.lengths[order], self.owners[order]
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(C.U64(a), C.U64((1 << int(b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.index = {}
        for length, items in self.by_length.items():
            x = self.prints[items]
            self.index[length] = [self._sorted((x >> a) & m, np.array(items)) for a, m in self.blocks]

    def parts(self) -> list[Items]:
        """Two indexes of half of the items each."""
        if self._parts is None:
            half = len(self.rows) // 2
            self._parts = [Items(x, self.k, self.radius) for x in (self.rows[:half], self.rows[half:])]
        return self._parts

    @staticmethod
    def _sorted(values, items):
        order = np.argsort(values, kind="stable")
        return values[order], items[order]

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within the radius, among items of this length."""
        out = []
        for (values, items), (a, m) in zip(self.index[length], self.blocks, strict=True):
            x = (prints >> a) & m
            low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            n = high - low
            w = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            out.append(w * len(self.ids) + items[at])
        code = np.unique(np.concatenate(out))
        w, item = code // len(self.ids), code % len(self.ids)
        near = np.bitwise_count(prints[w] ^ self.prints[item]) <= self.radius
        return w[near], item[near]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> Fraction:
    """Of two bags given as arrays."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return Fraction(both, len(a) + len(b) - both)


def countable(hit: np.ndarray, item: np.ndarray, text: np.ndarray, bounds: np.ndarray, items: Items, least: Fraction):
    """(item, first, end) of every window, in words, that has enough shared shingles for the least similarity.

    hit, item: where a shingle of the item begins."""
    num, den, k = least.numerator, least.denominator, items.k
    code = text[hit] * len(items.ids) + item
    order = np.lexsort((hit, code))
    code, hit = code[order], hit[order]
    group, at, n = np.unique(code, return_index=True, return_counts=True)
    wanted = items.sizes[group % len(items.ids)] - k + 1
    for g in np.flatnonzero((n * den >= num * wanted) & (wanted > 0)):
        d, j = divmod(int(group[g]), len(items.ids))
        own, low, high, size = hit[at[g] : at[g] + n[g]], int(bounds[d]), int(bounds[d + 1]), int(items.sizes[j])
        start = np.arange(low - (size - k), high - k + 1)
        first, end = np.maximum(start, low), np.minimum(start + size, high)
        both = np.searchsorted(own, end - k, "right") - np.searchsorted(own, first, "left")
        for w in np.unique(np.stack([first, end], 1)[both * (num + den) >= num * (end - first - k + 1 + wanted[g])], axis=0):
            yield j, int(w[0]), int(w[1])


def find(data: np.ndarray, offsets: np.ndarray, items: Items, least: Fraction) -> dict[int, dict[int, tuple[Fraction, int]]]:
    """{text: {item: (best similarity, first word of such a window)}} of texts laid end to end."""
    found: dict[int, dict[int, tuple[Fraction, int]]] = {}
    if not len(items.ids):
        return found
    k = items.k
    words, text, _ = C.word_hashes(data, offsets)
    if not len(words):
        return found
    weight = C.powers(max(k, 2), C.U64(0xD6E8FEB86659FD93))
    m = len(words) - k + 1
    grams = np.zeros(max(m, 0), C.U64)
    for i in range(k if m > 0 else 0):
        grams += words[i : i + m] * weight[i]
    grams = C.mix(grams) >> C.U64(1)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    hits = []
    if m > 0:
        at = np.minimum(np.searchsorted(items.keys, grams), len(items.keys) - 1)
        hits = np.flatnonzero((items.keys[at] == grams) & (text[:m] == text[k - 1 :]))
    if len(hits) and len(items.rows) > 1:
        n = np.searchsorted(items.keys, grams[hits], "right") - np.searchsorted(items.keys, grams[hits], "left")
        if n.sum() > HITS:
            half = len(items.parts()[0].ids)
            for shift, part in zip((0, half), items.parts(), strict=True):
                for d, got in find(data, offsets, part, least).items():
                    found.setdefault(d, {}).update({j + shift: x for j, x in got.items()})
            return {d: got for d, got in found.items() if got}
    windows: dict[int, list[np.ndarray]] = {}

    def verify(j: int, s: int, bag) -> None:
        d = int(text[s])
        mine, first = found.setdefault(d, {}), s - int(bounds[d])
        if j in mine and mine[j][0] == 1 and mine[j][1] <= first:
            return
        if (x := weighted_jaccard(bag(), items.bags[j])) >= least and (j not in mine or (x, -first) > (mine[j][0], -mine[j][1])):
            mine[int(j)] = (x, first)

    if len(hits):
        low, high = np.searchsorted(items.keys, grams[hits], "left"), np.searchsorted(items.keys, grams[hits], "right")
        n = high - low
        hit = np.repeat(hits, n)
        key = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        length = items.lengths[key]
        for j, first, end in countable(hit, items.owners[key], text, bounds, items, least):
            verify(j, first, lambda a=first, e=end: grams[a : e - k + 1])
        for size in np.unique(length):
            if size < k:
                continue
            h = np.unique(hit[length == size])
            reach = np.zeros(len(words) + 1, np.int64)  # windows that hold a hit: runs of starts up to each
            np.add.at(reach, np.maximum(h - (size - k), 0), 1)
            np.add.at(reach, h + 1, -1)
            starts = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
            starts = starts[starts + size <= len(words)]
            starts = starts[text[starts] == text[starts + size - 1]]
            windows.setdefault(int(size), []).append(starts)
    for size in items.by_length:
        if size < k and len(words) >= size:  # an item shorter than a shingle: every window of its length
            starts = np.arange(len(words) - size + 1)
            windows.setdefault(size, []).append(starts[text[starts] == text[starts + size - 1]])
    for size, parts in windows.items():
        starts = np.concatenate(parts)
        for part in np.array_split(starts, len(starts) // 4096 + 1):
            if not len(part):
                continue
            prints = fingerprints(words, part, size)
            w, item = items.near(prints, size)
            for i, j in zip(w, item, strict=True):
                s = int(part[i])
                verify(int(j), s, (lambda a=s, n=size: grams[a : a + n - k + 1]) if size >= k else (lambda a=s, n=size: short_gram(words[a : a + n], weight)))
    return {d: got for d, got in found.items() if got}


def short_gram(words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The one shingle of a sequence of fewer words than a shingle."""
    return C.mix(np.array([np.add.reduce(words * weight[: len(words)]) + C.U64(len(words))])) >> C.U64(1)


FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())]))
FOUND_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))


def _rows(found: dict, items: Items, n: int) -> list:
    out: list = [[] for _ in range(n)]
    for d, got in found.items():
        out[d] = [{"item_id": items.ids[j], "similarity": float(x), "first_word": w} for j, (x, w) in got.items()]
    return out


def _broadcast(texts: DataFrame, items: DataFrame, k: int, least: Fraction) -> DataFrame:
    """texts(..., __text) and found; the items are at most ITEM_BYTES."""
    rows = [(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()]
    shared, names = texts.sparkSession.sparkContext.broadcast(rows), texts.columns

    def run(batches):
        index = None
        for batch in batches:
            index = index or Items(shared.value, k)
            column, out = batch.column(names.index("__text")), []
            for _, data, offsets in C.text_blocks(column):
                out += _rows(find(data, offsets, index, least), index, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, FOUND_KIND)], [*names, "found"])

    return texts.mapInArrow(C.tidy(run), T.StructType([*texts.schema.fields, T.StructField("found", FOUND)]))


def _grams(k: int, sizes: list[int]):
    """The different shingles of each (id, text): (id, key); of items shorter than a shingle, their lengths' too."""

    def run(batches):
        weight = C.powers(max(k, 2), C.U64(0xD6E8FEB86659FD93))
        for b in batches:
            for i, data, offsets in C.text_blocks(b.column(1)):
                h, d = C.distinct_shingles(data, offsets, k)
                keys, owner = [h], [d]
                if sizes:
                    words, text, _ = C.word_hashes(data, offsets)
                    for size in sizes:
                        m = len(words) - size + 1
                        if m > 0:
                            sums = np.full(m, C.U64(size))
                            for j in range(size):
                                sums += words[j : j + m] * weight[j]
                            inside = text[:m] == text[size - 1 :]
                            keys.append((C.mix(sums) >> C.U64(1))[inside])
                            owner.append(text[:m][inside])
                pairs = np.unique(np.stack([np.concatenate(owner).astype(np.int64), np.concatenate(keys).view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + pairs[:, 0])), pa.array(pairs[:, 1])], ["id", "key"])

    return run


def _item_keys(items: DataFrame, k: int, least: Fraction) -> DataFrame:
    """(item, key, n, rank, size): the shingles of items(item, text), the rarest among items first."""

    def run(batches):
        for b in batches:
            for i, data, offsets in C.text_blocks(b.column(1)):
                h, d = C.shingles(data, offsets, k)
                size = np.bincount(C.word_hashes(data, offsets)[1], minlength=len(offsets) - 1)
                pairs, n = np.unique(np.stack([d.astype(np.int64), h.view(np.int64)], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + pairs[:, 0])), pa.array(pairs[:, 1]), pa.array(n), pa.array(size[pairs[:, 0]])], ["item", "key", "n", "words"])

    keys = C.stored(items.select("item", "text").mapInArrow(C.tidy(run), "item long, key long, n long, words long"))
    rare = keys.groupBy("key").agg(F.count("*").alias("items"))
    order = Window.partitionBy("item").orderBy("items", "key").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("item"))
    ranked = keys.join(rare, "key").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", total)
    # what is left out weighs less than a window must share
    return ranked.where(F.lit(least.denominator) * (F.col("total") - F.col("before")) >= F.lit(least.numerator) * F.col("total")).select("item", "key", "words")


def _joined(texts: DataFrame, items: DataFrame, k: int, least: Fraction) -> DataFrame:
    """texts(..., __text) and found, by an equi-join of shingles."""
    items = C.stored(items.withColumn("item", F.monotonically_increasing_id()))
    keys = C.stored(_item_keys(items, k, least))
    sizes = sorted(r[0] for r in keys.where(F.col("words") < k).select("words").distinct().collect())
    name = F.struct(F.xxhash64("__text").alias("a"), F.hash("__text", F.lit(1)).alias("b"))
    own = texts.where("length(__text) > 0").select(name.alias("id"), "__text")
    asked = own.mapInArrow(C.tidy(_grams(k, sizes)), "id struct<a:long,b:int>, key long")
    pairs = C.stored(C.likely(asked, "key", keys).join(keys, "key").select("id", "item").distinct())
    one = own.join(pairs.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    none = F.lit(None)
    rows = one.select("id", none.cast("long").alias("item_id"), F.col("__text").alias("text")).unionByName(pairs.join(items, "item").select("id", "item_id", "text").withColumn("item", F.lit(True)), allowMissingColumns=True)
    rows = rows.repartition("id").sortWithinPartitions("id", F.col("item").asc_nulls_last(), "item_id", "text").select("id", "item", "item_id", "text")

    def run(batches):
        now, some = None, []
        for b in batches:
            out_id, out = [], []
            for i, (key, item, item_id, text) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if key != now:
                    now, some = key, []
                if item:
                    some.append((item_id, text))
                    continue
                index, raw = Items(some, k), text.encode()
                out_id.append(key)
                out += _rows(find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), index, least), index, 1)
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.struct([("a", pa.int64()), ("b", pa.int32())])), pa.array(out, FOUND_KIND)], ["id", "found"])

    found = rows.mapInArrow(C.tidy(run), T.StructType([T.StructField("id", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType())])), T.StructField("found", FOUND)]))
    found = C.stored(found.where("size(found) > 0").withColumnRenamed("id", "__id"))
    return texts.join(found, name == F.col("__id"), "left").drop("__id").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with item_ids (array of the benchmark items found, ascending), similarity (the highest) and first_word (where
    that window starts); empty and null where there is none."""
    names = [c for c in docs.columns if c not in ("item_ids", "similarity", "first_word")]
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct()
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = (_broadcast if held <= ITEM_BYTES else _joined)(texts, items, k, least)
    best = F.array_max(F.transform("found", lambda x: F.struct(x["similarity"].alias("s"), (-x["first_word"]).alias("w"))))
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in names], F.array_sort(F.transform("found", lambda x: x["item_id"])).alias("item_ids"), best["s"].alias("similarity"), (-best["w"]).alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """docs without the rows in which a benchmark item is found; same columns."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return matches(inner, benchmark, k, least).where(F.size("item_ids") == 0).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
