"""SimHash near-dedup by tiled exact comparison.

A text's fingerprint has a bit where over half of its word shingles (repeats included) have it in their XXH64. Equal
fingerprints are one member from the start. Members are dealt into tiles of one population count and about TILE members;
two tiles are compared, all members of the one with all of the other by exclusive-or and bit counts, unless their
population counts differ by more than the radius, as then no two members can be near. What a pair of tiles gives is its
links' components as stars: rows in proportion to its members, not to its links, and nothing is compared by sample or lost.
Tiles are bounded and meet by shuffle; the number of tile pairs grows with the square of the different fingerprints, as
exact comparison does.

Nulls, empty texts and texts without words: fingerprint zero, linked like any other. Null ids: a row each, never the
smallest id. Repeated rows: kept, each a row. An empty table gives no rows. Other columns are ignored. A long text is read
in pieces of CHUNK bytes, its last words carried over.
"""

from __future__ import annotations

import contextlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .jaccard_join import united

#: Members of a tile, rows of it that are compared at a time, and bytes of a text whose shingles are hashed at a time.
TILE, ROWS, CHUNK = 16384, 64, 1 << 20
SEED = 42
#: Rows with tiles that go to a Python worker at a time.
PAIRS_AT_ONCE = 32
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, k: int):
    """XXH64 of the k-word shingles of a text, in arrays: lower-cased words joined by spaces, all words where there are fewer."""
    at, carried, some = 0, [], False
    while at < len(text):
        cut = SPACE.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = cut.start() if cut else len(text)
        words = carried + text[at:end].lower().split()  # bytes: A-Z and the six kinds of white space only
        at = end
        if len(words) < k:
            carried = words
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashed = xxhash.xxh64_intdigest
        yield np.array([hashed(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], C.U64)
        some, carried = True, words[len(words) - k + 1 :]
    if carried and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], C.U64)


def fingerprint(text: bytes, k: int) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        for part in np.array_split(h, len(h) // 8192 + 1):
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for each row of docs(doc_id, text)."""

    def run(batches):
        for b in batches:
            for i, data, offsets in C.text_blocks(b.column(1)):
                raw, cuts = data.tobytes(), offsets.tolist()
                found = np.array([fingerprint(raw[x:y], k) for x, y in zip(cuts, cuts[1:])], C.U64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(found)), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(C.tidy(run), "doc_id long, fp long")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, rows: int = ROWS):
    """Positions (i, j) with a[i] and b[j] within the radius, for some rows of a at a time."""
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius)
        yield i + at, j


def tile_stars(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """(member, companion) rows that join what the links between two tiles (the same array: within one) join."""
    nodes = a if a is b else np.concatenate([a, b])
    shift = 0 if a is b else len(a)
    label = np.arange(len(nodes))
    for i, j in near_pairs(a, b, radius):
        open_ = label[i] != label[j + shift]
        if open_.any():
            label = united(label, i[open_], j[open_] + shift)
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return np.column_stack([nodes[other], nodes[label[other]]])


def tiles(members: DataFrame, size: int = TILE) -> DataFrame:
    """ones, part, fps: the members (a stored table of different fp) by population count, in parts of about so many."""
    ones = F.bit_count("fp").cast("int")
    parts = members.groupBy(ones.alias("ones")).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("parts"))  # 65 rows at most
    dealt = members.select("fp", ones.alias("ones")).join(F.broadcast(parts), "ones")
    return dealt.groupBy("ones", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("fp").alias("fps"))


@contextlib.contextmanager
def _batches_of(spark, rows: int):
    """Wide rows go to Python workers so many at a time. What is run within is run at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def links(members: DataFrame, radius: int, size: int = TILE) -> DataFrame:
    """(a, b), stored: rows that join what all links between different members join."""
    spark = members.sparkSession
    held = C.stored(tiles(members, size))
    ids = held.select("ones", "part")
    other = ids.select(F.col("ones").alias("ones_b"), F.col("part").alias("part_b"))
    # tile numbers only: tiles of each population count with those of the counts within the radius
    pairs = ids.withColumn("ones_b", F.explode(F.sequence("ones", F.col("ones") + radius))).join(other, "ones_b").where("ones < ones_b or part <= part_b")
    pairs = C.stored(pairs)
    first = pairs.join(held, ["ones", "part"])
    both = first.join(held.select(F.col("ones").alias("ones_b"), F.col("part").alias("part_b"), F.col("fps").alias("fps_b")), ["ones_b", "part_b"])
    both = both.select((F.struct("ones", "part") == F.struct("ones_b", "part_b")).alias("same"), "fps", "fps_b")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                same, a, b = (batch.column(c)[row] for c in range(3))
                a, b = (x.values.to_numpy().view(C.U64) for x in (a, b))
                found = tile_stars(a, a if same.as_py() else b, radius).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in (0, 1)], ["a", "b"])

    with _batches_of(spark, PAIRS_AT_ONCE):
        return C.stored(both.mapInArrow(C.tidy(run), "a long, b long"))


def near_copies(docs: DataFrame, radius: int = 4, k: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs(doc_id, text): components of the links of fingerprints that
    differ in at most radius bits."""
    rows = C.stored(fingerprints(docs, k))
    members = C.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = links(members, radius)
    roots = C.components(found).toDF("fp", "root")
    joined = C.stored(members.join(C.sized(C.stored(roots)), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    # rows alone in their component need no join
    shared = C.stored(joined.join(least.where("size > 1"), "root").select("fp", "component_id"))
    out = rows.join(C.sized(shared), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
