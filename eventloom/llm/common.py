"""Helpers shared by the operators: shared-folder tables, vectorised word shingles, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text is worked on in blocks of about this many bytes, so memory doesn't follow the batch size.
BLOCK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session gets one of its own (tests); a cluster
    can't, as its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: lineage ends, no executor is needed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scratch is not None:
        _scratch.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote; nothing may read them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Tables written within the scratch() that is open, and those of the last one.
_scratch: list[DataFrame] | None = None
_last: list[DataFrame] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that were written within the scratch() before this one. For steps whose results are written
    before the next step begins; tables written outside of a scratch() stay."""
    global _scratch
    discard(*_last)
    _last.clear()
    _scratch = []
    try:
        yield
    finally:
        _last.extend(_scratch)
        _scratch = None


def keep_last() -> None:
    """The tables of the last scratch() stay."""
    _last.clear()


#: Bytes of a table (as rows of 8 bytes a number and the length of what is longer) that a join may broadcast.
BROADCAST_BYTES = 32 << 20
#: Stands for a null id where ids are compared by equality.
NO_ID = -(1 << 63)


def bytes_of(table: DataFrame) -> int:
    """Counted, not estimated; for tables that were written."""
    long = [F.length(f.name) if f.dataType.typeName() in ("string", "binary") else F.lit(0) for f in table.schema.fields]
    width = F.lit(8 * (1 + len(table.columns)))
    for x in long:
        width = width + F.coalesce(x, F.lit(0))
    return table.agg(F.sum(width.cast("long"))).first()[0] or 0


def sized(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast where it has at most BROADCAST_BYTES; joins shuffle beyond."""
    return F.broadcast(table) if bytes_of(table) <= BROADCAST_BYTES else table


def having(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Semi-join on the columns of a stored table of keys: broadcast up to BROADCAST_BYTES, by shuffle beyond."""
    return df.join(sized(keys), keys.columns, "left_semi")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_WORD_BYTE = np.where(_SPACE, U64(0), _BYTE[_LOWER])
_BASE = U64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string column at rows into blocks: first row, bytes, offsets (from 0). Null: empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1].copy()
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if column.null_count and (np.diff(offsets)[~np.asarray(column.is_valid())] != 0).any():
        column = column.fill_null("")
        yield from text_blocks(column)
        return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lowered, of texts laid end to end: hash, text number and first byte of each."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = _WORD_BYTE[data]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = value[starts[0] :] * powers(int(place.max()) + 1)[place]
    hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all k-word shingles of texts laid end to end, and their text's number (ascending).

    A text of fewer words gives its whole sequence as one; a text without words gives none. Not yet distinct."""
    words, text, _ = word_hashes(data, offsets)
    if not len(words):
        return words, text
    weight = powers(max(k, 2), U64(0xD6E8FEB86659FD93))
    count = np.bincount(text, minlength=len(offsets) - 1)
    m = len(words) - k + 1
    out, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    if m > 0:
        out = np.zeros(m, U64)
        for i in range(k):
            out += words[i : i + m] * weight[i]
        whole = text[:m] == text[k - 1 :]
        out, owner = out[whole], text[:m][whole]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        at = np.searchsorted(text, few)
        extra = np.array([np.add.reduce(words[a : a + count[d]] * weight[: count[d]]) + U64(count[d]) for a, d in zip(at, few, strict=True)], dtype=U64)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return mix(out) >> U64(1), owner


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() without repeats, ascending within each text."""
    h, d = shingles(data, offsets, k)
    if not len(h):
        return h, d
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f, giving memory that its arrays took back to the system after each task: workers are used again."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def modest(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python workers in batches of so many rows, unless the session already says how many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Rows go to Python workers in batches of so many bytes at most; for jobs that run within."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task; for shuffle partitions of narrow rows only."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def batches_of(table: pa.Table, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=rows)


#: Rows and bytes of a block that by_key() makes, at most about.
KEY_ROWS, KEY_BYTES = 200_000, 6 << 20


def by_key(f: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int | None = None):
    """f over a task's rows, which are sorted by their first column (long, never null), in blocks of whole groups of it: memory
    follows KEY_ROWS, KEY_BYTES and the largest group, not the partition."""
    most = rows or KEY_ROWS

    def run(batches):
        held, n, size, wait = [], 0, 0, 1
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
            if n < wait * most and size < wait * KEY_BYTES:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            rest = t.take(pa.array(np.arange(cut, n)))
            if cut:
                yield from f(t.slice(0, cut))
            held, n, size = rest.to_batches(), n - cut, rest.nbytes
            del t, key, rest
            wait = 2 * max(n / most, size / KEY_BYTES) if n >= most or size >= KEY_BYTES else 1
        if held:
            yield from f(pa.Table.from_batches(held).combine_chunks())

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): root is the smallest node reachable. Alternating large and small stars;
    every round ends in a written table, so a lost executor costs a round at most."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_m.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, stored(small)
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


FILTER_WORDS = 1 << 17


def _marked(df: DataFrame, key: str, wanted: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """df with a bitmap of the hashed keys of wanted, and the test of a row's own bit."""
    bit = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(FILTER_WORDS * 64))
    word, mask = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast({key}__bit as int))")
    bits = wanted.select(key).withColumn("__word", word).withColumn(f"{key}__bit", F.pmod(bit, F.lit(64)))
    bits = bits.groupBy("__word").agg(F.bit_or(mask).alias("__bits"))
    rows = df.withColumn("__word", word).withColumn(f"{key}__bit", F.pmod(bit, F.lit(64)))
    return rows.join(F.broadcast(bits), "__word", how), F.coalesce(F.col("__bits").bitwiseAND(mask) != 0, F.lit(False))


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose hashed key (a long column) is among those of wanted(key), and a few others: a bitmap of at most
    FILTER_WORDS rows is broadcast, so that a shuffle join behind it moves little. Never loses a row."""
    rows, hit = _marked(df, key, wanted, "inner")
    return rows.where(hit).drop("__word", "__bits", f"{key}__bit")


def unlikely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df that likely() leaves out: none of them has a key of wanted."""
    rows, hit = _marked(df, key, wanted, "left")
    return rows.where(~hit).drop("__word", "__bits", f"{key}__bit")
