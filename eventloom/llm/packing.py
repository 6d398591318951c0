"""Packing documents into windows of token ids by non-negative least squares.

A document is cut into full windows and a rest. The histogram of rest lengths is fitted by shallow combinations (two or
three lengths that fill a window exactly): non-negative least squares gives how often each is to be used, rounding down
keeps it within the histogram, and the rests left over are laid end to end, cut where a window is full. Where a rest
goes follows from its length and its rank among the rests of that length alone, so ranks (a count for each task and
length, summed up over tasks) are all that is exchanged besides the rows themselves.

Nulls: a null text is empty and still has the end id; a null doc_id is carried. Repeated rows are packed each. Ties
between rests of a length go by input task and position. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW, END_ID = 2048, 1
#: Repeats of coordinate descent, and the step of the coarse lengths in combinations of three.
SWEEPS, STEP = 40, 64

_encoders: dict = {}


def encoder(path: str):
    """texts -> id lists by the vocabulary at path (a tokenizers file). Where the same vocabulary lies beside it as ranks,
    the ranks are used: the same ids (tested), several times faster; texts with a special token's string are not."""
    import os

    from tokenizers import Tokenizer

    if path not in _encoders:
        whole = Tokenizer.from_file(path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            if fast is None or any(s in text for s in special):
                return whole.encode(text, add_special_tokens=False).ids
            return fast(text)

        _encoders[path] = encode
    return _encoders[path]


def combinations(window: int) -> list[tuple[int, ...]]:
    """Sorted lengths that fill a window: all pairs, and triples with two lengths on a grid."""
    pairs = [(a, window - a) for a in range(1, window // 2 + 1)]
    step = max(1, min(STEP, window // 8))
    triples = [(a, b, window - a - b) for a in range(step, window // 3 + 1, step) for b in range(a, (window - a) // 2 + 1, step)]
    return pairs + triples


def solve(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used, within the histogram (index: length).

    Minimises the squared distance of the summed combinations from the histogram over counts of at least 0 by coordinate
    descent, rounds down, and then fits what is left greedily."""
    combos = combinations(window)
    left = histogram.astype(np.float64).copy()
    counts = np.zeros(len(combos))
    parts = [np.unique(c, return_counts=True) for c in combos]
    norms = [float((m * m).sum()) for _, m in parts]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (at, m) in enumerate(parts):
            new = max(0.0, counts[j] + float(left[at] @ m) / norms[j])
            if (step := new - counts[j]) != 0:
                left[at] -= step * m
                counts[j] = new
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    free = histogram.astype(np.int64).copy()
    out = np.zeros(len(combos), np.int64)
    for least in (np.floor(counts), np.full(len(combos), np.inf)):
        for j, (at, m) in enumerate(parts):
            x = int(min(least[j], (free[at] // m).min()))
            if x > 0:
                free[at] -= x * m
                out[j] += x
    return [(c, int(x)) for c, x in zip(combos, out, strict=True) if x]


class Layout:
    """Where the k-th rest of a length goes: tables of a size bounded by the number of combinations."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        used = np.zeros(window, np.int64)
        rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        base = 0
        for combo, x in solve(histogram, window):
            offset = 0
            for length in sorted(set(combo)):
                m = combo.count(length)
                rows.setdefault(length, []).append((int(used[length]), m, base, offset, x))
                used[length] += m * x
                offset += m * length
            base += x
        self.rows = {k: (np.array([r[0] for r in v]), v) for k, v in rows.items()}
        self.used, self.base = used, base
        rest = (histogram - used) * np.arange(window)
        self.before = np.concatenate([[0], np.cumsum(rest)[:-1]])
        #: Windows used by rests, the last perhaps not full.
        self.windows = base + -(-int(rest.sum()) // window)

    def pieces(self, length: int, k: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of the k-th rest of a length."""
        if k < self.used[length]:
            firsts, v = self.rows[length]
            first, m, base, offset, _ = v[int(np.searchsorted(firsts, k, "right")) - 1]
            return [(0, length, base + (k - first) // m, offset + (k - first) % m * length)]
        at = int(self.before[length]) + (k - int(self.used[length])) * length
        out, done = [], 0
        while done < length:
            take = min(length - done, self.window - at % self.window)
            out.append((done, take, self.base + at // self.window, at % self.window))
            done, at = done + take, at + take
        return out


def encoded(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Each row with its rest's ids, the checksums of its full windows, and its rank in its task among rests of its length."""

    def run(batches):
        encode = encoder(path)
        task, ranks, chunks = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                    full, rest = divmod(len(ids), window)
                    sums = [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(full)]
                    tail = ids[full * window :]
                    out.append((doc_id, task, len(ids), rest, int(ranks[rest]), chunks, sums, tail.astype("<u2").tobytes() if ids.max() < 65536 else tail.tobytes()))
                    ranks[rest] += 1
                    chunks += full
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(C.tidy(run), "doc_id long, task long, doc_tokens long, rest int, rank long, chunk long, sums array<long>, tail binary")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("task", pa.int64()), ("doc_tokens", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("chunk", pa.int64()), ("sums", pa.list_(pa.int64())), ("tail", pa.binary())])


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of each row of docs(doc_id, text); see the module."""
    table = C.stored(encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path, window))
    full = F.size("sums").cast("long")
    counts = C.stored(table.groupBy("task", "rest").agg(F.count("*").alias("n"), F.sum(full).alias("full")))
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    histogram[0] = 0
    layout = Layout(histogram, window)
    earlier = counts.withColumn("skip", F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("task", "rest", "skip")
    joined = table.join(earlier, ["task", "rest"])
    chunk_base = layout.windows

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                cols = {k: v for k, v in batch.slice(at, 2048).to_pydict().items()}
                out = []
                for i, doc_id in enumerate(cols["doc_id"]):
                    total, rest, sums = cols["doc_tokens"][i], cols["rest"][i], cols["sums"][i]
                    for c, s in enumerate(sums):
                        # full windows of a task have numbers of their own: nothing is exchanged for them
                        out.append((doc_id, c * window, window, s, total, chunk_base + (cols["task"][i] << 40) + cols["chunk"][i] + c, 0))
                    if rest:
                        raw = cols["tail"][i]
                        ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * rest else "<u4").astype("<u4")
                        for a, n, seq, offset in layout.pieces(rest, cols["rank"][i] + cols["skip"][i]):
                            out.append((doc_id, len(sums) * window + a, n, zlib.crc32(ids[a : a + n].tobytes()), total, seq, offset))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 7)], names)

    return joined.select("doc_id", "task", "doc_tokens", "rest", "rank", "chunk", "sums", "tail", "skip").mapInArrow(C.tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
