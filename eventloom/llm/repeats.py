"""Removal of repeated byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Anchors shard the work. Of every LEAST-byte window, the GRAM-byte string with the smallest hash is an anchor; equal windows
have the same anchor at the same place, so repeats meet under their anchor's hash. An occurrence whose whole context (all
windows that can contain the anchor) equals an earlier one's is a repeat altogether: those are settled by hashes of 64 bits
of contexts, first in each task (before any shuffle, so a frequent passage makes one row a task), then under the anchor.
Where different contexts stand under one anchor and share a half of a window (as those that share a window do), one occurrence
of each is taken to the transform: the contexts of a
shuffle partition are laid end to end, and from their Burrows-Wheeler transform backward extension, breadth first, settles
common prefixes by increasing length (a boundary between neighbours, extended by the byte before it, is a boundary one byte
longer). It stops at LEAST: neighbours without a boundary share LEAST bytes. In each such interval all but the first
occurrence are removed.

An anchor under which a bounded sample finds many different contexts (the edge of a passage that many texts have) gives way
to the windows that hold it, each under its own hash, so that its occurrences don't meet in one task; equal windows have
the same anchor, so it gives way in all of them. The sample decides that only, never a result.

Nulls: a null text is empty; a null doc_id comes after all others and stays null. Repeated rows (same id and text): the
first keeps its bytes, the others are repeats of it. Rows of one id with different texts go by a 32-bit hash of the text. Texts
shorter than LEAST bytes are kept. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAST, GRAM = 100, 32
#: Anchors that a task combines at a time, and bytes of contexts in one transform (a group of contexts is not cut).
COMBINE, TRANSFORM_BYTES = 1 << 20, 1 << 18
LAST = (1 << 63) - 1
#: Documents, at most about, in the sample that finds anchors of many contexts, how many (and what share of the sample) are
#: many, and how many such anchors are used at most.
SAMPLE_DOCS, HOT_CONTEXTS, HOT_SHARE, HOT_KEYS = 4000, 8, 500, 1 << 16
#: Bits of a place within a text; above them stand 32 bits of the text's hash, which tell texts of one id apart.
_AT = 31

_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        base = C.U64(0x9E3779B97F4A7C15)
        inverse = C.U64(pow(int(base), -1, 1 << 64))
        _cache["p"], _cache["i"] = C.powers(n, base), C.powers(n, inverse)
    return _cache["p"], _cache["i"]


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of width values."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[:n], x[width - have : width - have + n])


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, gram: int, hot: np.ndarray | None = None):
    """Of texts laid end to end: hash, context hash, halves, text, place in it, context bytes before and after of each anchor.

    halves: 32 bits each of the hashes of the anchor with half of what a window has besides, before and after it; 0 where the
    text ends within. Texts that share a window around the anchor share a half at least. hot: hashes, ascending, of anchors
    that the windows they stand in replace."""
    none = [np.zeros(0, C.U64)] * 3 + [np.zeros(0, np.int64)] * 4
    n, width = len(data), least - gram + 1
    if n < least:
        return none
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, C.U64)
    np.cumsum(C._BYTE[data] * power[:n], out=sums[1:])
    h = C.mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    lengths = np.diff(offsets)
    end = np.repeat(offsets[1:], lengths)
    at = np.arange(n)
    h[at[: len(h)] + gram > end[: len(h)]] = C.U64(LAST * 2 + 1)
    low = _sliding(h, width, np.minimum)
    low[at[: len(low)] + least > end[: len(low)]] = 0
    padded = np.zeros(len(h) + width - 1, C.U64)
    padded[width - 1 : width - 1 + len(low)] = low
    chosen = np.flatnonzero((_sliding(padded, width, np.maximum) == h) & (h != 0))
    if not len(chosen):
        return none
    text = np.searchsorted(offsets, chosen, "right") - 1
    before = np.minimum(width - 1, chosen - offsets[text])
    after = np.minimum(least, offsets[text + 1] - chosen)
    a, b = chosen - before, chosen + after
    context = C.mix((sums[b] - sums[a]) * inverse[a] + (before * 4096 + after).astype(C.U64) * C.U64(0xD6E8FEB86659FD93))
    half = (least - gram + 1) // 2
    left, right = np.maximum(chosen - half, 0), np.minimum(chosen + gram + half, n)
    left = np.where(before >= half, C.mix((sums[chosen + gram] - sums[left]) * inverse[left]) >> C.U64(32), C.U64(0))
    right = np.where(after >= gram + half, C.mix((sums[right] - sums[chosen]) * inverse[chosen]) >> C.U64(32), C.U64(0))
    out = [h[chosen], context, left << C.U64(32) | right, text, chosen - offsets[text], before, after]
    if hot is not None and len(hot):
        many = hot[np.minimum(np.searchsorted(hot, out[0]), len(hot) - 1)] == out[0]
        if many.any():
            low, high = np.maximum(offsets[text], chosen - width + 1)[many], np.minimum(chosen, offsets[text + 1] - least)[many]
            n = high - low + 1
            starts = np.unique(np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
            window = C.mix((sums[starts + least] - sums[starts]) * inverse[starts] + C.U64(0xD6E8FEB86659FD93))
            owner = np.searchsorted(offsets, starts, "right") - 1
            more = [window, window, np.zeros(len(starts), C.U64), owner, starts - offsets[owner], np.zeros(len(starts), np.int64), np.full(len(starts), least)]
            out = [np.concatenate([x[~many], y]) for x, y in zip(out, more, strict=True)]
    return out


def _hot(docs: DataFrame, least: int, gram: int) -> np.ndarray:
    """Anchors of many contexts in a bounded sample, ascending."""
    total = docs.count()
    sample = docs.select("text").sample(False, min(1.0, SAMPLE_DOCS / max(total, 1)), 11)

    def run(batches):
        for b in batches:
            for _, data, offsets in C.text_blocks(b.column(0)):
                h, context, *_ = anchors(data, offsets, least, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(context.view(np.int64))], ["h", "context"])

    many = max(HOT_CONTEXTS, min(total, SAMPLE_DOCS) // HOT_SHARE)
    pairs = sample.mapInArrow(C.tidy(run), "h long, context long").distinct().groupBy("h").count().where(F.col("count") >= many)
    rows = pairs.orderBy(F.desc("count"), "h").limit(HOT_KEYS).select("h").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(C.U64))


def _firsts(h, context, doc, place):
    """Order by (h, context, doc, place), and where in it a new (h, context) begins."""
    order = np.lexsort((place, doc, context, h))
    h, context = h[order], context[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
    return order, new


def _spans(doc: np.ndarray, place: np.ndarray, length: np.ndarray):
    """Sorted and merged where they touch or overlap."""
    order = np.lexsort((place, doc))
    doc, place, length = doc[order], place[order], length[order]
    if not len(doc):
        return doc, place, length
    tie, at = place >> _AT, place & ((1 << _AT) - 1)
    group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))])
    base = group << (_AT + 1)  # so that running maxima begin anew with each text
    reach = np.maximum.accumulate(base + at + length)
    new = np.ones(len(doc), bool)
    new[1:] = (base + at)[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(doc)) - 1
    return doc[starts], place[starts], (reach[last] - base[starts] - at[starts])


ROW = "kind int, h long, context long, halves long, doc long, place long, clip int"


def _rows(kind, h, context, halves, doc, place, clip) -> pa.Table:
    cols = [np.full(len(doc), kind, np.int32), *(x.astype(C.U64).view(np.int64) for x in (h, context, halves)), doc, place, clip.astype(np.int32)]
    return pa.table(dict(zip(["kind", "h", "context", "halves", "doc", "place", "clip"], cols, strict=True)))


def _span_rows(doc, place, length) -> pa.Table:
    doc, place, length = _spans(doc, place, length)
    return _rows(1, C.mix(doc.view(C.U64) ^ (place.view(C.U64) << C.U64(7))), np.zeros(len(doc)), np.zeros(len(doc)), doc, place, length)


def _collect(least: int, gram: int, hot: np.ndarray):
    """kind 0: anchors, once for each context in a task's share; kind 1: spans that repeat within the share."""

    def flush(parts):
        h, context, halves, doc, place, clip = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new = _firsts(h, context, doc, place)
        h, context, halves, doc, place, clip = (x[order] for x in (h, context, halves, doc, place, clip))
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else new
        again = ~new & ((doc != doc[first]) | (place != place[first]))
        yield from C.batches_of(_rows(0, h[new], context[new], halves[new], doc[new], place[new], clip[new]))
        yield from C.batches_of(_span_rows(doc[again], (place - clip // 4096)[again], (clip // 4096 + clip % 4096)[again]))

    def run(batches):
        parts, count = [], 0
        for b in batches:
            doc, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, data, offsets in C.text_blocks(b.column(2)):
                h, context, halves, text, place, before, after = anchors(data, offsets, least, gram, hot)
                parts.append((h, context, halves, doc[i + text], (tie[i + text] << _AT) + place, before * 4096 + after))
                count += len(h)
                if count >= COMBINE:
                    yield from flush(parts)
                    parts, count = [], 0
        if parts:
            yield from flush(parts)

    return run


def _settle(batches):
    """Under each anchor: spans of occurrences with a context seen earlier (kind 1), and, where contexts differ, one
    occurrence of each (kind 2)."""
    t = C.whole(batches)
    if t is None:
        return
    kind = t["kind"].to_numpy()
    yield from C.batches_of(t.filter(pa.array(kind == 1)))
    t = t.filter(pa.array(kind == 0))
    h, context, halves, doc, place, clip = (t[c].to_numpy() for c in ("h", "context", "halves", "doc", "place", "clip"))
    if not len(h):
        return
    order, new = _firsts(h.view(C.U64), context.view(C.U64), doc, place)
    h, context, halves, doc, place, clip = (x[order] for x in (h, context, halves, doc, place, clip))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = ~new & ((doc != doc[first]) | (place != place[first]))
    yield from C.batches_of(_span_rows(doc[again], (place - clip // 4096)[again], (clip // 4096 + clip % 4096)[again].astype(np.int64)))
    h, context, halves, doc, place, clip = (x[new] for x in (h.view(C.U64), context.view(C.U64), halves.view(C.U64), doc, place, clip))
    open_ = np.zeros(len(h), bool)
    for half in (halves >> C.U64(32), halves & C.U64(0xFFFFFFFF)):  # contexts that share a half with another
        by = np.lexsort((half, h))
        same = (h[by][1:] == h[by][:-1]) & (half[by][1:] == half[by][:-1]) & (half[by][1:] != 0)
        open_[by[1:][same]] = True
        open_[by[:-1][same]] = True
    yield from C.batches_of(_rows(2, *(x[open_] for x in (h, context, halves, doc, place, clip))))


def suffix_order(codes: np.ndarray, separators: int) -> np.ndarray:
    """Suffixes of codes in order. Codes below separators occur once each, ascending; others are bytes beyond them.

    Seven symbols are sorted at once (a separator ends the comparison: those ties go by place); then lengths double, and only
    suffixes still tied are sorted again."""
    n, first = len(codes), 7
    symbol = np.where(codes < separators, 0, codes - separators + 1)
    key, alive = symbol.copy(), symbol > 0
    for i in range(1, first):
        ahead = np.zeros(n, np.int64)
        ahead[: n - i] = symbol[i:]
        key = key << 9 | np.where(alive, ahead, 0)
        alive &= ahead > 0
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | ~alive[order][1:]
    rank = np.empty(n, np.int64)
    k = first
    slots, starts = np.arange(n), new
    while True:
        # a rank is the slot where its group starts
        head = np.maximum.accumulate(np.where(starts, slots, -1))
        rank[order[slots]] = head
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        slots, head = slots[tied], head[tied]
        if not len(slots) or k >= n:
            return order
        at = order[slots]
        behind = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = head * (n + 1) + behind
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        key = key[by]
        starts = np.ones(len(key), bool)
        starts[1:] = key[1:] != key[:-1]
        k *= 2


def shared_prefixes(codes: np.ndarray, separators: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and whether each shares fewer than least codes with the one before it.

    Breadth-first backward extension: two neighbours of one first symbol are lcp + 1 apart from where the suffixes behind that
    symbol are lcp apart. Level by level, a boundary anywhere between those makes one here; levels end at least."""
    order = suffix_order(codes, separators)
    n = len(order)
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n)
    place[n] = -1
    behind = place[np.minimum(order + 1, n)]
    symbol = codes[order]
    edge = np.ones(n, np.int64)
    edge[1:] = symbol[1:] != symbol[:-1]
    open_ = np.flatnonzero(edge == 0)
    for _ in range(1, least):
        if not len(open_):
            break
        sums = np.cumsum(edge)
        split = sums[behind[open_]] != sums[behind[open_ - 1]]
        if not split.any():
            break
        edge[open_[split]] = 1
        open_ = open_[~split]
    return order, edge.astype(bool)


def _transform(least: int):
    """kind 2 rows with their contexts' bytes, by anchor: the spans that repeat an earlier occurrence."""
    together = TRANSFORM_BYTES

    def one(t: pa.Table) -> pa.Table:
        raw = t["bytes"].to_pylist()
        lengths = np.array([len(x) for x in raw])
        ends = np.cumsum(lengths + 1) - 1
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(np.int64) + len(raw)
        data[ends] = np.arange(len(raw))  # a separator of its own for each
        doc, place, clip = t["doc"].to_numpy(), t["place"].to_numpy(), t["clip"].to_numpy()
        order, edge = shared_prefixes(data, len(raw), least)
        owner = np.repeat(np.arange(len(raw)), lengths + 1)
        inside = np.arange(len(data)) - np.repeat(ends - lengths, lengths + 1)
        group = np.cumsum(edge) - 1
        many = np.bincount(group)[group] > 1
        at, group = order[many], group[many]
        w_doc, w_place = doc[owner[at]], (place - clip // 4096)[owner[at]] + inside[at]
        by = np.lexsort((w_place, w_doc, group))
        group, w_doc, w_place = group[by], w_doc[by], w_place[by]
        if not len(group):
            return _span_rows(w_doc, w_place, w_place)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.repeat(starts, np.diff(np.append(starts, len(group))))
        again = (w_doc != w_doc[first]) | (w_place != w_place[first])
        return _span_rows(w_doc[again], w_place[again], np.full(int(again.sum()), least))

    def run(batches):
        t = C.whole(batches)
        if t is None:
            return
        h = t["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        t, h = t.take(pa.array(order)), h[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.concatenate([[0], np.cumsum(t["clip"].to_numpy() % 4096 + t["clip"].to_numpy() // 4096)])
        a = 0
        for s, e in zip(starts, np.append(starts[1:], len(h)), strict=True):
            if sizes[e] - sizes[a] >= together or e == len(h):
                yield from C.batches_of(one(t.slice(a, e - a)))
                a = e

    return run


def _contexts(batches):
    """The bytes around the anchors listed with each text."""
    for b in batches:
        out = []
        for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = text.encode()
            for w in wanted:
                at = w["place"] & ((1 << _AT) - 1)
                out.append((w["h"], doc, w["place"], w["clip"], raw[at - w["clip"] // 4096 : at + w["clip"] % 4096]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["h", "doc", "place", "clip", "bytes"])


def _finish(least: int):
    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, spans, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                if copy > 1 and len(raw) >= least:
                    out.append((doc_id, len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()))
                    continue
                kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
                reach = -1
                for x in sorted((s["start"], s["start"] + s["length"]) for s in spans or ()):
                    if x[0] > reach:
                        kept.update(raw[max(at, 0) : x[0]])
                        removed += x[1] - x[0]
                        runs += 1
                        reach = x[1]
                    elif x[1] > reach:
                        removed += x[1] - reach
                        reach = x[1]
                    at = reach
                kept.update(raw[at:])
                out.append((doc_id, len(raw), removed, runs, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)] if out else [pa.array([], k) for k in (pa.int64(),) * 4 + (pa.string(),)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "tie": F.pmod(F.xxhash64("text"), F.lit(1 << 32))})
    found = docs.select("doc", "tie", "text").mapInArrow(C.tidy(_collect(least, gram, _hot(docs, least, gram))), ROW)
    settled = C.stored(found.repartition("h").mapInArrow(C.tidy(_settle), ROW))
    listed = settled.where("kind = 2").groupBy("doc", F.shiftright("place", _AT).alias("tie")).agg(F.collect_list(F.struct("h", "place", "clip")).alias("wanted"))
    open_ = docs.select("doc", "tie", "text").join(listed, ["doc", "tie"]).select("doc", "text", "wanted")
    open_ = open_.mapInArrow(C.tidy(_contexts), "h long, doc long, place long, clip int, bytes binary")
    more = C.stored(open_.repartition("h").mapInArrow(C.tidy(_transform(least)), ROW))
    spans = settled.where("kind = 1").unionByName(more)
    place = F.col("place").bitwiseAND(F.lit((1 << _AT) - 1))
    spans = spans.groupBy("doc", F.shiftright("place", _AT).alias("tie")).agg(F.collect_list(F.struct(place.alias("start"), F.col("clip").alias("length"))).alias("spans"))
    rows = docs.join(spans, ["doc", "tie"], "left")
    copy = F.row_number().over(Window.partitionBy("doc", "tie").orderBy("text"))
    return rows.withColumn("copy", copy).select("doc_id", "text", "spans", "copy").mapInArrow(C.tidy(_finish(least)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
