"""Cross-tokenizer alignment by merging token ends.

Each text is encoded by two vocabularies, A (byte-level pieces) and B (pieces with a space mark). Cumulative byte ends of
both are merged with two pointers: where both end, a group of tokens ends; where two tokens overlap, an occurrence link.
Spark counts the pairs of ids over the corpus, takes the highest count of each B id and joins both back to the links.

A token of either vocabulary never holds a space behind another character, so texts are cut before such spaces and the cuts
(segments) are encoded on their own: the same ids (tested), and what repeats in a block of about BLOCK_CHARS is encoded and
merged once. The merge runs over a block's segments end to end, both pointers moved by sorted search. A block is a dictionary
(its different pairs with their counts, its segments as links into the pairs) and its rows as segment numbers. Only a block's different pairs are counted and asked for, so a frequent pair costs
a row a block; answers and rows meet by block, whose size is bounded (but for a single row that is longer).

Nulls, empty texts and texts that B's pieces don't spell (those with the space mark itself): no tokens, zeros and ''. Null
ids: a row each. Repeated rows: a row each, and each counts. Ties for the highest count: all are highest. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_CHARS = 12 << 20
#: Segments that are encoded in one call.
TOGETHER = 4096
CUT = re.compile(r"(?<=\S)(?= )")
#: White space before a space: the text's segments aren't just what stands between spaces.
ODD = re.compile(r"\s ")
LOW = (1 << 32) - 1

_pairs: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both vocabularies: ids of segments, bytes of ids, and ids as text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        a, alphabet = Tokenizer.from_file(path_a), byte_alphabet()
        a.encode_special_tokens = True
        special = {t.content for t in a.get_added_tokens_decoder().values()}
        spelt = {i: x.encode() if x in special else bytes(alphabet[c] for c in x) for x, i in a.get_vocab().items()}
        self.bytes_a = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.a, ranks = lambda text: a.encode(text, add_special_tokens=False).ids, path_a.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):  # the same ids, faster
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        space = [model.piece_to_id("▁")]
        self.b = lambda text: model.encode(text[1:], num_threads=1) if len(text) > 1 else space
        self.cuts = not any(re.search("[^▁]▁", x) for x in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.said = [f"{i}{c}".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in ",|;"]
        self.said_size = np.array([len(x) for x in self.said])

    def segments(self, text: str) -> list[str]:
        """The segments of space + text, each without its first space."""
        text = " " + text
        if not self.cuts:
            return [text[1:]]
        if ODD.search(text):
            return [s[1:] for s in CUT.split(text)]
        return text[1:].split(" ")

    def spelled(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B of a text that begins with a space, unless they don't spell it."""
        a, b, raw = self.a(text), self.b(text), text.encode()
        if b"".join([self.bytes_a[x] for x in a]) != raw or b"".join([self.bytes_b[x] for x in b]) != raw:
            return None
        return a, b


def encoders(path_a: str, path_b: str) -> Encoders:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Encoders(path_a, path_b)
    return _pairs[path_a, path_b]


class Merge:
    """The token ends of both vocabularies over segments laid end to end, merged. Segments that aren't spelled have none."""

    def __init__(self, enc: Encoders, segments: list[str]):
        ids_a, ids_b, size = [], [], np.zeros(len(segments), np.int64)
        # a segment that ends in a character goes together with the next one; others are texts' ends
        joined = [i for i, s in enumerate(segments) if s and not s[-1].isspace() and enc.cuts]
        alone = sorted(set(range(len(segments))) - set(joined))
        runs = [joined[at : at + TOGETHER] for at in range(0, len(joined), TOGETHER)] + [[i] for i in alone]
        order = []
        while runs:
            run = runs.pop()
            if found := enc.spelled("".join([" " + segments[i] for i in run])):
                ids_a += found[0]
                ids_b += found[1]
                order += run
                size[run] = [1 + len(segments[i].encode()) for i in run]
            elif len(run) > 1:
                runs += [run[: len(run) // 2], run[len(run) // 2 :]]
        self.spelled = size > 0
        order = np.array(order, np.int64)
        a, b, seg_ends = np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.cumsum(size[order])
        ends_a, ends_b = np.cumsum(enc.size_a[a]), np.cumsum(enc.size_b[b])
        ends = np.unique(np.concatenate([ends_a, ends_b]))
        i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)  # both pointers, at each end
        both = ends[(ends_a[i] == ends) & (ends_b[j] == ends)]
        n = len(segments)

        def by_segment(at: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[order] = np.bincount(np.searchsorted(seg_ends, at), minlength=len(order))
            return out

        self.n_a, self.n_b, self.n_groups, self.n_links = (by_segment(x) for x in (ends_a, ends_b, both, ends))
        place = np.searchsorted(seg_ends, ends)
        #: A id << 32 | B id of each link, by segment.
        self.links = (a[i] << 32 | b[j])[np.argsort(order[place] if len(ends) else place, kind="stable")]
        in_a, in_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        code = np.concatenate([3 * a + (both[in_a] == ends_a), 3 * b + 2 * (both[in_b] == ends_b)])[np.argsort(np.concatenate([in_a, in_b]), kind="stable")]
        whole = b"".join([enc.said[x] for x in code.tolist()])
        lengths = np.bincount(np.searchsorted(seg_ends, np.sort(np.concatenate([ends_a, ends_b]), kind="stable")), weights=enc.said_size[code], minlength=len(order)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        #: The groups of each segment as text, each with a semicolon behind it.
        self.groups = [b""] * n
        for k, x in enumerate(order.tolist()):
            self.groups[x] = whole[cuts[k] : cuts[k + 1]]


class Block:
    """Rows of a task that share a dictionary of segments."""

    def __init__(self, enc: Encoders):
        self.enc, self.chars = enc, 0
        self.index: dict[str, int] = collections.defaultdict(itertools.count().__next__)
        self.rows: list[tuple[int, np.ndarray]] = []

    def add(self, doc_id: int, text: str | None) -> None:
        parts = self.enc.segments(text) if text else []
        self.rows.append((doc_id, np.fromiter(map(self.index.__getitem__, parts), np.int32, len(parts))))
        self.chars += len(text or "")

    def frame(self, block: int) -> pd.DataFrame:
        """A row for each row of the block, and its dictionary."""
        m = Merge(self.enc, list(self.index))
        out, used = [], np.zeros(len(self.index), np.int64)
        for doc_id, own in self.rows:
            if len(own) and m.spelled[own].all():
                np.add.at(used, own, 1)
                digest = hashlib.sha256(b"".join([m.groups[i] for i in own.tolist()])[:-1]).hexdigest()
                out.append((block, 0, doc_id, *(int(x[own].sum()) for x in (m.n_a, m.n_b, m.n_groups, m.n_links)), digest, own, None, None, None, None))
            else:
                out.append((block, 0, doc_id, 0, 0, 0, 0, "", own[:0], None, None, None, None))
        pairs, links = np.unique(m.links, return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, links, np.repeat(used, m.n_links))
        starts = np.concatenate([[0], np.cumsum(m.n_links)]).astype(np.int32)
        out.append((block, 1, 0, 0, 0, 0, 0, None, None, pairs, times, links.astype(np.int32), starts))
        return pd.DataFrame(out, columns=NAMES)


ROWS = "block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments array<int>, pairs array<long>, times array<long>, links array<int>, starts array<int>"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def merged_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The blocks of docs(doc_id, text): a row for each row, and a dictionary for each block."""

    def run(frames):
        enc, n = encoders(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(enc)
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                block.add(doc_id, text)
                if block.chars >= BLOCK_CHARS:
                    yield block.frame(n)
                    n, block = n + 1, Block(enc)
        if block.rows:
            yield block.frame(n)

    return docs.select(F.coalesce("doc_id", F.lit(C.NO_ID)).alias("doc_id"), "text").mapInPandas(C.tidy(run), ROWS)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, count, best of merged_rows(): links of each pair of ids, and whether the B id has no pair of more."""
    each = table.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.*").where("times > 0")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(LOW))
    counts = C.stored(counts.withColumn("b", b))
    top = counts.groupBy("b").agg(F.max("count").alias("most"))  # as many rows as B has ids at most
    return counts.join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _answered(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a block with sums over their links."""
    at = answers["pos"].to_numpy()
    whole = rows.filter(pa.compute.equal(rows["kind"], 1)).slice(0, 1)
    links, starts = (whole[c].combine_chunks().flatten().to_numpy() for c in ("links", "starts"))
    size = int(links.max(initial=-1)) + 1
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[at], best[at] = answers["count"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
    mine = rows.filter(pa.compute.equal(rows["kind"], 0)).combine_chunks()
    own = mine["segments"].combine_chunks()
    of = own.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(own).to_numpy())])
    sums = []
    for x in (best, count):
        by_link = np.concatenate([[0], np.cumsum(x[links])])
        by_segment = by_link[starts[1:]] - by_link[starts[:-1]]
        by_row = np.concatenate([[0], np.cumsum(by_segment[of])])
        sums.append(pa.array(by_row[ends[1:]] - by_row[ends[:-1]]))
    return pa.table([*(mine[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, mine["groups_sha256"]], names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = C.stored(merged_rows(docs, path_a, path_b))
    counts = C.stored(pair_counts(table))
    asked = table.where("kind = 1").select(F.col("block").alias("of"), F.posexplode("pairs").alias("pos", "pair"))
    answers = asked.join(C.sized(counts), "pair").select("of", "pos", "count", "best")
    rows = table.select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "segments", "links", "starts")
    out = rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_answered, RESULT)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(C.NO_ID)))
