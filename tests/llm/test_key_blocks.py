"""Tasks of the n-gram Jaccard join hold blocks of whole keys, not their partitions."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import common, jaccard_join

from .test_operators import brute_components, shingle_set, words


@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_blocks_have_whole_keys(rows):
    r = np.random.default_rng(3)
    key = np.sort(np.concatenate([r.integers(-20, 20, 300), np.full(500, 3)]))
    t = pa.table({"key": key, "n": np.arange(len(key))})
    blocks = []
    list(common.by_key(lambda b: blocks.append(b) or [], rows)(iter(t.to_batches(max_chunksize=13))))
    assert pa.concat_tables(blocks).equals(t)
    seen = [set(b["key"].to_pylist()) for b in blocks]
    assert sum(map(len, seen)) == len(set(key.tolist()))
    largest = max(np.unique(key, return_counts=True)[1])
    assert max(b.num_rows for b in blocks) <= 2 * (rows + largest) + 13
    assert list(common.by_key(lambda b: [b], rows)(iter([t.to_batches()[0].slice(0, 0)]))) == []


def test_memory_does_not_follow_the_partition():
    r = np.random.default_rng(4)
    n = 2_000_000  # 32 MB; held whole, this took 132 MB
    key = np.sort(r.integers(0, 1 << 62, n // 2).repeat(2))
    t = pa.table({"key": key, "digest": r.integers(0, 1 << 62, n)})
    tracemalloc.start()
    rows = sum(b.num_rows for b in common.by_key(jaccard_join._trees)(iter(t.to_batches(max_chunksize=1000))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n
    assert peak < 48 << 20


@pytest.mark.parametrize("rows,pairs", [(1, 10), (5, 100), (60, 250_000)])
def test_same_links_in_small_blocks(spark, monkeypatch, rows, pairs):
    r = random.Random(rows)
    base = [words(r, r.randint(8, 60)) for _ in range(6)]
    texts = [" ".join(words(r, 1)[0] if r.random() < 0.02 else w for w in b) for b in base for _ in range(9)] + ["", None]
    monkeypatch.setattr(common, "KEY_ROWS", rows)
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    monkeypatch.setattr(jaccard_join, "CELLS", pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components({i: shingle_set(t, 4) for i, t in enumerate(texts)}, 85)
    got = {x[0]: x[2] for x in jaccard_join.jaccard_join(df).collect()}
    assert got == want
