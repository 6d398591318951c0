"""SimHash near-dedup against all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import simhash


def slow_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius):
    """Position of the first member of each one's component."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i + 1, len(prints)):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def texts():
    r = random.Random(5)
    out = [None, "", " \n\t", "one", "ONE", "two words", "Ünï Words Übung Straße x\x85y", "a\x1cb c d e f", "w " * 3000, "x" * 5000]
    for _ in range(25):
        base = [f"word{r.randint(0, 300)}" for _ in range(r.randint(3, 200))]
        out += [" ".join(base), " ".join(base), "  ".join(base).upper()]
        for _ in range(3):
            near = list(base)
            near[r.randrange(len(near))] = "changed"
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize(("tile", "rows", "chunk", "radius"), [(16384, 64, 1 << 20, 4), (3, 2, 7, 12)])
def test_near_copies(spark, monkeypatch, tile, rows, chunk, radius):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash.near_pairs, "__defaults__", (rows,))
    monkeypatch.setattr(simhash.links, "__defaults__", (tile,))
    all_texts = texts()
    docs = spark.createDataFrame([(100 - i, t, i, "k", 1) for i, t in enumerate(all_texts)], "doc_id long, text string, fp long, root string, `a.b` int").repartition(3)
    prints = [slow_print(t) for t in all_texts]
    root = components(prints, radius)
    least = {x: min(100 - i for i, y in enumerate(root) if y == x) for x in root}
    got = sorted(tuple(x) for x in simhash.near_copies(docs, radius).collect())
    assert got == sorted((100 - i, f"{p:016x}", least[x]) for i, (p, x) in enumerate(zip(prints, root, strict=True)))


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "A B C D E"), (3, "nothing like the others at all"), (None, "something else that stands alone here")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in got) == [(-1, -1), (-1, 7), (3, 3), (7, 7), (7, 7)]
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_that_differ_too_much_are_not_compared(spark, monkeypatch):
    seen = []
    plain = simhash.tile_stars
    members = spark.createDataFrame([((1 << n) - 1,) for n in range(0, 60, 5)], "fp long")
    monkeypatch.setattr(simhash, "tile_stars", lambda a, b, radius: seen.append((a, b)) or plain(a, b, radius))
    assert simhash.links(members, 4).count() == 0
    assert simhash.links(members, 5).agg(F.count("*")).first()[0] >= 11
