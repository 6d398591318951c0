"""The recommendation queries that have no SQL form, against plain Python over the same tables."""

import math
import re

import pyarrow.parquet as pq
import pytest
import xxhash

from pyspark.sql import functions as F

from eventloom import providers
from eventloom.plans import QUERIES, recommend

SF = "/root/testdata/sf0.001"
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~。、！？「」『』（）]")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def embed(text, dims=64):
    out = [0.0] * dims
    for w in PUNCTUATION.sub(" ", (text or "").lower()).split():
        if len(w) > 1:
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            signed = h - (1 << 64) if h >> 63 else h
            out[signed % dims] += -1.0 if h >> 63 else 1.0
    return out


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def nearest(query, corpus, k):
    """(sim, id) of the k best; corpus: id -> vector."""
    return sorted(((cosine(query, v), i) for i, v in corpus.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_rag_context(spark):
    parts = rows("part")
    page = {p["p_partkey"]: f"{p['p_name']} {p['p_type']}" for p in parts}
    corpus = {i: embed(t) for i, t in page.items()}
    want = {p["p_partkey"]: "\n\n".join(page[i] for _, i in nearest(embed(p["p_name"]), corpus, 3)) for p in parts if p["p_partkey"] % 20 == 0}
    got = {x["query_id"]: x["context"] for x in QUERIES["rag_context"](spark, SF).collect()}
    assert got == want and len(got) >= 5


def test_hyde(spark):
    corpus = {p["p_partkey"]: embed(f"{p['p_name']} {p['p_type']} {p['p_brand']}") for p in rows("part")}
    want = []
    for c in rows("customer"):
        if c["c_custkey"] % 20 == 0:
            seen: list = []
            for q in dict.fromkeys([c["c_mktsegment"].strip(), "ECONOMY STEEL"]):
                seen += [i for s, i in nearest(embed(q), corpus, 50) if s >= 0.2 and i not in seen]
            want += [(c["c_custkey"], i, n) for n, i in enumerate(seen[:10], 1)]
    got = [(x["user"], x["id"], x["ord"]) for x in QUERIES["recommend_hyde"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_by_tags(spark):
    parts = rows("part")
    want = []
    for tag in sorted({p["p_type"] for p in parts if p["p_partkey"] % 20 == 0}):
        asked, found = embed(tag), []
        for mode in ("concat", "per_keyword"):
            lists = []
            for words in ((lambda p: p["p_name"].split(" ")), (lambda p: [p["p_type"], p["p_brand"]])):
                sims = {}
                for p in parts:
                    texts = [" ".join(words(p)).strip()] if mode == "concat" else words(p)
                    sims[p["p_partkey"]] = max(0.0, *(cosine(asked, embed(t)) for t in texts))
                order = sorted(sims, key=lambda i: (-sims[i], i))
                lists.append((sims, {i: n for n, i in enumerate(order, 1)}))
            mean = {p["p_partkey"]: (lists[0][0][p["p_partkey"]] + lists[1][0][p["p_partkey"]]) / 2 for p in parts}
            for method in ("rrf", "weighted", "hybrid"):
                def score(i, method=method, lists=lists):
                    return sum({"rrf": 1 / (60 + r[i]), "weighted": s[i] / (60 + r[i]), "hybrid": 0.5 * s[i] + 0.5 / (60 + r[i])}[method] for s, r in lists)

                best = sorted((i for i in mean if mean[i] >= 0.2), key=lambda i: (-score(i), i))[:5]
                found += [(f"[mode:{mode}][fuse:{method}]", -score(i), i, mean[i]) for i in best]
        want += [(tag, i, label, round(-s, 6), round(m, 6)) for label, s, i, m in sorted(found)[:10]]
    got = [(x["tag"], x["id"], x["label"], x["score"], x["mean_sim"]) for x in QUERIES["recommend_by_tags"](spark, SF).collect()]
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(want)]
    assert [x[3:] for x in sorted(got)] == [pytest.approx(x[3:], abs=2e-6) for x in sorted(want)]


def test_embeddings_of_texts_and_of_arrays(spark):
    rows = [(0, "Rice rice, b code"), (1, ""), (2, None), (3, "code"), (4, "ÄÖ 日本")]
    df = spark.createDataFrame([(i, t, None if i == 4 else [t, "code", None]) for i, t in rows], "i int, t string, a array<string>")
    for n in (8, 64):
        given = providers.hashed_embedding(n)
        for r in df.select("i", given(F.col("t")).alias("v"), given.of_array(F.col("a")).alias("w")).collect():
            text = rows[r["i"]][1]
            assert r["v"] == list(embed(text or "", n))
            assert r["w"] == (None if r["i"] == 4 else [list(embed(x or "", n)) for x in (text, "code", None)])


def test_only_the_smallest_ids_of_a_page_are_embedded(spark):
    events = spark.createDataFrame([(i, f"page {i % 3}") for i in range(60)], "id long, page string")
    assert sorted(r["id"] for r in recommend.first_of_each(events, 2).collect()) == list(range(6))
    asked = spark.createDataFrame([(1, "page 2"), (2, "page 2"), (3, None)], "query_id long, question string")
    found = {r["query_id"]: r["context"] for r in recommend.context(asked, events, k=4).collect()}
    assert found[1] == found[2] == "page 0\n\npage 1\n\npage 2\n\npage 0" and found.keys() == {1, 2, 3}
