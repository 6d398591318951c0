"""Keyword index, nearest vectors, edit-similarity join and segmentation, each against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import extractors, fuzzy, keywords, segment, vectors
from eventloom.plans import recommend


@pytest.mark.parametrize("pass_bytes", [1 << 20, 40])
def test_occurrences(spark, pass_bytes):
    r = random.Random(1)
    words = ["a", "ab", "abc", "b", "日本", "本", "x y", "", None, "zz", "é"] + ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(20)]
    texts = [(i, "".join(r.choice("abc日本 xyé") for _ in range(r.randint(0, 30)))) for i in range(60)] + [(99, None), (100, ""), (100, "zz")]
    got = keywords.occurrences(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(w,) for w in words], "word string"), pass_bytes)
    want = [(i, w) for i, t in texts if t is not None for w in set(words) - {None} if w in t]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def ranked(users, events, most, n, least):
    out = []
    for user, words in users:
        if words is None:
            continue
        rows = sorted((-sum(w is not None and w.lower() in t for w in words), i, t) for i, t in ((i, " ".join(x or "" for x in e).lower()) for i, *e in events))
        for s, i, t in rows[:most][:n]:
            if min(100, -s * 10) >= least:
                out.append((user, i, -s, min(100, -s * 10), ",".join(w for w in words if w is not None and w.lower() in t)))
    return sorted(out)


@pytest.mark.parametrize("least", [10, 0])
def test_by_keywords(spark, least):
    r = random.Random(2)
    vocabulary = ["go", "Rust", "py", "日", "go lang", "x"]
    users = [(u, [r.choice([*vocabulary, None]) for _ in range(r.randint(0, 4))]) for u in range(12)] + [(50, None), (51, ["absent"]), (52, ["go", "go"])]
    events = [(i, " ".join(r.choice(vocabulary).upper() for _ in range(r.randint(0, 3))), r.choice([None, "lang", "pypy"])) for i in range(30)]
    u, e = spark.createDataFrame(users, "user int, k array<string>"), spark.createDataFrame(events, "id int, a string, b string")
    got = recommend.by_keywords(u, e, lambda x: F.col("k"), ["a", "b"], 6, 4, least)
    assert sorted(tuple(x) for x in got.collect()) == ranked(users, events, 6, 4, least)
    assert least == 0 or "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    few = recommend.by_keywords(u, e.limit(3), lambda x: F.col("k"), ["a"], 6, 4, least)
    assert {x["score"] for x in few.collect()} == {1} and few.count() == 3 * 14


@pytest.mark.parametrize(("qb", "vb", "k"), [(8192, 65536, 5), (7, 11, 5), (8192, 65536, 500)])
def test_nearest(spark, monkeypatch, qb, vb, k):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", qb)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", vb)
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)] + [(200, [0.0] * 4), (201, None), (5, [1.0, 1.0, 1.0, 1.0])]
    queries = [(i, v) for i, v in rows if i % 9 == 0] + [(777, None)]
    found = vectors.nearest(spark.createDataFrame(queries, "query_id int, q array<double>"), spark.createDataFrame([(*x, "c") for x in rows], "id int, v array<double>, more string"), k)
    got = sorted((x["query_id"], x["rank"], x["id"], round(x["sim"], 9)) for x in found.collect())

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    want = []
    for i, q in queries:
        best = sorted((-cosine(v, q), j) for j, v in rows if v is not None) if q else []
        want += [(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(best[:k], 1)]
    assert got == sorted(want) and found.columns == ["query_id", "id", "more", "sim", "rank"]
    with pytest.raises(Exception, match="dimensions"):
        vectors.nearest(spark.createDataFrame([(1, [1.0])], "query_id int, q array<double>"), spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>"), 1).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.7, 0.5, 0.85])
def test_similar_texts(spark, least):
    r = random.Random(4)
    seeds = ["".join(r.choice("abcdé ") for _ in range(r.randint(1, 25))) for _ in range(25)]
    near = []
    for s in seeds * 3:
        t = list(s)
        for _ in range(r.randint(0, 6)):
            at, kind = r.randint(0, len(t)), r.random()
            t[at : at + (kind < 0.6)] = [] if kind < 0.3 else [r.choice("abcdx")]
        near.append("".join(t))
    left, right = [*seeds, "", None, "a"], [*near, *seeds[:5], "", None, "b"]
    frames = [spark.createDataFrame([(t,) for t in x], "text string") for x in (left, right)]
    got = {(x["a"], x["b"]): x["sim"] for x in fuzzy.similar_texts(*frames, least).collect()}
    want = {(a, b): 1 - distance(a, b) / max(len(a), len(b)) for a, b in itertools.product(set(left) - {None, ""}, set(right) - {None, ""})}
    assert got == pytest.approx({p: s for p, s in want.items() if s > least})
    rows = spark.createDataFrame(list(enumerate(left)), "k int, t string"), spark.createDataFrame(list(enumerate(right)), "o int, n string")
    best = {x["k"]: (x["o"], round(x["sim"], 9)) for x in fuzzy.best_matches(rows[0], "k", "t", rows[1], "o", "n", least, same=True).collect()}
    slow = {}
    for k, t in enumerate(left):
        found = sorted((-want[t, n], o) for o, n in enumerate(right) if (t, n) in want and want[t, n] > least)
        if found:
            slow[k] = (found[0][1], round(-found[0][0], 9))
    assert best == slow


def cuts(run, longest):
    if not run:
        yield []
    for n in range(1, min(len(run), longest) + 1):
        for rest in cuts(run[n:], longest):
            yield [run[:n], *rest]


def test_lattice_is_what_all_cuts_give():
    r = random.Random(5)
    for _ in range(150):
        run = "".join(r.choice("あいう") for _ in range(r.randint(1, 7)))
        model = {run[i:j]: math.log(r.random()) for i in range(len(run)) for j in range(i + 1, min(len(run), i + 3) + 1) if r.random() < 0.7}
        scored = []
        for c in cuts(run, 3):
            p = [model.get(x, segment.UNSEEN if len(x) == 1 else None) for x in c]
            if None not in p:
                scored.append((sum(p), c))
        best = segment.best_cut(run, model, 3)
        assert sum(model.get(x, segment.UNSEEN) for x in best) == pytest.approx(max(scored)[0]) and "".join(best) == run
        total = math.log(sum(math.exp(s) for s, _ in scored))
        want: dict = {}
        for s, c in scored:
            for x in c:
                want[x] = want.get(x, 0) + math.exp(s - total)
        got, logp = segment.expected(run, model, 3)
        assert logp == pytest.approx(total) and {k: v for k, v in got.items() if v > 1e-12} == pytest.approx({k: v for k, v in want.items() if v > 1e-12})


def test_words_are_found_again(spark, monkeypatch):
    monkeypatch.setattr(segment, "HELD", 50)
    r = random.Random(6)
    words = ["東京", "大学", "図書館", "学生", "教育", "料理", "音楽会", "自転車"]
    said = [[r.choice(words) for _ in range(r.randint(2, 6))] for _ in range(150)]
    texts = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(said)] + [(900, None), (901, ""), (902, "plain ASCII words 12")], "id int, t string").repartition(3)
    model = segment.fit(texts, "t", pieces=60, rounds=4)
    cut = segment.Segmenter(model)
    right = sum(segment.words_of("".join(s), model) == s for s in said)
    assert right >= 0.95 * len(said)
    got = {x["id"]: list(x["w"]) for x in texts.select("id", cut(F.col("t")).alias("w")).collect()}
    assert got[902] == ["plain", "ASCII", "words", "12"] and got[900] == got[901] == [] and got[0] == cut.words("".join(said[0]))
    assert segment.fit(texts.where("id > 899"), "t") == {}
    # as the tokenizer of an extractor
    docs = spark.createDataFrame([(1, "。".join("".join(r.choice(words) for _ in range(6)) for _ in range(6)))], "id int, t string")
    assert len(extractors.rank_sentences(docs, "id", "t", tokenizer=cut).collect()) >= 1
    assert extractors.word_ranks(docs, "id", "t", tokenizer=cut).count() >= 1


@pytest.mark.parametrize(("depth", "threshold"), [(2, 0.3), (5, 0.0)])
def test_threshold_fusion_is_the_whole_ranking(spark, depth, threshold):
    r = np.random.default_rng(9)
    vec = lambda n: [r.normal(size=3).tolist() for _ in range(n)]
    pairs = list(zip(vec(50), vec(50), strict=True))
    events = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, *pairs[:9]])] + [(100, [0.0] * 3, [0.0] * 3)], "id int, va array<double>, vb array<double>")
    tags = spark.createDataFrame([(f"t{i}", a, b) for i, (a, b) in enumerate(zip(vec(9), vec(9), strict=True))], "tag string, qa array<double>, qb array<double>")
    methods = ("rrf", "weighted", "hybrid")
    both = vectors.against(tags, events, "tag")
    lists = [both.select("tag", "id", vectors.cosine(F.col(f"v{x}"), F.col(f"q{x}")).alias("sim")) for x in "ab"]

    def said(rows):
        return sorted((x["tag"], x["label"], x["id"], round(x["score"], 9), round(x["mean_sim"], 9)) for x in rows.collect())

    got = said(vectors.recommend_nearest(tags, events, threshold, 4, methods, depth=depth))
    assert got == said(vectors.recommend(*lists, "tag", "id", threshold, 4, methods)) and (threshold > 0.9 or len(got) > 60)
    assert vectors.recommend_nearest(tags.limit(0), events).count() == vectors.recommend_nearest(tags, events.limit(0)).count() == 0


def test_whole_lists_in_groups(spark, monkeypatch):
    """Ranked, fused and pooled lists that no join makes: against the operators on rows, with ties, zero and missing vectors."""
    monkeypatch.setattr(vectors, "POOL_QUERIES", 2)
    spin = random.Random(4)
    own = [[spin.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)] for _ in range(40)] + [[0.0, 0.0, 0.0]]
    rows = [(i, spin.choice(["x", "y", None]), own[spin.randrange(len(own))]) for i in range(90)] + [(90, "x", None), (91, "z", None)]
    corpus = spark.createDataFrame(rows, "id long, label string, v0 array<float>")
    queries = spark.createDataFrame([(i, own[i]) for i in range(7)], "query_id long, q0 array<float>")
    sims = vectors.scored(queries.withColumnRenamed("q0", "q"), corpus.withColumnRenamed("v0", "v")).cache()
    lists = vectors.ranked(sims, "query_id", "sim", "id")

    def said(x):
        return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()), key=str)

    plans = vectors.fused_nearest(queries, corpus.select("id", "v0"))
    assert "BroadcastNestedLoopJoin" not in (plan := plans._jdf.queryExecution().toString()) and "Window" not in plan
    for method in ("rrf", "weighted", "hybrid"):
        assert said(vectors.fused_nearest(queries, corpus.select("id", "v0"), method)) == said(vectors.fused(lists, "id", method=method))
    for how in ("max", "mean"):
        assert said(vectors.pooled_nearest(queries, corpus, "label", how)) == said(vectors.pooled(sims, "query_id", "label", how=how))
    with pytest.raises(Exception, match="different dimensions"):
        vectors.pooled_nearest(queries, spark.createDataFrame([(1, "x", [1.0])], "id long, label string, v0 array<float>"), "label").collect()


def test_best_texts_are_kept_by_tasks(spark):
    """Of a list that every text matches, a task gives out the best only: with ties, repeated, null and empty words."""
    r = random.Random(8)
    vocabulary = ["the", "he", "t", "zz", "日"]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 4)))) for i in r.sample(range(2000), 900)] + [(5000, None)]
    lists = [(0, ["t", "he", "the"]), (1, ["zz", "zz", None]), (2, [""]), (3, []), (4, ["absent"]), (5, ["日", "the"])]
    for pass_bytes in (1 << 20, 40):
        got = keywords.best_texts(spark.createDataFrame(texts, "id int, t string").repartition(3), "id", "t", spark.createDataFrame(lists, "list long, words array<string>"), 4, pass_bytes).collect()
        assert 4 <= max(sum(x["list"] == n for x in got) for n, _ in lists) <= 12
        for n, words in lists:
            want = sorted((-len(at), i, at) for i, t in texts if t is not None for at in [[k for k, w in enumerate(words) if w is not None and w in t]] if at)[:4]
            assert sorted((-x["score"], x["id"], x["at"]) for x in got if x["list"] == n)[:4] == want


def test_pairs_of_rows_with_like_names(spark):
    """Pairs within blocks against brute force; names are compared once, however many rows have them."""
    r = random.Random(6)
    rows = [(i, r.choice(["red bolt", "red bolts", "blue bolt", "ring", "", None]), r.choice("xy"), r.choice(["p", None])) for i in range(80)]
    parts = spark.createDataFrame(rows, "id int, name string, one string, two string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def alike(a, b):
        calls.add(1)
        return float(a[:1] == b[:1])

    got = fuzzy.similar_within(parts, "id", "name", ["one", "two"], lambda a, b: alike(a, b), 0.5)
    want = [(x[0], y[0], 1.0) for x in rows for y in rows if x[0] < y[0] and x[2:] == y[2:] and x[3] and None not in (x[1], y[1]) and x[1][:1] == y[1][:1]]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 50
    assert calls.value <= 3 * 25


def test_runs_expected_together_are_expected_one_by_one(monkeypatch):
    r = random.Random(5)
    model = {x: -r.random() * 5 - 0.1 for x in {"".join(r.choice("あいう") for _ in range(r.randint(1, 4))) for _ in range(40)}}
    held = {"".join(r.choice("あいうえお") for _ in range(n)): r.randint(1, 3) for n in [1, 1, 2, 3, 3, 4, 5, 8, 13, 13, 40]}
    want: dict = {}
    for run, times in held.items():
        for piece, n in segment.expected(run, model, 4)[0].items():
            want[piece] = want.get(piece, 0.0) + times * n
    for block in (1, 10, 1000):
        monkeypatch.setattr(segment, "BLOCK", block)
        assert segment.expected_of(held, model, 4) == pytest.approx(want, rel=1e-9, abs=1e-30)
    assert segment.expected_of({}, model) == {}
    assert segment.substrings({"aab": 2, "a": 1}, 2) == {"a": 5, "b": 2, "aa": 2, "ab": 2}
