"""Each operator against brute force on small rows with nulls, empty and repeated rows, ties, and other columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import chat_format, decontaminate, html_text, jaccard_join, language_id, neighbours, packing, pii, quality, repeats
from eventloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, nid long, key string"


def words(r, n):
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [words(r, r.randint(1, 120)) for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        c = list(b)
        c[r.randrange(len(c))] = "changed"
        texts += [" ".join(c), " ".join(b), " ".join(c) + " tail"]
    texts += [None, "", "  \n", "one", "one", "two words", "Two Words", "x" * 5000]
    return [(i, t, "en" if i % 2 else None, "s", None, i, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, (None, "one", None, None, None, None, None)], DOCS)


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(sets, num):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, k, num):
    sets = {d: shingle_set(t, k) for d, t, *_ in rows}
    root = brute_components(sets, num)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_join(docs, k, num, 100).collect()}
    assert got.pop(None) == (1, root[next(d for d, t, *_ in rows if t == "one")])
    assert got == {d: (len(s), root[d]) for d, s in sets.items()}


@pytest.mark.parametrize(("whole", "leaf", "fine"), [(6_000_000, 32, 8), (6_000_000, 3, 2), (3000, 3, 8), (700, 32, 4), (1, 3, 8)])
def test_jaccard_join_in_shards(spark, monkeypatch, whole, leaf, fine):
    """Families of near copies about the threshold, dealt into shards of every size, and chains whose ends don't link."""
    r, texts = random.Random(31), []
    for _ in range(3):
        base = words(r, 60)
        for _ in range(45):
            c = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                c[r.randrange(len(c))] = r.choice(["x", "y", "changed"])
            texts.append(" ".join(c))
    chain = words(r, 90)
    for i in range(30):
        chain[3 * i] = f"new{i}"
        texts.append(" ".join(chain))
    monkeypatch.setattr(jaccard_join, "WHOLE", whole)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "FINE_BITS", fine)
    want = brute_components({i: shingle_set(t, 4) for i, t in enumerate(texts)}, 85)
    assert 3 < len(set(want.values())) < 140
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {x[0]: x[2] for x in jaccard_join.jaccard_join(df).collect()} == want


def test_jaccard_join_empty(docs):
    assert jaccard_join.jaccard_join(docs.where("false")).count() == 0


@pytest.mark.parametrize(("contexts", "transform"), [(8, 1 << 18), (1, 1 << 18), (2, 64)])
def test_repeats(docs, rows, monkeypatch, contexts, transform):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", contexts)  # down to all anchors giving way to their windows
    monkeypatch.setattr(repeats, "TRANSFORM_BYTES", transform)
    least, seen, want = 40, set(), {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                hit[i : i + least] = b"\1" * least
            seen.add(b[i : i + least])
        runs = sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1]))
        want[d] = (len(b), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in repeats.repeats(docs, least, 16).collect()}
    assert got.pop(None)[1] == 0
    assert got == want


def test_repeated_row_is_removed(spark):
    t = hashlib.sha512(b"x").hexdigest() + "0123456789abcdefghijkl"
    got = sorted(tuple(r)[1:4] for r in repeats.repeats(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")).collect())
    assert [x[1] for x in got] == [0, 150]


def test_decontaminate(spark, docs):
    r = random.Random(9)
    item = words(r, 40)
    near = [*item[:-1], "other"]
    bad = spark.createDataFrame([(900, " ".join([*words(r, 30), *item, *words(r, 5)])), (901, " ".join([*words(r, 9), *near])), (902, " ".join(item[:20]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    every = docs.select("doc_id", "text").unionByName(bad)
    got = {x[0]: list(x[1]) for x in decontaminate.matches(every, items).where("size(item_ids) > 0").select("doc_id", "item_ids").collect()}
    assert got == {900: [1], 901: [1]}
    assert decontaminate.decontaminate(docs, items.where("false")).count() == docs.count()


def test_decontaminate_beyond_the_radius():
    r, k, beyond = random.Random(12), 5, 0
    for _ in range(1500):
        item = words(r, r.randint(60, 120))
        at, n = r.choice([0, r.randrange(len(item)), len(item) - 8]), r.randint(4, 8)
        copy = [*item[:at], *words(r, len(item[at : at + n])), *item[at + n :]]
        a, b = (collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (item, copy))
        both = (a & b).total()
        text = " ".join([*["x"] * 60, *copy, *["y"] * 60]).encode()
        index = decontaminate.Items([(1, " ".join(item)), (2, " ".join(copy))], k)
        beyond += 5 * both >= 4 * (2 * a.total() - both) and int(np.bitwise_count(index.prints[0] ^ index.prints[1])) > decontaminate.RADIUS
        got = decontaminate.find(np.frombuffer(text, np.uint8), np.array([0, len(text)]), index, decontaminate.Fraction(4, 5))
        assert (0 in got[0]) == (5 * both >= 4 * (2 * a.total() - both))
    assert beyond


def test_decontaminate_brute_force(spark, monkeypatch):
    r, k = random.Random(12), 5
    items = [(i, words(r, n)) for i, n in enumerate([5, 6, 12, 30, 60, 3])]
    docs = [(0, items[3][1][:-1]), (1, items[4][1][3:])]
    for i in range(300):
        item = list(r.choice(items)[1])
        at, n = r.randrange(len(item)), r.randint(0, 8)
        item[at : at + n] = words(r, len(item[at : at + n]))
        cut = item[r.choice([0, 0, 1, 4]) : len(item) - r.choice([0, 0, 1, 4])]
        docs.append((10 + i, words(r, r.choice([0, 0, 3, 20])) + cut + words(r, r.choice([0, 0, 3, 20]))))
    items.append((6, ["same"] * 20))
    docs += [(400, ["same"] * 18), (401, ["same"] * 40), (402, ["x", *["same"] * 17, "y"])]

    def bag(w):
        return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else collections.Counter([tuple(w)])

    want = {}
    for d, w in docs:
        for i, item in items:
            for s in range(1 - len(item), len(w)):
                a, b = bag(w[max(s, 0) : s + len(item)]), bag(item)
                both = (a & b).total()
                if 5 * both >= 4 * (a.total() + b.total() - both):
                    want.setdefault(d, set()).add(i)
                    break
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {0, 1, 400} <= want.keys()
    for most, hits in ((decontaminate.ITEM_BYTES, decontaminate.HITS), (decontaminate.ITEM_BYTES, 3), (0, decontaminate.HITS)):  # broadcast, in halves, by joins
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", most)
        monkeypatch.setattr(decontaminate, "HITS", hits)
        got = {x[0]: set(x[1]) for x in decontaminate.matches(df, bench).where("size(item_ids) > 0").select("doc_id", "item_ids").collect()}
        assert got == want


def test_decontaminate_long_and_clashing(spark, monkeypatch):
    r = random.Random(3)
    item = words(r, 3000)
    rows = [(1, " ".join([*["pad"] * 50_000, *item, *item]), 0.25, "x"), (2, "clean", 0.5, None), (2, None, None, "y"), (None, " ".join(item[1:]), 1.0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, similarity double, __found0 string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, " ")], "item_id long, text string")
    for most in (decontaminate.ITEM_BYTES, 0):
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", most)
        assert sorted(map(str, map(tuple, decontaminate.decontaminate(df, bench).collect()))) == sorted(map(str, rows[1:3]))
        got = {x["doc_id"]: x for x in decontaminate.matches(df, bench).collect()}
        assert list(got[1]["item_ids"]) == [1] and got[1]["similarity"] == 1 and got[1]["first_word"] == 50_000 and got[1]["__found0"] == "x"


def reference_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        x = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 13 <= len(x) <= 19 and sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(x)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_patterns(spark):
    r = random.Random(5)
    bits = ["a@b.c", "_x@d.e", "1.2.3.4", ".5", ".6.7.8", "300.1.1.1", "4111 1111", "-1111-1111", "  ", "+", "+1 (234) 567-8900", "@", ".", "é", "🙂", "a", "1", "2 3", "4111111111111111"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(300)] + [None, "", "9" * 20000]
    got = pii._found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.joined(pii.KINDS).alias("s")).collect()
    assert {x[0]: x[1] for x in got} == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in reference_spans(t or "")) for i, t in enumerate(texts)}


def test_pii_terms_and_text(spark):
    r = random.Random(1)
    rows = [(i, " ".join(words(r, 60)), 0) for i in range(200)] + [(500 + i, f"{' '.join(words(r, 5))} zorblat writes to jo@x.org {' '.join(words(r, 5))}", 0) for i in range(6)]
    df = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, n_chars long")
    out = {x["doc_id"]: x for x in pii.spans(df).collect()}
    assert all("term:" in out[500 + i]["spans"] for i in range(6)) and out[0]["spans"] == "" and out[None]["spans"] == ""
    clean = {x["doc_id"]: x for x in pii.sanitise(df).collect()}
    assert "jo@x.org" not in clean[500]["text"] and "zorblat" not in clean[500]["text"] and "[EMAIL]" in clean[500]["text"]
    assert clean[0]["text"] == rows[0][1] and clean[None]["text"] is None


def test_pii_scores_rare_terms_on_distinct_texts(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, " ".join(words(r, 60))) for i in range(200)] + [(300, "one qwenda writes to al@x.org here")]
    # copies count once: vrunto is near bo@x.org in one text, elsewhere in none; plimsk is elsewhere in two texts
    rows += [(400 + i, "two vrunto plimsk writes to bo@x.org here") for i in range(5)] + [(500, "plimsk alpha"), (501, "plimsk beta")]
    want = {300: ["qwenda"], **{400 + i: ["vrunto"] for i in range(5)}}
    for most in (pii.BROADCAST_TERMS, 0):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
        got = {x["doc_id"]: x["spans"] for x in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for d, text in rows:
            terms = [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[d].split(",") if x) if k == "term"]
            assert [t for t in terms if t in ("qwenda", "vrunto", "plimsk")] == want.get(d, [])


def brute_kneser_ney(texts, order=quality.ORDER):
    """(cost of a text's characters, independent of the operator): dictionaries of raw and continuation counts."""
    pad = chr(quality.PAD) * (order - 1)
    counts = {order: collections.Counter(g for t in texts for x in [pad + t] for g in (x[i : i + order] for i in range(len(x) - order + 1)))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    held, total, cut = {}, {}, {}
    for k, c in counts.items():
        n = collections.Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cut[k] = [0] + [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * i)) for i in (1, 2, 3)]
        for g, x in c.items():
            total[g[:-1]] = total.get(g[:-1], 0) + x
            held[g[:-1]] = held.get(g[:-1], 0) + cut[k][min(x, 3)]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        ctx = g[:-1]
        if ctx not in total:
            return p(g[1:])
        x = counts[len(g)][g]
        return ((x - cut[len(g)][min(x, 3)]) if x else 0) / total[ctx] + held[ctx] / total[ctx] * p(g[1:])

    def perplexity(t):
        x = pad + t
        return math.exp(-sum(math.log(p(x[i : i + order])) for i in range(len(t))) / len(t)) if t else None

    return perplexity, p, counts[1]


def test_quality_against_brute_force(spark, tmp_path):
    """Perplexities, thresholds and verdicts, from memory and from files, against dictionaries."""
    r = random.Random(2)
    en = [(i, " ".join(words(r, 40)), "en") for i in range(40)]
    fr = [(50 + i, " ".join(r.choice("écla bîen çava où 😀z".split()) for _ in range(30)), "fr") for i in range(12)]
    bad = [(100 + i, "".join(r.choice("#$%&*!|") for _ in range(200)), "en") for i in range(5)]
    odd = [(200, None, "en"), (201, "", None), (202, en[0][1], None), (203, "a\0b", "xx"), (204, en[1][1], "xx"), (204, en[1][1], "xx"), (None, en[2][1], "en"), (300, "only one text", "rare")]
    rows = [*en, *fr, *bad, *odd]
    labels = [(i, 1, 0) for i in [*range(30), *range(50, 60), 300]] + [(100, 0, 0), (None, 1, 0), (35, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    df.write.parquet(f"{tmp_path}/docs")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    halves = {x["text"]: x["half"] for x in df.select("text", quality.half().alias("half")).collect()}
    good = {i for i, q, t in labels if i is not None and (q, t) == (1, 0)}
    own = {x for x in ("en", "fr", "rare") if len({halves[t] for i, t, lang in rows if i in good and lang == x}) == 2}
    assert own == {"en", "fr"}

    def folded(t):
        return "".join("\ufffd" if c == "\0" else chr(0xE000 + ord(c) % 0x1900) if ord(c) > 0xFFFF else c for c in t)

    def name(lang):
        return lang if lang in own else ""

    def model(lang, half=None):
        return brute_kneser_ney([folded(t) for i, t, x in rows if i in good and (lang == "" or x == lang) and half != halves[t]])

    full = {x: model(x) for x in ("", "en", "fr")}
    held = collections.defaultdict(list)
    for i, t, lang in rows:
        if i in good:
            held[name(lang)].append(model(name(lang), halves[t])[0](folded(t)))
    limit = {x: sorted(v)[math.ceil(quality.QUANTILE * len(v)) - 1] for x, v in held.items()}
    for p, chars in (full["en"][1:], full["fr"][1:]):
        for ctx in ("", "e", "al", "alph"):
            assert abs(sum(p(ctx + c) for c in chars) + p(ctx + "\u4e00") - 1) < 1e-9
    want = []
    for i, t, lang in rows:
        x = full[name(lang)][0](folded(t or ""))
        want.append((i, lang, x and round(x, 3), x is not None and x <= limit[name(lang)] + 1e-6))
    for docs in (df, spark.read.parquet(f"{tmp_path}/docs")):
        got = quality.classify(docs, marks).collect()
        assert sorted(map(str, want)) == sorted(str((x["doc_id"], x["lang"], x["perplexity"] and round(x["perplexity"], 3), x["keep"])) for x in got)
        assert {x["lang"]: x["threshold"] for x in got if x["lang"] in own} == pytest.approx({x: limit[x] for x in own}, rel=1e-5)
        clash = docs.withColumns({"keep": F.lit("mine"), "perplexity": F.lit(1), "half": F.lit(2), "model_lang": F.lit("m"), "h1": F.lit(0)})
        left = quality.keep(clash, marks)
        assert left.columns == clash.columns and {x["keep"] for x in left.select("keep").distinct().collect()} == {"mine"}
        assert sorted(str(x["doc_id"]) for x in left.collect()) == sorted(str(i) for i, _, _, ok in want if ok)


def test_pii_long_words_are_whole(spark):
    # a longer run doesn't count as its last fifty letters, so the word stands in one text only
    rows = [(1, f"write {'q' * 50} to jo@x.org now"), (2, "q" * 114 + " alone")] + [(10 + i, " ".join(words(random.Random(i), 30))) for i in range(60)]
    got = {x["doc_id"]: x for x in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:6:56" in got[1]["spans"] and got[2]["spans"] == ""


def test_repeats_of_one_id_with_several_texts(spark):
    texts = [hashlib.sha512(str(i).encode()).hexdigest() * 2 for i in range(40)]
    rows = [(1, t) for t in texts] + [(2, texts[3] + "x"), (None, texts[4]), (None, None)]
    got = collections.Counter((x["doc_id"], x["n_bytes"], x["n_removed"] > 0) for x in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[(2, 257, True)] == 1 and got[(None, 256, True)] == 1 and got[(None, 0, False)] == 1 and sum(v for k, v in got.items() if k[0] == 1) == 40


def test_quality_degenerate(spark):
    df = spark.createDataFrame([(i, "same same", "en") for i in range(8)] + [(9, "other", None), (10, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["keep"] for x in quality.classify(df, labels).collect()}
    assert all(got[i] for i in range(8)) and not got[9] and not got[10]
    assert quality.classify(df, labels.where("false")).where("keep").count() == 9 and quality.keep(df, labels.where("false")).count() == 9
    assert quality.classify(df.where("false"), labels).count() == 0 and quality.keep(df.where("false"), labels).count() == 0


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path, window = tokenizer_file("byte_bpe_50k.json"), 64
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(700, "a<|endoftext|>b")], "doc_id long, text string")
    got = packing.pack(docs.where("doc_id is not null").select("doc_id", "text").unionByName(extra), path, window).toPandas()
    for d, text in [*((x[0], x[1]) for x in rows), (700, "a<|endoftext|>b")]:
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in got[got.doc_id == d].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        at = 0
        for p in g.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
        assert at <= window
    assert got.sequence_id.nunique() == -(-got.length.sum() // window)
    assert packing.pack(docs.where("false"), path).count() == 0


def test_chat_format(spark):
    r = random.Random(4)
    bits = ["<|", "|>", "\\", "[INST]", "</s>", "<|end|>", "a", " ", "\n", "é", "🙂", "<|endoftext|>"]
    rows = [(i % 9, i // 9, r.choice(["user", "assistant", "assistant", None]), "".join(r.choice(bits) for _ in range(r.randint(0, 12))) or None) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, None, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat_format.digests(chat_format.format_conversations(df, tokenizer_file("byte_bpe_50k.json"))).collect()}
    by = collections.defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None]["loss_chars"] == 1


def test_minimum_cut_is_minimal():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 7)
        cost = [r.choice([-2, -1, -0.5, 0.25, 1, 3]) for _ in range(n)]
        edges = [(i, j, r.choice([0.5, 1, 2])) for i in range(n) for j in range(i) if r.random() < 0.5]

        def energy(side, cost=cost, edges=edges):
            return sum(max(0, -c) if s else max(0, c) for c, s in zip(cost, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(energy([bool(m >> i & 1) for i in range(len(cost))]) for m in range(1 << len(cost)))
        assert abs(energy(html_text.minimum_cut(cost, edges)) - best) < 1e-9


def test_main_text(spark):
    page = '<html><head><title>t</title></head><body><nav><a href=x>home</a></nav><div class="sidebar">Hot</div><article><h1>A &amp; B</h1><p>Some  text<br>goes on here.<script>x("</p>")</script><p>More.</article><div class="comments"><p>Great read, thanks a lot for it.</p></div><footer>x</footer>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    assert {x["page_id"]: x["text"] for x in html_text.main_texts(df).collect()} == {1: "A & B\nSome text goes on here.\nMore.", 2: "", 3: ""}


ONE, TWO = "First paragraph of the article, which has some length to it.", "Second paragraph of the article, and that is long enough too."
A, B, SPAM = f"<p>{ONE}</p>", f"<p>{TWO}</p>", "<p>Hot stuff that you will want to read at once, really.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<article>{A}<svg class="i"/>{B}</article>', f"<article>{A}<iframe src=x />{B}</article>", f"<article>{A}<noscript>{B}</article>", f"<article><p>{ONE}<button>Go{B}</article>",
        f"<article>{A}<p><select><option>a{B}</article>", f"<form><article>{A}{B}</article></form>", f"<form><h1>T</h1>{A}{B}</form>", f'<article class="post tag-news category-legal has-header">{A}{B}</article>',
        f'<div class="wrapper no-sidebar">{A}{B}</div>', f'<div class="page with-sidebar"><article>{A}{B}</article><div class="sidebar">{SPAM}</div></div>', f"<article>{A}<p><a href=x>link{B}</article>",
        f'<article>{A}<img alt="x>{B}</article>', f"<head><title>x</title><body>{A}{B}", f"<article>{A}{B}</article><div class='related'><article>{SPAM}</article><article>{SPAM}</article></div>",
        f"<article>{A}{B}</article><div id='comments'>{SPAM * 9}</div>", f"<main>{A}{B}</main><section><article class='comment'>{SPAM * 9}</article></section>", f"<div id='post-comments'>{SPAM}</div><main>{A}{B}</main>",
        f"<div class='cookie-banner'>{SPAM}</div><article>{A}{B}</article><footer>{SPAM}</footer>", f"<div class='ad'>{SPAM}</div><div>{A}{B}</div><aside>{SPAM}</aside>", f"<article>{A}{B}</article><script>if (a</script><style>{SPAM}",
    ],
)
def test_main_text_of_broken_and_crowded_pages(page):
    got = html_text.main_text(page).split("\n")
    assert [x for x in got if x in (ONE, TWO) or ONE in x or TWO in x] and "Hot stuff" not in "".join(got) and ONE in "\n".join(got) and TWO in "\n".join(got)


def test_main_text_keeps_headings_of_the_article():
    assert html_text.main_text(f'<header>Site</header><article><h1 class="post-header">Heading here</h1>{A}</article>') == f"Heading here\n{ONE}"


def test_main_text_in_linear_time():
    import time

    for bad in ("<scriptx" * 60_000, '<a "' * 250_000, '<a "' * 250_000 + ">", "<b>" * 100_000 + "<p></p>" * 100_000, "<div>" * 100_000 + "x", "<i>" * 100_000 + "</b>" * 100_000, "<!--" * 200_000, "&" * 1_000_000, "<" * 1_000_000, "<select>" * 100_000):
        began = time.time()
        html_text.main_text(bad)
        assert time.time() - began < 5


def test_page_labelling_is_the_least_cost_one():
    """Whole pages: the text is that of a labelling whose cost no other labelling of the same blocks beats."""
    r = random.Random(11)
    parts = [A, B, SPAM, "<ul><li><a href=x>go</a><li>x</ul>", "<h2>Short</h2>", "<div class=ad>Buy now</div>", "<p>tiny", "<td>cell</td>", "text alone that stands here", "<blockquote>Quoted words, at some length.</blockquote>"]
    for _ in range(60):
        page = "".join(r.choice(["<article>", "<div>", "</div>", ""]) + r.choice(parts) for _ in range(r.randint(1, 9)))
        found = html_text.blocks(page)
        pairs, cost = html_text.edges(found), [b.cost for b in found]

        def energy(side, cost=cost, pairs=pairs):
            return sum(max(0, -c) if s else max(0, c) for c, s in zip(cost, side)) + sum(w for a, b, w in pairs if side[a] != side[b])

        sides = [[bool(m >> i & 1) for i in range(len(cost))] for m in range(1 << len(cost))] if len(cost) <= 11 else []
        if sides:
            best = min(map(energy, sides))
            texts = {"\n".join(b.text for b, s in zip(found, side) if s) for side in sides if energy(side) <= best + 1e-9}
            assert html_text.main_text(page) in texts


def test_neighbours(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((400, 16))
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r[0]].append(r[2])
    hits = 0
    for q in range(0, 400, 20):
        s = (x.T * x[q][:, None]).sum(0)
        s[q] = -1e9
        hits += len(set(np.lexsort((np.arange(400), -s))[:20]) & set(got[q]))
    assert hits >= 0.9 * 20 * 20 and set(got) == set(range(0, 400, 20))
    copies = [i for i in got[0] if 100 <= i < 140]
    assert copies and copies == list(range(100, 100 + len(copies)))


def test_language_id(spark):
    r = random.Random(8)
    vocabulary = {"en": "the and with that from".split(), "de": "der und nicht einer schon".split()}
    docs = [(i, " ".join(r.choice(vocabulary[lang]) for _ in range(40)), lang, "s") for i, lang in enumerate(["en", "de"] * 30)]
    pages = [(i, f"http://h{i % 2}.example.org/x", f'<html lang="{"de" if i == 1 else lang}"><p>{" ".join(r.choice(vocabulary[lang]) for _ in range(30))}</p>') for i, lang in enumerate(["en", "en", "de"] * 8)]
    pages += [(90, None, None), (91, "not an address", "")]
    got = language_id.languages(spark.createDataFrame([*docs, (99, None, None, None)], "doc_id long, text string, lang string, source string"), spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    by_page = {x["page_id"]: x["language"] for x in got if x["page_id"] is not None}
    assert len(got) == len(docs) + 1 + len(pages) and all(by_page[i] == lang for i, lang in enumerate(["en", "en", "de"] * 8))
    assert sum(x["language"] == d[2] for x in got if x["doc_id"] is not None for d in docs if d[0] == x["doc_id"]) == len(docs)


def test_language_id_suffix(spark):
    r = random.Random(8)
    vocabulary = {"en": "the and with that from".split(), "de": "der und nicht einer schon".split()}

    def text(lang):
        return " ".join(r.choice(vocabulary[lang]) for _ in range(40))

    docs = [(i, text(lang), lang, "s") for i, lang in enumerate(["en", "de"] * 30)]
    pages = [(i, "http://mixed.test/", f"<p>{text(lang)}</p>") for i, lang in enumerate(["en", "de"] * 20)]
    pages += [(100 + i, f"http://h{i}.{'test' if lang == 'de' else 'other'}/", f"<p>{text(lang)}</p>") for i, lang in enumerate(["en", "de"] * 40)] + [(900, "http://mixed.test/", "")]
    got = language_id.languages(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(pages, "page_id long, url string, html string"))
    x = got.where("page_id = 900").first()
    # the host has as many rows of either language; its suffix speaks for one
    assert x["language"] == "de" and x["posterior"] > 0.65


def test_language_id_against_brute_force(spark):
    """Text likelihoods, declared, suffix and host evidence, each row's own share taken out, by dictionaries."""
    r = random.Random(21)
    vocabulary = {"en": "the and with that from".split(), "de": "der und nicht einer schon".split(), "fr": "les une avec dans pour".split()}
    langs = sorted(vocabulary)

    def text(lang, n):
        return " ".join(r.choice(vocabulary[lang]) for _ in range(n))

    docs = [(i, text(x, r.randint(3, 30)), x if i % 4 else None, r.choice(["a", "b", None])) for i, x in enumerate(langs * 12)] + [(90, None, "de", "a"), (91, "", None, None)]
    hosts = ["http://one.example.test/p", "https://two.example.test", "http://other.fr/x", "nowhere", None]
    pages = [(i, r.choice(hosts), f'<html lang="{r.choice(langs)}"><p>{text(x, r.randint(1, 12))}</p>' if i % 3 else f"<p>{text(x, 2)}</p>") for i, x in enumerate(langs * 10)]
    grams = collections.defaultdict(collections.Counter)

    def codes(t):
        t = t.lower()
        cls = [int(language_id._TABLE[ord(c)]) for c in t]
        x = [0] * (language_id.ORDER - 1) + cls
        return [tuple(x[i : i + language_id.ORDER]) for i in range(len(cls))]

    for _, t, x, _ in docs:
        if x and t:
            grams[x].update(codes(t))
    cells = language_id.CLASSES**language_id.ORDER * language_id.ALPHA

    def softmax(v):
        e = [math.exp(a - max(v)) for a in v]
        return [a / sum(e) for a in e]

    rows = []
    for i, t, x, source in docs:
        rows.append({"id": ("doc", i), "text": t or "", "declared": x, "host": source, "domain": None, "suffix": None})
    for i, url, page in pages:
        host = re.match(r"[a-z]+://([^/]+)", url or "")
        host = host and host[1]
        lang = re.match(r'<html lang="(..)', page)
        rows.append({"id": ("page", i), "text": re.sub("<[^>]*>", " ", page), "declared": lang and lang[1], "host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host and host.split(".")[-1]})
    for x in rows:
        found = codes(x["text"])
        part = [sum(math.log((grams[k][g] + language_id.ALPHA) / (grams[k].total() + cells)) for g in found) * (min(1, language_id.TEXT_GRAMS / len(found)) if found else 0) for k in langs]
        x["evidence"] = [a - max(part) for a in part]
        x["p"] = softmax(part)
    total = [sum(x["p"][k] for x in rows) for k in range(3)]
    floor = language_id.FLOOR
    base = [(a + floor) / (sum(total) + 3 * floor) for a in total]

    def count(key, value, but=None):
        return [max(0, sum(x["p"][k] for x in rows if x[key] == value) - (but["p"][k] if but else 0)) for k in range(3)]

    def likelihood(c):
        return [math.log((c[k] + floor * base[k]) / ((sum(c) + floor) * base[k])) for k in range(3)]

    want = {}
    for x in rows:
        prior = base
        for key in ("domain", "host"):
            if x[key] is not None:
                c = count(key, x[key], x)
                prior = [(c[k] + language_id.SMOOTHING * prior[k]) / (sum(c) + language_id.SMOOTHING) for k in range(3)]
        said = likelihood(count("declared", x["declared"]))
        tail = likelihood(count("suffix", x["suffix"], x)) if x["suffix"] is not None else [0] * 3
        post = softmax([x["evidence"][k] + math.log(prior[k]) + said[k] + tail[k] for k in range(3)])
        want[x["id"]] = (langs[post.index(max(post))], max(post))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    got = language_id.languages(d, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for x in got:
        lang, p = want[("doc", x["doc_id"]) if x["doc_id"] is not None else ("page", x["page_id"])]
        assert x["posterior"] == pytest.approx(p, abs=2e-3) and (x["language"] == lang or p < 0.52)


def test_language_id_odd_input(spark):
    docs, pages = "doc_id long, text string, lang string, source string, p string, evidence int", "page_id long, url string, html string, host string"
    d = spark.createDataFrame([(1, "the and", "en", None, "x", 1), (1, "the and", "en", None, "x", 1), (None, None, None, None, None, None), (2, "a" * 300_000, "en", "s", "x", 1)], docs)
    p = spark.createDataFrame([(None, None, None, None), (1, "http://h.x/", "", "h")], pages)
    got = language_id.languages(d, p)
    assert got.count() == 6 and {x["language"] for x in got.collect()} == {"en"}
    assert language_id.languages(d.where("false"), p).where("language is null").count() == 2 and language_id.languages(d, p.where("false")).count() == 4


def test_language_id_many_languages(spark):
    r = random.Random(3)
    names = [f"x{chr(97 + i)}" for i in range(18)]
    vocabulary = {name: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for name in names}
    docs = [(i, " ".join(r.choice(vocabulary[names[i % 18]]) for _ in range(30)), names[i % 18], "s") for i in range(72)]
    pages = spark.createDataFrame([(1, "http://a.b/", f"<p>{docs[17][1]}</p>")], "page_id long, url string, html string")
    got = language_id.languages(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), pages).collect()
    assert {x["doc_id"]: x["language"] for x in got if x["doc_id"] is not None} == {d[0]: d[2] for d in docs}
    assert [x["language"] for x in got if x["page_id"] == 1] == [names[17]]


def exact_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        score = [(-sum((a * b for a, b in zip(x, v)), 0.0), i) for i, x in rows if i != q and len(x) == len(v)]
        out[q] = [i for _, i in sorted(set(score))[:k]]
    return out


def test_neighbours_in_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    g = np.random.default_rng(3)
    rows = [(i, [float(v) for v in g.standard_normal(12)]) for i in range(500)] + [(1000 + i, [float(v) for v in g.standard_normal(5)]) for i in range(30)]
    rows += [(7, rows[7][1])] * 20 + [(2000, [1e200] + [0.0] * 11), (2001, [1e200, 1e199] + [0.0] * 10), (2002, [-3e199] + [1.0] * 11)]
    df = spark.createDataFrame([(i, v, "x", True) for i, v in rows], "vec_id long, embedding array<double>, shard string, asks boolean")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    once = list(dict(rows).items())
    want = exact_nearest(once, [x for x in once if x[0] % 20 == 0], 20)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.98 * sum(map(len, want.values()))
    assert got[2000][:1] == [2001] or set(got[2000][:2]) <= {2001, *want[2000][:3]}
    assert neighbours.nearest(df.where("false"), df).count() == 0 and neighbours.nearest(df, df.where("false")).count() == 0


def test_neighbours_prune(spark):
    """A shard's share that is scored, and the recall with it, on directions without structure."""
    g = np.random.default_rng(4)
    x = g.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard = neighbours.Shard(np.arange(6000), x, neighbours.TREES, neighbours.CANDIDATES, neighbours.SHARE)
    ids, near, _ = shard.ask(np.arange(0, 6000, 60), x[::60], 20)
    s = x[::60] @ x.T
    s[np.arange(100), np.arange(0, 6000, 60)] = -np.inf
    top = np.argsort(-s, axis=1)[:, :20]
    hits = sum(len(set(near[ids == 60 * i]) & set(top[i])) for i in range(100))
    assert hits >= 0.92 * 2000 and shard.scored <= 0.5 * 6000 * 100
