"""What the queries can't compare with SQL: graph rankings by brute force, the event API over HTTP, streams, file sinks."""

import itertools
import json
import math
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import providers, schemas
from eventloom.functions import semantics as S
from eventloom.operators import catalog, classify, extractors, graphs, payloads, upsert
from eventloom.plans import recommend
from eventloom.sources import event_api, pages


def slow_linkage(sim, least):
    clusters = [[i] for i in range(len(sim))]
    while len(clusters) > 1:
        best, at = 0, None
        for i, j in itertools.combinations(range(len(clusters)), 2):
            mean = sum(sim[a][b] for a in clusters[i] for b in clusters[j]) / (len(clusters[i]) * len(clusters[j]))
            if mean > best + 1e-12 and mean >= least:
                best, at = mean, (i, j)
        if at is None:
            break
        i, j = at
        joined = clusters[i] + clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in at] + [joined]
    return clusters


def test_average_linkage():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 9)
        sim = np.zeros((n, n))
        for i, j in itertools.combinations(range(n), 2):
            sim[i, j] = sim[j, i] = r.random()
        assert graphs.average_linkage(sim, 0.3) == slow_linkage(sim, 0.3)


def test_page_rank_by_matrix():
    r = np.random.default_rng(2)
    w = r.random((7, 7)) * (r.random((7, 7)) < 0.4)
    np.fill_diagonal(w, 0)
    i, j = np.nonzero(w)
    s, out = np.ones(7), w.sum(1)
    for _ in range(50):
        new = np.array([0.15 + 0.85 * sum(w[a, b] / out[a] * s[a] for a in range(7) if w[a, b] > 0) for b in range(7)])
        moved, s = np.abs(new - s).max(), new
        if moved < 1e-4:
            break
    assert np.allclose(graphs.page_rank(7, i, j, w[i, j]), s)


def test_string_similarities():
    assert graphs.jaro_winkler("martha", "marhta") == pytest.approx(0.9611111)
    assert graphs.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133333)
    assert graphs.jaro_winkler("a", "b") == 0 and graphs.jaro_winkler("", "x") == 0 and graphs.jaro_winkler("ab", "ab") == 1
    assert graphs.edit_similarity("kitten", "sitting") == pytest.approx(1 - 3 / 7) and graphs.edit_similarity("", "a") == 0
    r = random.Random(3)
    for _ in range(100):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(2))
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert graphs.edit_similarity(a, b) == pytest.approx(1 - d[-1][-1] / max(len(a), len(b)))


def test_overlaps():
    sets = [{"a", "b"}, {"b", "c"}, {"d"}, set(), {"a", "b"}]
    got = {(int(i), int(j)): float(x) for i, j, x in zip(*graphs.overlaps(sets), strict=True)}
    want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.permutations(enumerate(sets), 2) if a & b}
    assert got == pytest.approx(want)


def test_topic_rank_by_hand():
    # two runs that never cluster: one edge, 1 / distance either way, so both keep a score of 1
    got = graphs.topic_rank(["aaaa", "zzzz"], longest=1)
    assert [x[0] for x in got] == ["aaaa", "zzzz"] and got[0][1] == pytest.approx(1) and got[1][1] == pytest.approx(1)
    assert graphs.topic_rank(["only"], longest=1) == [("only", 1.0)] and graphs.topic_rank([]) == []
    # like words make one topic, named by its most frequent candidate
    got = graphs.topic_rank(["runner", "running", "zebra", "running"], longest=1)
    assert [x[0] for x in got] == ["zebra", "running"]  # one edge between two topics: equal scores, and a merged topic comes last


def test_multipartite_by_hand():
    s = ["first sentence of all", "x" * 60, "y" * 100]
    # no shared keywords: no edges, so by number of keywords
    assert [x[0] for x in graphs.multipartite_rank(s, [["a"], ["b", "c"], ["d"]], [0, 1, 2])] == [s[1], s[0], s[2]]
    # Jaccard 1/7 and 1/7: under 0.25, three topics; edges 0-1 (distance 1) and 0-2 (distance 2)
    keys = [["a", "b", "c", "d"], ["a", "e", "f", "g"], ["b", "h", "i", "j"]]
    got = dict(graphs.multipartite_rank(s, keys, [0, 1, 2]))
    i, j, w = np.array([0, 1, 0, 2]), np.array([1, 0, 2, 0]), np.array([1 / 7, 1 / 7, 1 / 14, 1 / 14])
    want = graphs.page_rank(3, i, j, w, 100, 1e-6)
    assert got == pytest.approx({t: float(x) for t, x in zip(s, want, strict=True)})
    # two alike sentences are one topic: edges into its first gain what the second gives
    keys = [["a", "b", "c"], ["a", "b", "d"], ["c", "d", "e", "f", "g", "h"]]
    got = dict(graphs.multipartite_rank(s, keys, [0, 1, 2]))
    order = [2, 0, 1]  # the cluster goes to the end
    edges = {(1, 0): (1 / 8) / 2, (0, 1): (1 / 8) / 2, (2, 0): 1 / 8, (0, 2): 1 / 8}
    edges[0, 1] += 1.1 * math.exp(1 / 1) * edges[2, 0]
    i, j = (np.array(x) for x in zip(*edges, strict=True))
    scores = graphs.page_rank(3, i, j, np.array(list(edges.values())), 100, 1e-6)
    assert got == pytest.approx({s[k]: float(x) for k, x in zip(order, scores, strict=True)})
    assert graphs.multipartite_rank([], [], []) == []


TEXTS = [
    (1, "Python courses teach code. Python code is read here every day! Nothing else matters at all? Python courses are read."),
    (2, None), (3, ""), (4, "short"), (5, "One sentence that is long enough to count"),
    (6, "<b>Python</b> is here &amp; now for all. <i>Python</i> code is read by many. Zoom installs are not here now."),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def test_extractors_on_odd_texts(texts):
    for f, name in ((extractors.key_phrases, "phrases"), (extractors.key_sentences, "sentences"), (extractors.key_words, "keywords"), (extractors.summary_phrases, "phrases")):
        got = {x["id"]: list(x[name]) for x in f(texts, "id", "text").collect()}
        assert got.keys() == {1, 2, 3, 4, 5, 6} and got[2] == got[3] == []
        assert f is extractors.summary_phrases or all("<" not in y for x in got.values() for y in x)
    got = {x["id"]: x for x in extractors.event_key_data(texts, "id", "text").collect()}
    assert len(got) == 6 and len(got[1]["phrases"]) == 2 and got[5]["phrases"] == ["One sentence that is long enough to count"]
    for f in (extractors.tfidf_sentences, extractors.central_sentences, extractors.topic_words, extractors.multipartite_sentences, extractors.word_ranks):
        got = {x["id"]: x["found"] for x in f(texts, "id", "text").collect()}
        assert len(got) == 6 and got[2] == [] and got[3] == []
        assert f(texts.where("false"), "id", "text").count() == 0
    got = {x["id"]: x for x in extractors.staged(texts, "id", "text", clean=F.lower, shorten=lambda x: F.slice(x, 1, 1)).collect()}
    assert len(got[1]["phrases"]) == 1 and got[1]["ranked"][0].islower()


def test_central_sentences_drop_copies(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta. alpha beta gamma delta! epsilon alpha zeta eta. theta iota kappa lamda.")], "id long, text string")
    got = [x["text"] for x in extractors.central_sentences(df, "id", "text").first()["found"]]
    assert got == ["alpha beta gamma delta.", "epsilon alpha zeta eta.", "theta iota kappa lamda."]


def test_merge_and_weights(spark):
    df = spark.createDataFrame([(1, ["alpha beta", "gamma"], ["alpha betb", "new one", "gammas"]), (2, [], []), (3, ["x"], [])], "id long, a array<string>, b array<string>")
    got = {x["id"]: x for x in extractors.hybrid_merge(df, "id", "a", "b").collect()}
    assert [(x["text"], round(x["score"], 4), x["source"]) for x in got[1]["found"]] == [("alpha beta", 1.0, "both"), ("gamma", 0.4333, "both"), ("new one", 0.2667, "ai")]
    assert got[1]["confidence"] == pytest.approx(0.7 * 2 / 3 + 0.3 * 3 / 8) and got[2]["confidence"] == 0 and got[3]["confidence"] == pytest.approx(0.3 / 8)
    row = spark.range(1).select(classify.weight(F.lit("location"), classify.PHRASE_WEIGHTS, 0.5), classify.weight(F.lit("location"), classify.PHRASE_WEIGHTS, 0.5, True), classify.phrase_category(F.lit("渋谷のPython講座")), classify.phrase_category(F.lit("オンライン Python")), classify.keyword_category(F.lit("東京")), classify.sentence_type(F.lit("初心者向けReact"))).first()
    assert tuple(row) == (0.5, 0.0, "location", "technology", "other", "contextual")
    rows = [[("Heavy phrase one", 0.2), ("heavy phrase ones", 0.9), ("Other", 0.5)]]
    items = spark.createDataFrame([(r,) for r in rows], "x array<struct<text:string,weighted:double>>")
    got = items.select(extractors.by_weight(extractors.drop_alike(F.col("x"), 0.8))).first()[0]
    assert [x["text"] for x in got] == ["heavy phrase ones", "Other"]
    assert list(spark.range(1).select(extractors.pad(F.array(F.lit("a")), F.array(*map(F.lit, "abcd")))).first()[0]) == ["a", "b", "c"]


# sources


class Api(BaseHTTPRequestHandler):
    asked: list = []
    times: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Api.asked.append((q, self.headers["X-API-Key"]))
        Api.times.append(time.time())
        start, count = int(q["start"]), int(q["count"])
        events = [{"id": i, "title": f"t{i}", "started_at": "2025-01-01T10:00:00+09:00", "place": "東京", "owner": {"id": 1, "nickname": "n", "display_name": "d"}, "group": None, "tags": ["a"]} for i in range(start, min(start + count, 8))]
        if start > 1 and events:
            events.append({"id": 1, "title": "t1"})  # a row that moved between pages
        body = json.dumps({"total": 7, "events": events}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_event_api(spark):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(event_api.EventApi)
        url = f"http://127.0.0.1:{server.server_port}/events"
        rows = spark.read.format("event_api").options(url=url, key="k", count="3", limit="9", pause="0", keyword="x,y").load()
        assert sorted(x["id"] for x in event_api.distinct_pages(rows).collect()) == [1, 2, 3, 4, 5, 6, 7]
        assert [x["id"] for x in event_api.distinct_pages(rows, 2).collect()] == [1, 2]
        assert {q["start"] for q, _ in Api.asked} == {"1", "4", "7"} and all(q["keyword"] == "x,y" and k == "k" for q, k in Api.asked)
        got = rows.where("id = 2").first()
        assert got["owner"]["nickname"] == "n" and got["group"] is None and list(got["tags"]) == ["a"] and got["url"] is None
    finally:
        server.shutdown()
    with pytest.raises(Exception, match="url and key"):
        spark.read.format("event_api").load().count()


def test_a_pull_stops_and_waits(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = {"url": f"http://127.0.0.1:{server.server_port}/events", "key": "k", "count": "3", "limit": "30", "places": "tokyo,online", "pause": "0.2", "place_pause": "0.4"}
    # 7 events a place: three pages, and an empty one that ends it
    want = [(p, str(s)) for p in ("tokyo", "online") for s in (1, 4, 7, 10)]
    try:
        spark.dataSource.register(event_api.EventApi)
        Api.asked.clear(), Api.times.clear()
        rows = spark.read.format("event_api").options(**options).load().select("id").collect()
        assert [(q["prefectures"], q["start"]) for q, _ in Api.asked] == want and sorted({r["id"] for r in rows}) == [1, 2, 3, 4, 5, 6, 7]
        gaps = np.diff(Api.times)
        assert (gaps >= 0.19).all() and gaps[3] >= 0.39
        # as a stream: three requests a batch, from where the last one ended
        Api.asked.clear(), Api.times.clear()
        got, batches = [], []

        def keep(df, n):
            ids = [r["id"] for r in df.select("id").collect()]
            got.extend(ids)
            batches.append(len(ids))

        stream = spark.readStream.format("event_api").options(**options, budget="3").load()
        job = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        end = time.time() + 90
        while time.time() < end and not (len(got) >= 18 and len(Api.asked) >= 8):
            time.sleep(0.2)
        job.stop()
        assert [(q["prefectures"], q["start"]) for q, _ in Api.asked[:8]] == want and len(Api.asked) == 8
        assert sorted(set(got)) == [1, 2, 3, 4, 5, 6, 7] and (np.diff(Api.times) >= 0.19).all() and len(batches) >= 3
    finally:
        server.shutdown()


def test_by_id_as_the_catalogue_does(spark):
    kind = "id bigint, title string, catch string, description string, address string, started_at string, updated_at string"
    rows = spark.createDataFrame([(i, "t", "", "", "", "2025-01-01", f"2025-01-{10 + i}") for i in range(1, 6)], kind)
    assert event_api.by_id(rows, 2).count() == 1 and event_api.by_id(rows, 4, 2).count() == 1 and event_api.by_id(rows, 2, 2).count() == 0


def test_recorded_pages(spark, tmp_path):
    def record(i, place, day, title="Python night"):
        return {"id": i, "title": title, "catch": "c", "description": "<p>d</p>", "url": f"u{i}", "started_at": f"{day}T19:00:00+09:00", "ended_at": None, "place": place, "address": "京都府京都市" if i == 3 else None, "tags": ["hackathon"] if i == 2 else [], "owner": {"id": 1, "nickname": "o"}, "group": {"id": 5}}

    (tmp_path / "1.json").write_text(json.dumps({"total": 4, "events": [record(1, "オンライン", "2025-03-01"), record(2, "渋谷", "2025-03-05")]}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"events": [record(3, "会館", "2025-03-09", "Go"), record(4, None, "2025-06-01")]}))
    rows = event_api.recorded(spark, str(tmp_path))

    def ids(df):
        return [x["id"] for x in df.select("id").orderBy("id").collect()]

    assert ids(event_api.searched(rows, event_api.search_options(["python"], start="2025-03-01", end="2025-03-31"))) == [1, 2]
    assert ids(event_api.searched(rows, event_api.search_options(any_of=["GO", "zzz"], order=9))) == [3]
    assert ids(event_api.searched(rows, event_api.search_options(order=2, count=2, offset=1))) == [2, 3]
    assert ids(event_api.searched(rows, {"prefectures": "kyoto"})) == [3] and ids(event_api.searched(rows, {"nickname": "o", "group_id": "5", "tag": "hackathon"})) == [2]
    assert ids(event_api.by_id(rows, 4)) == [4] and ids(event_api.searched(rows, event_api.upcoming("2025-03-02", 10))) == [2, 3]
    assert ids(event_api.for_place(rows, "京都府", "2025-03-01")) == [1, 3] and ids(event_api.for_place(rows, None, "2025-03-01")) == [1]
    (tmp_path / "fixture.json").write_text(json.dumps([{"id": "1", "keywords": ["a"]}, {"id": "2"}]))
    assert pages.fixture(spark, str(tmp_path / "fixture.json"), "id string, keywords array<string>").count() == 2


def test_page_details(spark):
    df = spark.createDataFrame([(1, "<title>T</title><body><h1></h1><main><p>" + "x" * 30 + "</p><p>short</p></main><a href='u'>l</a>"), (2, None), (3, "plain")], "page_id long, html string")
    got = {x["page_id"]: x for x in pages.details(df).collect()}
    assert (got[1]["title"], got[1]["n_links"], got[1]["paragraphs"]) == ("T", 1, "x" * 30) and got[1]["body"].startswith("xxx") and got[2]["title"] is None and got[3]["body"] == "plain"


# writes, payloads, streams


def test_writes(spark, tmp_path):
    t = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert [tuple(x) for x in upsert.delete_one(t, a=1, b=2).collect()] == [(3, 4)]
    with pytest.raises(KeyError):
        upsert.delete_one(t, a=1, b=3)
    rest, gone = upsert.delete_count(t, F.col("a") > 9)
    assert rest.count() == 2 and gone.first()[0] == 0
    payloads.write_json(t, str(tmp_path / "j"), "a")
    assert {x["a"] for x in spark.read.json(str(tmp_path / "j")).collect()} == {1, 3}
    payloads.write_texts(spark.createDataFrame([(1, "x\ny"), (2, None)], "k int, t string"), str(tmp_path / "t"), "k", "t")
    assert spark.read.text(str(tmp_path / "t")).count() == 3
    names = {x: spark.createDataFrame([], ddl).columns for x, ddl in schemas.TABLES.items()}
    assert all(f in names[t] and p in names for t, refs in schemas.REFERENCES.items() for f, p in refs.items()) and len(names) == 12


def test_few_rows_are_not_ranked(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 3)) for i in range(12)], "id int, t string")
    some = F.array(F.lit("m"))
    assert {x["score"] for x in catalog.ranked_or_few(rows.limit(10), F.length("t"), some, "id").collect()} == {1}
    got = catalog.ranked_or_few(rows, F.length("t"), some, "id").collect()
    assert [x["id"] for x in got[:5]] == [2, 5, 8, 11, 1] and len(got) == 10


def test_scalars(spark):
    row = spark.range(1).select(S.query_string(F.lit("action=book%20it&eventId=7&empty")), S.is_document(F.lit("a b　c")), S.is_document(F.lit("a b")), S.is_document(F.lit(None).cast("string")), S.char_jaccard(F.lit(""), F.lit(""))).first()
    assert row[0] == {"action": "book it", "eventId": "7", "empty": ""} and list(row[1:]) == [True, False, False, 0.0]
    with pytest.raises(Exception, match="dimensions"):
        spark.range(1).select(S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    reply = spark.range(1).select(providers.listed_queries(F.lit("ok\n - a b \n-c\n- \n- d"))).first()[0]
    assert list(reply) == ["a b", "d"]


def test_interest_of_one_tag_and_of_many(spark):
    from eventloom.operators import vectors

    events = spark.createDataFrame([(1, ["python code", "rice"]), (2, []), (3, [" "]), (4, ["go", "code"])], "id long, w array<string>")
    tags, embed = spark.createDataFrame([("code",), ("rice",), ("",)], "tag string"), providers.hashed_embedding(16)
    for mode, pool in (("concat", "max"), ("per_keyword", "max"), ("per_keyword", "mean"), ("legacy", "max")):
        many = {(x["tag"], x["id"]): x["sim"] for x in vectors.interest_of_tags(tags, events, "id", "w", embed, mode, pool).collect()}
        for t in ("code", "rice", ""):
            one = {x["id"]: x["sim"] for x in vectors.interest(events, "id", "w", F.lit(t), embed, mode, pool).collect()}
            assert one == {i: pytest.approx(many[t, i]) for i in one} and one[2] == 0
    assert spark.range(1).select(vectors.similarity_to(F.lit("code"), F.lit("code"), embed), vectors.similarity_to(F.lit("code"), F.lit(" "), embed)).first()[:] == (pytest.approx(1), 0.0)


def test_recommendations(spark):
    events = spark.createDataFrame([(1, ["python code"], ["learn python code"], "python code night", "東京"), (2, ["go"], [], "go meeting", "オンライン"), (3, [], [], "cooking with rice", "大阪")], "id long, keyPhrases array<string>, keySentences array<string>, page string, location string")
    tags = spark.createDataFrame([("python code",), ("rice",)], "tag string")
    for mode in ("concat", "per_keyword"):
        got = recommend.by_tags(tags, events, modes=(mode,)).collect()
        assert [(x["tag"], x["id"], x["label"]) for x in got] == [("python code", 1, f"[mode:{mode}][fuse:weighted]")]
    users = spark.createDataFrame([("u", ["python code", "cooking rice"], ["go meeting"], "東京"), ("v", None, None, None)], "user string, tags array<string>, goals array<string>, place string")
    got = recommend.hyde(users, events.select("id", "page", "location"), least=0.5).collect()
    assert [(x["user"], x["id"], x["ord"]) for x in sorted(got, key=lambda x: x["ord"])] == [("u", 1, 1), ("u", 2, 2)]
    questions = spark.createDataFrame([(9, "rice cooking")], "query_id long, question string")
    assert recommend.context(questions, events, k=1).first()["context"] == "cooking with rice"
    assert spark.range(1).select(recommend.message_tag(F.lit("m"), F.array(F.lit("a"), F.lit("")))).first()[0] == "m・a"
    got = recommend.by_profile(users, events.select("id", "page"), ["page"])
    assert got.count() == 0  # three events: all have score 1, relevance 10


def test_tagged_tokens(spark):
    from eventloom.operators import text

    tags = [("新しい", "新しい", "形容詞", "自立"), ("技術", "技術", "名詞", "一般"), ("書", "書", "名詞", "接尾"), ("を", "を", "助詞", ""), ("読み", "読む", "動詞", "自立"), ("それ", "それ", "名詞", "代名詞"), ("!!", "", "記号", "一般"), ("技術", "技術", "名詞", "一般")]
    df = spark.createDataFrame([(tags,), ([],)], "t array<struct<surface:string,base:string,pos:string,detail:string>>")
    row = df.select(text.useful_tokens(F.col("t")), text.useful_tokens(F.col("t"), verbs=False), text.useful_tokens(F.col("t"), symbols=True), text.noun_phrases(F.col("t"))).first()
    assert [list(x) for x in row] == [["新しい", "技術", "読む", "技術"], ["新しい", "技術", "技術"], ["新しい", "技術", "読む", "!!", "技術"], ["新しい技術", "新しい技術書", "それ", "技術"]]


def test_stop_word_phrases(spark):
    from eventloom.operators import text

    row = spark.range(1).select(text.stop_word_phrases(F.lit("The quick brown fox, and a lazy dog of the very old farm house yard gate")), text.stop_word_phrases(F.lit(""))).first()
    assert list(row[0]) == ["quick brown fox", "lazy dog", "old farm house", "yard gate"] and list(row[1]) == []


def test_replies_and_cache(spark):
    reply = F.lit('text {"refined_keyphrases": [{"phrase": " a ", "score": 0}, {"phrase": ""}, {"phrase": "b", "score": 7}]} more')
    row = spark.range(1).select(providers.confident(providers.parsed(reply, "phrases"), "phrase"), providers.parsed(F.lit("no json"), "phrases"), providers.chosen(F.lit('x [{"id": "1", "reason": "r"}]'))).first()
    assert [tuple(x) for x in row[0]] == [("a", 0.5, 0.5), ("b", 7.0, 1.0)] and row[1] is None and row[2][0]["id"] == "1"
    texts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "id int, t string")
    cache = spark.createDataFrame([], "key string, reply string")
    asked = []

    def compute(rows):
        asked.append(rows.count())
        return rows.withColumn("reply", F.concat(F.lit("r"), F.coalesce("t", F.lit(""))))

    rows, cache = providers.cached(texts, cache, "t", compute)
    rows, cache = providers.cached(texts, cache, "t", compute)
    assert asked == [3, 0] and {x["id"]: x["reply"] for x in rows.collect()} == {1: "rx", 2: "ry", 3: "rx", 4: "r"}
    with pytest.raises(Exception, match="provider"):
        spark.range(1).select(providers.no_answer(F.lit("c"))).collect()


def test_defaults_and_sentinels(spark):
    from eventloom.operators import normalise, vectors

    df = spark.createDataFrame([(1, "A"), (2, "B")], "id int, kind string")
    assert catalog.by_type(df, "kind", None).count() == catalog.by_type(df, "kind", "すべて").count() == 2 and catalog.by_type(df, "kind", "x", {"x": "B"}).first()["id"] == 2
    lists = spark.createDataFrame([(1, 0.5, 1), (1, 0.4, 2)], "id int, sim double, rank int")
    assert vectors.fused(lists, "id", method="what").first()["score"] == pytest.approx(1 / 61 + 1 / 62)
    row = spark.range(1).select(normalise.event_type(F.lit("results"), F.array(F.lit("x"))), normalise.event_type(F.lit("a"), F.array(F.lit("Contest"))), normalise.event_type(F.lit("a"), F.array(F.lit("contests"))), normalise.event_format(F.lit("Meetup hall")), normalise.event_format(F.lit("ハイブリッド"))).first()
    assert tuple(row) == ("LIGHTNING_TALK", "CONTEST", "WORKSHOP", "ONLINE", "HYBRID")
    assert [x["w"] for x in df.limit(1).select(F.explode(normalise.tag_words(F.lit("a, b、a, ,c"))).alias("w")).collect()] == ["a", "b", "c"]


def test_jaro_winkler_of_all_pairs_is_that_of_each():
    r = random.Random(3)
    for n in [0, 1, 2, *[12] * 40]:
        texts = ["".join(r.choice("ab é"[: r.randint(1, 4)]) for _ in range(r.choice([0, 1, 3, 8, 62, 63, 64, 70]))) for _ in range(n)]
        got = graphs.jaro_winkler_pairs(texts)
        assert all(got[i, j] == got[j, i] == graphs.jaro_winkler(texts[j], texts[i]) for i in range(n) for j in range(i))


def test_topic_rank_takes_no_time_for_each_pair():
    """A hundred candidates have 4,950 pairs, which were compared one by one."""
    words = random.Random(5).choices([f"word{i}{'xyz' * (i % 2)}" for i in range(80)], k=400)
    calls = []
    before, graphs.jaro_winkler = graphs.jaro_winkler, lambda a, b: calls.append(1) or before(a, b)
    try:
        assert graphs.topic_rank(words, joiner=" ") and len(calls) < 1000
    finally:
        graphs.jaro_winkler = before


def test_ranking_takes_texts_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.createDataFrame([(1, "A first sentence of words. A second sentence of words.")], "doc_id int, text string")
        assert extractors.rank_sentences(docs, "doc_id", "text").count() == 1 and int(spark.conf.get(name)) == extractors.TEXTS
        spark.conf.set(name, "77")
        extractors.word_ranks(docs, "doc_id", "text")
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, before)


def test_overlaps_in_pieces_are_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 12, k).tolist()) for k in rng.integers(0, 6, 40)]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a & b}
    for square, pairs in ((4000, 1 << 20), (4000, 7), (0, 7), (0, 1 << 20)):
        monkeypatch.setattr(graphs, "SQUARE", square)
        monkeypatch.setattr(graphs, "PAIRS", pairs)
        i, j, x = graphs.overlaps(sets)
        assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), x.tolist(), strict=True)) == want
        assert (np.diff(i * len(sets) + j) > 0).all()
    assert [len(c) for c in graphs.overlaps([])] == [len(c) for c in graphs.overlaps([{"a"}, set()])] == [0, 0, 0]


def test_central_sentences_hold_no_table_of_sentences_by_words():
    """400 sentences of ten words of their own: a dense table took 13 MB, and was copied for each sentence that stayed."""
    import tracemalloc

    lists = [[f"w{i}x{k}" for k in range(10)] for i in range(400)]
    tracemalloc.start()
    row, word, weight = graphs.term_weights([*lists, ["a", "a", "b"]])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4e6 and len(row) == 4002 and abs(weight[-2] - 2 / 5**0.5) < 1e-12 and abs(weight[0] - 0.1**0.5) < 1e-12


def test_sentence_pairs_come_in_batches_of_many_texts(spark, monkeypatch):
    from eventloom.operators import text

    class Runs:
        """A table whose mapInPandas() gives back the function."""

        schema = spark.createDataFrame([], "id int, text string").schema

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    t = [[f"number{k}a", "common", "words"] for k in (1, 2)], None, [], [["x"]], [["y"], ["y"]]
    batch = text.pd.DataFrame({"id": range(5), "t": t})
    whole = list(text.sentence_pairs(Runs(), "id", "text")(iter([batch])))
    assert [tuple(x) for f in whole for x in f.itertuples(index=False)] == [(0, 0, 1, 0.5), (0, 1, 0, 0.5), (4, 0, 1, 1.0), (4, 1, 0, 1.0)]
    assert len(whole) == 1
    monkeypatch.setattr(text, "PAIRS", 1)
    assert [len(f) for f in text.sentence_pairs(Runs(), "id", "text")(iter([batch]))] == [2, 2]


def test_inserted_lists_need_no_parts(spark):
    from eventloom.plans import QUERIES

    plan = QUERIES["insert_nested"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "s_suppkey" not in plan
