"""What goes together or not at all: commits, constraints, keyed state; and redirects, by hand and by brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import catalog, constraints, text, upsert
from eventloom.sources import pages
from eventloom.sources.tables import Conflict, Tables
from eventloom.streaming import webhook


def test_commits_are_whole(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    assert t.version() == 0
    with pytest.raises(KeyError):
        t.read("a")
    a, b = spark.range(3), spark.createDataFrame([("x", None)], "`k.1` string, v array<int>")
    assert t.commit({"a": a, "b": b}) == 1
    assert t.commit({"a": spark.range(3, 5)}, append=["a"], marks={"s": 7}) == 2
    assert [r[0] for r in t.read("a").orderBy("id").collect()] == [0, 1, 2, 3, 4] and t.read("a", 1).count() == 3
    assert t.read("b").columns == ["k.1", "v"] and t.manifest()["marks"] == {"s": 7}
    # a writer that dies between two tables leaves the old version
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        t.commit({"b": spark.createDataFrame([("y", None)], "`k.1` string, v array<int>"), "a": broken})
    assert t.version() == 2 and t.read("b").first()["k.1"] == "x" and t.read("a").count() == 5
    # of two writers from one version, one is told
    assert t.commit({"a": spark.range(1)}, base=2) == 3
    with pytest.raises(Conflict):
        t.commit({"a": spark.range(9)}, base=2)
    assert t.read("a").count() == 1 and [f.name for f in (tmp_path / "t/commits").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")] == []
    t.clean(keep=1)
    assert t.read("a").count() == 1 and t.read("b").count() == 1
    assert sum(1 for f in (tmp_path / "t/data/a").iterdir()) == 1


def test_save_batch(spark):
    event = "id string, title string, created int, words string"
    tables = {"Event": spark.createDataFrame([("1", "a", 0, "wa"), ("2", "b", 0, "wb")], event), "EventSkill": spark.createDataFrame([("s1", "1"), ("s2", "1"), ("s3", "2")], "name string, eventId string")}
    new = spark.createDataFrame([("1", "A", 9), ("3", "C", 9), ("3", "D", 9)], "id string, title string, created int")
    skills = spark.createDataFrame([("n1", "1"), ("n9", "9")], "name string, eventId string")
    got = upsert.save_batch(tables, new, ["title", "words"], lambda r: r.withColumn("words", F.concat(F.lit("w"), "title")), {"EventSkill": ("eventId", skills)})
    assert sorted(tuple(r) for r in got["Event"].collect()) == [("1", "A", 0, "wA"), ("2", "b", 0, "wb"), ("3", "C", 9, "wC")]
    assert sorted(tuple(r) for r in got["EventSkill"].collect()) == [("n1", "1"), ("s3", "2")]


def catalogue(spark):
    def t(rows, kind):
        return spark.createDataFrame(rows, kind)

    return {
        "Organization": t([("o1",), ("o2",)], "id string"), "Event": t([("e1", "o1"), ("e2", "o1"), ("e3", None)], "id string, organizationId string"),
        "EventSkill": t([("k1", "e1"), ("k2", "e2"), ("k3", "e3"), ("k4", None)], "id string, eventId string"), "User": t([("u1", "a"), ("u2", "a"), ("u3", None), ("u4", None)], "id string, email string"),
        "Bookmark": t([("b1", "u1", "e1"), ("b2", "u2", "e1"), ("b3", "u2", "e3"), ("b4", "u1", "e3")], "id string, userId string, eventId string"), "Session": t([("s1", "u2")], "id string, userId string"),
    }


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


def test_deletes_reach_children(spark):
    tables, event = catalogue(spark), lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    left = constraints.delete_cascade(tables, {"Event": event("e1", "e9"), "User": event("u2")})
    assert {t: ids(rows) for t, rows in left.items()} == {"Event": ["e2", "e3"], "EventSkill": ["k2", "k3", "k4"], "User": ["u1", "u3", "u4"], "Bookmark": ["b4"], "Session": []}
    with pytest.raises(ValueError, match="Event.organizationId"):
        constraints.delete_cascade(tables, {"Organization": event("o1")})
    # what goes in the same delete forbids nothing
    left = constraints.delete_cascade(tables, {"Organization": event("o1"), "Event": event("e1", "e2")})
    assert ids(left["Organization"]) == ["o2"] and ids(left["Event"]) == ["e3"] and ids(left["EventSkill"]) == ["k3", "k4"]
    order = constraints.parents_first()
    assert all(order.index(p) < order.index(t) for t, refs in schemas.REFERENCES.items() for p in refs.values()) and set(order) == set(schemas.TABLES)
    with pytest.raises(ValueError, match="each other"):
        constraints.parents_first({"a": {"x": "b"}, "b": {"y": "a"}})


def test_deletes_with_repeated_keys(spark):
    """Rows are told apart by their own references, not by a key that others share."""
    rows = {"parent": spark.createDataFrame([(1,), (2,)], "id int"), "child": spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, None, "c"), (8, 2, "d")], "id int, of int, name string")}
    left = constraints.delete_cascade(rows, {"parent": spark.createDataFrame([(1,)], "id int")}, {"child": {"of": "parent"}}, [])
    assert sorted(r["name"] for r in left["child"].collect()) == ["b", "c", "d"] and [r[0] for r in left["parent"].collect()] == [2]
    left = constraints.delete_cascade(rows, {"child": spark.createDataFrame([(7,)], "id int")}, {"child": {"of": "parent"}}, [])
    assert [r["name"] for r in left["child"].collect()] == ["d"] and list(left) == ["child"]


def test_unique(spark):
    rows = [tuple(r) for r in constraints.unique_violations(catalogue(spark) | {"Category": spark.createDataFrame([("c",)] * 3, "name string")}, {"User": [["email"], ["id"]], "Category": [["name"]], "Speaker": [["x"]]}).collect()]
    assert sorted(rows) == [("Category(name)", "c", 3), ("User(email)", "a", 2)]


def test_callers_columns_have_any_names(spark):
    rows = spark.createDataFrame([(1, 5, "x", "p"), (1, 6, "y", "q"), (2, 1, "z", "r")], "k int, __n int, `a.b` string, __hit string")
    assert sorted(tuple(r) for r in upsert.keep_newest(rows, "k", F.desc("__n")).collect()) == [(1, 6, "y", "q"), (2, 1, "z", "r")]
    assert sorted(tuple(r) for r in upsert.insert_if_absent(rows.where("k = 2"), rows, ["k"]).collect()) == [(1, 5, "x", "p")]
    assert sorted(tuple(r) for r in upsert.inserted(rows.where("k = 2"), rows, ["k"]).collect()) == [(1, 5, "x", "p", True), (1, 6, "y", "q", False), (2, 1, "z", "r", False)]
    assert upsert.insert_if_absent(rows, rows.limit(0), ["a.b"]).columns == rows.columns
    new = spark.createDataFrame([(2, "Z", 9), (3, "N", 8)], "k int, `a.b` string, __n int")
    one = rows.where("__n <> 5")
    assert sorted(tuple(r) for r in upsert.upsert(one, new, "k", ["a.b"]).collect()) == [(1, 6, "y", "q"), (2, 1, "Z", "r"), (3, 8, "N", None)]
    assert sorted(tuple(r) for r in upsert.update_supplied(one, new, "k").collect()) == [(1, 6, "y", "q"), (2, 9, "Z", "r")]
    assert sorted(tuple(r) for r in catalog.marked(one, "k", new, "k").collect()) == [(1, 6, "y", "q", False), (2, 1, "z", "r", True)]
    assert sorted(tuple(r) for r in catalog.spread(one, new.withColumnRenamed("__n", "__there"), "k").collect()) == [(1, 6, "y", "q", None), (2, 1, "Z", "r", 9)]
    got = text.placed(rows, "k", "__n").orderBy("k", "__n").collect()
    assert [(r["__n"], r["a.b"], r["place"], r["linear"]) for r in got] == [(5, "x", 1, 1.0), (6, "y", 2, 0.5), (1, "z", 1, 1.0)]
    none = spark.createDataFrame([(None, 1)], "k int, v int")
    assert upsert.insert_if_absent(none, none, ["k"]).count() == 1 and upsert.inserted(none, none, ["k"]).first()["is_new"]


def test_redirects(spark):
    r = random.Random(8)
    pairs = [(f"n{r.randint(0, 60)}", f"n{r.randint(0, 90)}") for _ in range(55)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("self", "self"), (None, "x"), ("x", None), ("p", "q"), ("q", "p")]
    to: dict[str, str] = {}
    for a, b in pairs:
        if a and b:
            to[a] = min(b, to.get(a, b))

    def walk(a):
        at, seen, hops = to[a], {a}, 1
        while at in to and at not in seen:
            seen.add(at)
            at, hops = to[at], hops + 1
        return (a, None, None, True) if at in to else (a, at, hops, False)

    got = pages.resolved(spark.createDataFrame(pairs, "address string, target string")).collect()
    assert sorted((x["address"], x["final"], x["hops"], x["looped"]) for x in got) == sorted(map(walk, to), key=lambda x: x[0])
    assert pages.resolved(spark.createDataFrame([], "address string, target string")).count() == 0


def test_links_are_followed(spark):
    joins = [("http://a.org/x/y.html?q#f", link) for link in ("z", "/z", "//b.org/z", "https://c.org/d#e", "#top", "?n=1", "")] + [("http://a.org", "z")]
    got = spark.createDataFrame(joins, "b string, l string").select(pages.absolute(F.col("b"), F.col("l"))).collect()
    assert [x[0] for x in got] == ["http://a.org/x/z", "http://a.org/z", "http://b.org/z", "https://c.org/d", "http://a.org/x/y.html?q", "http://a.org/x/y.html?n=1", "http://a.org/x/y.html?q", "http://a.org/z"]
    lists = spark.createDataFrame([(1, "http://a.org/list", '<a href="/one">1</a><a href="go">2</a><a href="/gone">3</a>')], "page_id int, url string, html string")
    details = spark.createDataFrame([("http://a.org/one#x", "<h1>One</h1><main>First body</main>"), ("http://b.org/two", "<h1>Two</h1>"), ("http://b.org/two", "<h1>Two</h1>")], "url string, html string")
    hops = spark.createDataFrame([("http://a.org/go", "http://a.org/hop"), ("http://a.org/hop", "http://b.org/two")], "address string, target string")
    got = pages.followed(lists, details, hops).orderBy("place").collect()
    assert [(x["place"], x["url"], x["title"], x["body"]) for x in got] == [(0, "http://a.org/one", "One", "First body"), (1, "http://b.org/two", "Two", "Two"), (2, "http://a.org/gone", None, None)]


def change(user, action, event, at):
    return {"type": "postback", "timestamp": at, "source": {"userId": user}, "postback": {"data": f"action={action}&eventId={event}"}, "message": None}


def test_bookmarks_are_keyed_state(spark, tmp_path):
    """Replayed, repeated and late batches give one state."""
    source, root = tmp_path / "in", str(tmp_path / "marks")
    source.mkdir()
    batches = [
        [change("u", "bookmark", "1", 1000), change("u", "bookmark", "1", 1000), change("v", "bookmark", "2", 2000), change("w", "unbookmark", "4", 1), change(None, "bookmark", "3", 1), {"type": "follow", "timestamp": 5, "source": {"userId": "w"}}],
        [change("v", "unbookmark", "2", 3000), change("u", "unbookmark", "1", 500), change("w", "bookmark", "4", 9)],
        [change("v", "bookmark", "2", 2500), change("u", "bookmark", "1", 1000), change("w", "unbookmark", "4", 9)],
    ]
    for n, events in enumerate(batches):
        (source / f"{n}.json").write_text(json.dumps({"events": events}))
        webhook.bookmark_job(spark, str(source), root, str(tmp_path / "cp")).awaitTermination(180)
    tables = Tables(spark, root)
    before = tables.version()
    webhook.bookmark_job(spark, str(source), root, str(tmp_path / "cp")).awaitTermination(180)
    assert tables.version() == before
    # all changes in one batch, and from an empty checkpoint again: the same state
    webhook.bookmark_job(spark, str(source), str(tmp_path / "other"), str(tmp_path / "cp2")).awaitTermination(180)
    want = {("u", "1", "bookmark", 1000), ("v", "2", "unbookmark", 3000), ("w", "4", "unbookmark", 9)}
    for t in (tables, Tables(spark, str(tmp_path / "other"))):
        got = {(r["user"], r["event_id"], r["route"], int(r["ms"])) for r in webhook.newest(t.read("bookmarks")).withColumn("ms", F.unix_millis("at")).collect()}
        assert got == want and [tuple(r) for r in webhook.bookmarks(t).collect()] == [("u", "1")]


def test_a_batch_that_is_tried_again_adds_nothing(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    at = dt.datetime(2025, 1, 1)
    for n in range(6):
        rows = spark.createDataFrame([("u", str(n % 2), "bookmark" if n < 4 else "unbookmark", at + dt.timedelta(hours=n))], webhook.CHANGE)
        for _ in range(2):
            webhook.apply_bookmarks(t, rows, n, most=3)
    assert t.version() == 6 and len(t.manifest()["tables"]["bookmarks"]["folders"]) <= 3
    assert webhook.bookmarks(t).count() == 0 and webhook.newest(t.read("bookmarks")).count() == 2
    assert webhook.bookmarks(t, version=4).count() == 2
