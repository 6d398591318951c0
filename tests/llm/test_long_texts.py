"""Long and crafted texts take time in proportion to them, and callers' columns may have any names."""

import re
import time

import pytest
from pyspark.sql import functions as F

from eventloom.llm import html_text, language_id, pii

OLD_MARKUP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def test_markup_is_what_the_pattern_finds():
    import random

    r = random.Random(2)
    bits = ["<!--", "-->", "<script", "</script>", "</SCRIPT  >", "<style>", "</style", "<b>", "</b>", "<", ">", "a", " b ", "\n", "--", "<scripts>"]
    for _ in range(3000):
        page = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert language_id.without_markup(page) == OLD_MARKUP.sub(" ", page), page


@pytest.mark.parametrize("bit", ["<!--", "<script", "<script>", "</script", "<style ", "<", "<a ", "<!-- -->"])
def test_crafted_pages_are_linear(bit):
    began = time.time()
    language_id.without_markup(bit * ((1 << 20) // len(bit)))
    assert time.time() - began < 2


def test_many_spans_in_one_text(spark):
    """Four times the spans take about four times as long, not sixteen times."""
    times = []
    for n in (100, 4000, 16_000):
        text = " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = pii.spans(docs).first()
        times.append(time.time() - began)
        assert got["n_email"] == n
    assert times[2] - times[0] < 8 * max(1, times[1] - times[0])


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 256, 300])
def test_matches_by_chunks(spark, n):
    text = "ü " + " é ".join(f"a{i}@b.cd" for i in range(n)) + " end"
    got = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(pii.matches(F.col("text"), pii.EMAIL).alias("m")).collect()
    assert [(x["start"], x["end"], x["value"]) for x in got[0]["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert not got[1]["m"] and not got[2]["m"]


def test_spans_outside_others(spark):
    import random

    r, rows = random.Random(6), []
    for _ in range(400):
        at, found = 0, []
        while at < 40 and r.random() < 0.9:
            at += r.randint(0, 4)
            end = at + r.randint(1, 5)
            found.append((at, end, "f"))
            at = end
        starts = [r.randint(0, 45) for _ in range(r.randint(0, 5))]
        rows.append((found, [(a, a + r.randint(1, 9), "b") for a in starts]))
    kind = "array<struct<start:int,end:int,value:string>>"
    got = spark.createDataFrame(rows, f"f {kind}, b {kind}").select("f", "b", pii.outside(F.col("f"), F.col("b")).alias("x")).collect()
    for row in got:
        assert [tuple(x) for x in row["x"]] == [tuple(x) for x in row["f"] if not any(x["start"] < y["end"] and y["start"] < x["end"] for y in row["b"])]


def test_parts_of_a_text(spark):
    text = "".join(chr(97 + i % 26) if i % 5 else "é😀"[i % 2] for i in range(9000))
    at = [(0, 10), (4090, 10), (4095, 1), (4096, 5000), (8990, 100), (0, 9000), (8999, 1), (9000, 5), (5000, 0)]
    rows = spark.createDataFrame([(text, a, n) for a, n in at], "t string, a int, n int")
    assert [x[0] for x in rows.select(pii.part(pii.pieces(F.col("t")), F.col("a"), F.col("n"))).collect()] == [text[a : a + n] for a, n in at]


def test_sanitised_long_text_and_odd_columns(spark):
    n = 700
    text = " ".join(f"x{i}@y.org z +1 555 000 {1000 + i}" for i in range(n))
    docs = spark.createDataFrame([(1, text, 5, "k", 1), (2, "a plain text", 12, "k", 2), (3, None, None, None, None)], "doc_id long, text string, n_chars long, `a.b` string, __row int")
    got = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert got[1]["text"] == " ".join(["[EMAIL] z [PHONE]"] * n) and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["a.b"] == "k" and got[1]["__row"] == 1
    assert got[2]["text"] == "a plain text" and got[3]["text"] is None and pii.sanitise(docs).columns == docs.columns


def text_of(page):
    return html_text.main_text(page)


def test_topics_that_are_named_like_boilerplate():
    body = "This is the long first paragraph of the article, with enough words to be one."
    assert text_of(f'<article><div class="alert-system-review"><p>{body}</p></div></article>') == body
    page = f'<article><h2 class="share-price">Share price</h2><p>{body}</p><div class="tags-explained"><p>{body} Again.</p></div></article>'
    assert text_of(page) == f"Share price\n{body}\n{body} Again."
    whole = f'<article><div class="notice"><p>{body}</p><p>{body}</p></div></article>'
    assert text_of(whole) == f"{body}\n{body}"
    for name in ("share-buttons", "related-posts", "ad-slot-3", "newsletter-signup", "promo", "cookie-bar", "social-share"):
        assert text_of(f'<article><p>{body}</p><p>{body}</p><div class="{name}"><p>Some words that are not of it.</p></div></article>') == f"{body}\n{body}", name
