"""Lists and details of scraped HTML pages, by regular expressions over a column, and JSON fixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalise import page_text, strip_html
from .lineage import cut


def first_of(html: Column, tags: Sequence[str]) -> Column:
    """The text of the first element among tags, tried in order; null where there is none with text."""
    found = [F.nullif(strip_html(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)), F.lit("")) for t in tags]
    return F.coalesce(*found)


def links(html: Column) -> Column:
    """The addresses of all links, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))


def paragraphs(html: Column, longer: int = 20) -> Column:
    """Texts of paragraphs of more than so many characters, one a line."""
    each = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1)), strip_html)
    return F.array_join(F.filter(each, lambda x: F.length(x) > longer), "\n")


def details(pages: DataFrame, html: str = "html", titles: Sequence[str] = ("h1", "title"), bodies: Sequence[str] = ("article", "main", "body")) -> DataFrame:
    """pages with title, body, n_links and paragraphs; selectors are tried in order, the whole page's text comes last."""
    h = F.col(html)
    body = F.coalesce(first_of(h, bodies), page_text(h))
    return pages.select("*", first_of(h, titles).alias("title"), body.alias("body"), F.size(links(h)).alias("n_links"), paragraphs(h).alias("paragraphs"))


def listed(pages: DataFrame, most: int = 10, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, place, link: the links of the first pages of a list (by key)."""
    first = pages.orderBy(key).limit(most)
    return first.select(key, F.posexplode(links(F.col(html))).alias("place", "link"))


def absolute(base: Column, link: Column) -> Column:
    """A link as an address, seen from a page's address; its fragment goes."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/[^/]*)*/|[A-Za-z][A-Za-z0-9+.-]*://[^/]*$)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^/]*:)", 1), link))
    whole = whole.when(link.startswith("/"), F.concat(site, link)).when(link.startswith("#") | (link == ""), base).when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
    return F.regexp_replace(whole.otherwise(F.concat(folder, link)), "#.*$", "")


def resolved(redirects: DataFrame) -> DataFrame:
    """address, final, hops, looped of redirects(address, target): where a click on each address ends. An address with several
    targets goes to the smallest; one whose way never ends is looped and has no final address.

    Pointer doubling: in each round every address jumps as far as its target has come, so a chain of n takes log2(n) rounds,
    each a join and a checkpoint."""
    first = redirects.where("address is not null and target is not null").groupBy("address").agg(F.min("target").alias("target"))
    ends = first.select(F.col("target").alias("address")).distinct().join(first, "address", "left_anti")
    now = cut(first.select("address", F.col("target").alias("final"), F.lit(1).cast("long").alias("hops")))
    last = cut(ends.withColumn("ended", F.lit(True)))
    for _ in range(max(1, now.count()).bit_length() + 1):
        ahead = now.select(F.col("address").alias("final"), F.col("final").alias("__next"), F.col("hops").alias("__more"))
        moved = now.join(ahead, "final", "left")
        if moved.where("__next is not null").isEmpty():
            break
        now = cut(moved.select("address", F.coalesce("__next", "final").alias("final"), (F.col("hops") + F.coalesce("__more", F.lit(0))).alias("hops")))
    out = now.join(last.withColumnRenamed("address", "final"), "final", "left").withColumn("looped", F.col("ended").isNull())
    return out.select("address", F.when(~F.col("looped"), F.col("final")).alias("final"), F.when(~F.col("looped"), F.col("hops")).alias("hops"), "looped")


def followed(lists: DataFrame, pages: DataFrame, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", most: int = 10) -> DataFrame:
    """key, place, link, url, title, body, paragraphs: the detail pages behind the links of the first pages of a list, by their
    addresses and through redirects; links whose page isn't there have none."""
    base = lists.select(key, F.col(url).alias("__base"))
    rows = listed(lists, most, key, html).join(base, key).select(key, "place", "link", absolute(F.col("__base"), F.col("link")).alias("address"))
    if redirects is not None:
        rows = rows.join(resolved(redirects).where("not looped").select("address", "final"), "address", "left").withColumn("address", F.coalesce("final", "address")).drop("final")
    found = details(pages.select(F.regexp_replace(url, "#.*$", "").alias("address"), F.col(html).alias("html")).dropDuplicates(["address"]), "html")
    return rows.join(found, "address", "left").select(key, "place", "link", F.col("address").alias("url"), "title", "body", "paragraphs")


def fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that holds an array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)
