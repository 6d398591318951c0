"""Queries of writes that go together, constraints, redirects and words of unspaced text; with their DuckDB forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import constraints, segment, text, upsert
from ..sources import pages as scraped
from ..sources.lineage import shared_folder
from ..sources.tables import Tables
from .catalog_queries import SENTENCE_A, SENTENCE_C, query, read

#: The columns that a batch updates in a known event.
UPDATED = [
    "title", "description", "eventDate", "startTime", "endTime", "venue", "address", "location", "detailUrl", "updatedAt", "format", "difficulty", "price", "eventType",
    "keywords", "keyPhrases", "keySentences",
]
EVENT_SQL = """SELECT doc_id::VARCHAR AS id, {0} || coalesce(source, '') AS title, text AS description, TIMESTAMP '2025-01-01' + to_days((doc_id % 300)::INT) AS eventDate, {1} AS startTime, '21:00' AS endTime, {0} || 'v' AS venue, source AS address, coalesce(lang, '不明') AS location,
  {0} || doc_id AS detailUrl, TIMESTAMP '{2}' AS createdAt, TIMESTAMP '{2}' AS updatedAt, {0} || 'f' AS format, 'BEGINNER' AS difficulty, (n_chars % 100)::INT AS price, {0} || 't' AS eventType"""


def _events(docs: DataFrame, mark: str, start: str, day: str) -> DataFrame:
    def said(c):
        return F.concat(F.lit(mark), c)

    at = F.lit(day).cast("timestamp_ntz")
    date = (F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00")) + F.make_dt_interval((F.col("doc_id") % 300).cast("int"))).cast("timestamp_ntz")
    cells = {
        "id": F.col("doc_id").cast("string"), "title": said(F.coalesce("source", F.lit(""))), "description": F.col("text"), "eventDate": date, "startTime": F.lit(start), "endTime": F.lit("21:00"),
        "venue": said(F.lit("v")), "address": F.col("source"), "location": F.coalesce("lang", F.lit("不明")), "detailUrl": said(F.col("doc_id").cast("string")), "createdAt": at, "updatedAt": at,
        "format": said(F.lit("f")), "difficulty": F.lit("BEGINNER"), "price": (F.col("n_chars") % 100).cast("int"), "eventType": said(F.lit("t")),
    }
    return docs.select(*[c.alias(name) for name, c in cells.items()])


def _key_data(events: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    words = F.filter(F.split("description", r"\s+"), lambda x: F.length(x) > 1)
    found = {"keywords": F.slice(words, 1, 5), "keyPhrases": F.slice(text.sentences(F.col("description"), "a"), 1, 2), "keySentences": F.slice(text.sentences(F.col("description"), "c"), 1, 2)}
    return events.select("*", *[F.coalesce(c, none).alias(name) for name, c in found.items()])


KEY_SQL = rf"""SELECT *, coalesce(array_to_string(list_filter(regexp_split_to_array(description, '\s+'), lambda x: length(x) > 1)[1:5], '|'), '') AS keywords, coalesce(array_to_string(({SENTENCE_A.replace("(text", "(description")})[1:2], '|'), '') AS keyPhrases,
  coalesce(array_to_string(({SENTENCE_C.replace("(text", "(description")})[1:2], '|'), '') AS keySentences"""
CELLS_SQL = ", ".join(f"CASE WHEN n.id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in UPDATED)


@query(f"""WITH b AS ({EVENT_SQL.format("'old '", "'18:00'", "2024-01-01")} FROM documents WHERE doc_id % 3 <> 0), c AS ({EVENT_SQL.format("'new '", "'19:00'", "2025-06-01")} FROM documents WHERE doc_id % 2 = 0),
  o AS ({KEY_SQL} FROM b), n AS ({KEY_SQL} FROM c) SELECT coalesce(o.id, n.id) AS id, {CELLS_SQL}, coalesce(o.createdAt, n.createdAt) AS createdAt,
  CASE WHEN n.id IS NOT NULL THEN 'new/' || coalesce(n.location, '') ELSE 'a,b' END AS skills, 2::BIGINT AS version FROM o FULL JOIN n ON n.id = o.id""")
def commit_batch(spark, d):
    """A batch of events over a table of them: key data extracted anew, 17 columns updated, children replaced, both tables
    committed as one and read back."""
    docs = read(spark, d, "documents")
    tables = Tables(spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}")
    old = _key_data(_events(docs.where("doc_id % 3 <> 0"), "old ", "18:00", "2024-01-01 00:00:00"))
    skills = old.select(F.col("id").alias("eventId"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    first = tables.commit({"Event": old, "EventSkill": skills})
    new = _events(docs.where("doc_id % 2 = 0"), "new ", "19:00", "2025-06-01 00:00:00")
    state = {name: tables.read(name, first) for name in ("Event", "EventSkill")}
    children = {"EventSkill": ("eventId", new.select(F.col("id").alias("eventId"), F.concat(F.lit("new/"), "location").alias("name")))}
    version = tables.commit(upsert.save_batch(state, new, UPDATED, _key_data, children), base=first)
    listed = tables.read("EventSkill", version).groupBy(F.col("eventId").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("skills"))
    rows = tables.read("Event", version).join(listed, "id", "left")
    joined = {c: F.array_join(c, "|") for c in ("keywords", "keyPhrases", "keySentences")}
    return rows.select("id", *[joined.get(c, F.col(c)).alias(c) for c in UPDATED], "createdAt", F.coalesce("skills", F.lit("")).alias("skills"), F.lit(version).cast("long").alias("version"))


REFERS = {"orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_suppkey": "supplier"}, "events": {"user_id": "customer", "event_id": "orders"}}
KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey", "events": "event_id", "lineitem": "id"}


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 5), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)),
  l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (FROM o) AND l_suppkey NOT IN (FROM s)), e AS (SELECT * FROM events WHERE user_id NOT IN (FROM c) AND event_id NOT IN (FROM o))
  SELECT 'customer' AS name, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey NOT IN (FROM c) UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT FROM supplier WHERE s_suppkey NOT IN (FROM s)
  UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey NOT IN (FROM o) UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM l UNION ALL SELECT 'events', count(*), sum(event_id)::BIGINT FROM e""")
def delete_cascade(spark, d):
    """Some customers and suppliers go, and with them all that refers to them, however far."""
    tables = {t: read(spark, d, t) for t in KEYS}
    tables["lineitem"] = tables["lineitem"].withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    gone = {"customer": tables["customer"].where("c_nationkey = 3"), "supplier": tables["supplier"].where("s_nationkey = 5")}
    left = constraints.delete_cascade(tables, gone, REFERS, [], KEYS)
    out = None
    for name, column in {**KEYS, "lineitem": "l_orderkey"}.items():
        row = left[name].agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(column).cast("long").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT 'part(p_name, p_brand, p_type)' AS "constraint", concat_ws('|', p_name, p_brand, p_type) AS key, count(*) AS times FROM part GROUP BY p_name, p_brand, p_type HAVING count(*) > 1
  UNION ALL SELECT 'orders(o_custkey, o_orderdate)', o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), count(*) FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1
  UNION ALL SELECT 'events(event_id)', event_id::VARCHAR, count(*) FROM events GROUP BY event_id HAVING count(*) > 1 UNION ALL SELECT 'conversations(role)', role, count(*) FROM conversations WHERE role IS NOT NULL GROUP BY role HAVING count(*) > 1""")
def unique_audit(spark, d):
    unique = {"part": [["p_name", "p_brand", "p_type"]], "orders": [["o_custkey", "o_orderdate"]], "events": [["event_id"]], "conversations": [["role"]]}
    return constraints.unique_violations({t: read(spark, d, t) for t in unique}, unique)


LINK_SQL = r"""regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)"""


@query(f"""WITH RECURSIVE l AS (SELECT page_id, unnest({LINK_SQL}) AS link, generate_subscripts({LINK_SQL}, 1) AS i FROM pages), r AS (SELECT a.link AS address, min(b.link) AS target FROM l a JOIN l b ON b.page_id = a.page_id AND b.i = a.i + 1 GROUP BY 1),
  w AS (SELECT address, target AS spot, [address] AS seen, 1 AS hops FROM r UNION ALL SELECT w.address, r.target, list_append(seen, w.spot), hops + 1 FROM w JOIN r ON r.address = w.spot WHERE NOT list_contains(seen, w.spot)),
  e AS (SELECT w.address, spot, hops FROM w WHERE spot NOT IN (SELECT address FROM r)) SELECT r.address, e.spot AS final, e.hops::BIGINT AS hops, e.spot IS NULL AS looped FROM r LEFT JOIN e ON e.address = r.address""")
def resolved_links(spark, d):
    """Where a click ends: each link of a page goes on to the page's next one."""
    found = read(spark, d, "pages").select("page_id", scraped.links(F.col("html")).alias("l"))
    pairs = found.select(F.explode(F.arrays_zip(F.col("l").alias("address"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("target"))).alias("x")).select("x.*")
    return scraped.resolved(pairs.where("target is not null"))


@query()
def segmented_words(spark, d):
    """Words of all texts with white space taken out of them, by a lattice fitted on those texts."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.translate(F.regexp_replace("text", r"\s+", ""), "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ").alias("text"))
    cut = segment.Segmenter(segment.fit(rows, "text", pieces=2000, rounds=2))
    return rows.select("conv_id", "turn", F.array_join(cut(F.col("text")), " ").alias("words"))
