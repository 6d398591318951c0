"""Queries of the catalogue's services: lookups, ingestion, writes, payloads, recommendations; with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import providers
from ..functions import semantics as S
from ..operators import catalog, fuzzy, normalise, payloads, text, upsert, vectors
from ..sources import pages as scraped
from ..streaming import webhook
from . import recommend
from .catalog_queries import SIMS, asked_vectors, nearest, nested_events, query, r6, read

LISTS_SQL = """(SELECT l_orderkey, string_agg(l_returnflag, ', ' ORDER BY l_linenumber, l_returnflag) AS skills, string_agg(p_brand, ', ' ORDER BY l_linenumber, p_brand) AS categories,
  string_agg(s_name, ', ' ORDER BY l_linenumber, s_name) AS speakers, string_agg(l_linestatus, ', ' ORDER BY l_linenumber, l_linestatus) AS goals
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)"""
NAMES_SQL = "coalesce(skills, '') AS skills, coalesce(categories, '') AS categories, coalesce(speakers, '') AS speakers, coalesce(goals, '') AS goals"


def flat(rows):
    of = {"skills": "l_returnflag", "categories": "p_brand", "speakers": "s_name", "goals": "l_linestatus"}
    return [F.array_join(f"{name}.{c}", ", ").alias(name) for name, c in of.items()]


# lookups and reads


@query(f"SELECT o_orderkey, o_orderdate, c_name AS organisation, {NAMES_SQL} FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN {LISTS_SQL} k ON l_orderkey = o_orderkey")
def event_catalog(spark, d):
    org = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("organisation"))
    rows = nested_events(spark, d, read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).join(org, "o_custkey", "left")
    return rows.select("o_orderkey", "o_orderdate", "organisation", *flat(rows)).orderBy("o_orderdate", "o_orderkey")


@query(f"SELECT o_orderkey, o_totalprice, {NAMES_SQL} FROM orders LEFT JOIN {LISTS_SQL} k ON l_orderkey = o_orderkey WHERE o_orderkey = 42")
def event_by_id(spark, d):
    rows = nested_events(spark, d, catalog.by_key(read(spark, d, "orders"), o_orderkey=42))
    return rows.select("o_orderkey", "o_totalprice", *flat(rows))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_id = 7) AND event_id = 7")
def row_by_composite_key(spark, d):
    rows = read(spark, d, "events")
    user = catalog.by_key(rows, event_id=7).first()["user_id"]
    return catalog.by_key(rows, user_id=user, event_id=7).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1")
def first_match(spark, d):
    return catalog.first_match(read(spark, d, "orders"), F.col("o_orderstatus") == "P", F.col("o_orderkey")).select("o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, coalesce(a.n, 0) AS accounts, coalesce(a.l, '') AS account_keys, coalesce(e.n, 0) AS sessions FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) a ON o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey""")
def user_details(spark, d):
    children = {"accounts": (read(spark, d, "orders"), "o_custkey", ["o_orderkey"]), "sessions": (read(spark, d, "events"), "user_id", ["event_id"])}
    rows = catalog.with_children(read(spark, d, "customer").select("c_custkey"), "c_custkey", children)
    return rows.select("c_custkey", F.size("accounts").cast("long").alias("accounts"), F.array_join("accounts.o_orderkey", ",").alias("account_keys"), F.size("sessions").cast("long").alias("sessions"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 20")
def event_page(spark, d):
    return catalog.page(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), 20, 10, F.col("o_orderdate"), F.col("o_orderkey"))


@query("SELECT doc_id, 'a' AS part FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'b' FROM documents WHERE contains(lower(source), 'src1') UNION ALL SELECT doc_id, 'c' FROM documents WHERE source IS NULL")
def place_filter(spark, d):
    rows = read(spark, d, "documents")
    parts = [catalog.place_filter(rows, p, "lang", "source", "en").select("doc_id", F.lit(n).alias("part")) for n, p in (("a", "OnLine"), ("b", "SRC1"))]
    return parts[0].unionByName(parts[1]).unionByName(catalog.place_filter(rows, None, "lang", "source").where("source is null").select("doc_id", F.lit("c").alias("part")))


@query("""SELECT conv_id, turn, contains(lower(coalesce(text, '') || ' ' || coalesce(role, '')), 'オンライン') OR contains(lower(coalesce(text, '') || ' ' || coalesce(role, '')), 'online') OR contains(lower(coalesce(text, '')), 'teams') OR contains(lower(coalesce(text, '')), 'zoom')
  OR contains(coalesce(text, '') || ' ' || coalesce(role, ''), 'the') AS reachable, contains(coalesce(text, ''), 'der') OR contains(lower(coalesce(text, '')), 'オンライン') OR contains(lower(coalesce(text, '')), 'online') OR contains(lower(coalesce(text, '')), 'zoom') OR contains(lower(coalesce(text, '')), 'teams') AS nearby FROM conversations""")
def regional_filters(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", catalog.reachable(F.col("text"), F.col("role"), "the").alias("reachable"), catalog.nearby(F.col("text"), "der").alias("nearby"))


@query("SELECT doc_id, 'タイトル: ' || source || chr(10) || '詳細URL: ' || coalesce(lang, '') || chr(10) || '概要: ' || coalesce(text, '') AS page, source || CASE WHEN length(lang) > 0 THEN ' (' || lang || ')' ELSE '' END AS place FROM documents")
def document_pages(spark, d):
    return read(spark, d, "documents").select("doc_id", catalog.page_content(F.col("source"), F.col("lang"), F.col("text")).alias("page"), catalog.full_place(F.col("source"), F.col("lang")).alias("place"))


@query("""SELECT o_orderkey, o_orderkey || '. ' || o_orderpriority || ' | ' || left(c_name, 200) || '...' || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || coalesce(nullif(c_mktsegment, ''), 'オンライン') AS line FROM orders JOIN customer ON c_custkey = o_custkey""")
def candidate_lines(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", catalog.candidate_line(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("c_name"), F.col("o_orderdate"), F.col("c_mktsegment"), F.lit(None).cast("string")).alias("line"))


@query("SELECT doc_id AS id, source AS title, length(text) AS n, 0 AS n_phrases, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 1))::INT AS n_words FROM documents")
def key_records(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 1)
    none = F.lit(None).cast("array<string>")
    row = {"id": F.col("doc_id"), "title": F.col("source"), "description": F.col("text"), "keywords": words, "keyPhrases": none, "keySentences": none}
    return read(spark, d, "documents").select(*catalog.key_record(row)).select("id", "title", F.length("detail").cast("long").alias("n"), F.size("keyPhrases").alias("n_phrases"), F.size("keywords").alias("n_words"))


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS balance, s_nationkey::VARCHAR AS nation FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def spread_merge(spark, d):
    left = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    right = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("string").alias("nation"))
    return catalog.spread(left, right, "c_custkey")


@query(f"WITH {SIMS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s) SELECT query_id, id, p_name AS title, concat('rank ', r) AS reason FROM t JOIN part ON p_partkey = id WHERE r <= 10")
def recommendations_enriched(spark, d):
    best = nearest(spark, d, 10).select("query_id", "id", "rank")
    answers = best.select(F.struct("query_id", "id").alias("pair"), F.concat(F.lit("rank "), "rank").alias("reason"))
    rows = catalog.enriched(best, read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "id")
    return catalog.with_reasons(rows.withColumn("pair", F.struct("query_id", "id")), answers, "pair").select("query_id", "id", "title", "reason")


@query("SELECT o_orderkey AS id, 'db' AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT event_id, 'api' FROM events")
def union_all(spark, d):
    database = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("db").alias("source"))
    return database.unionByName(read(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("api").alias("source")))


@query(f"WITH {SIMS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s) SELECT DISTINCT user, id FROM t WHERE r <= 5")
def ids_by_tags(spark, d):
    best = nearest(spark, d, 5)
    tags = read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("label").alias("user"), F.col("vec_id").alias("tag"))
    return recommend.user_ids(best.select(F.col("query_id").alias("tag"), "id"), tags)


@query("SELECT a.conv_id, a.turn, coalesce(array_to_string(list_filter(['The', 'und', 'que', 'license'], lambda w: NOT contains(lower(a.text), lower(w))), ','), '') AS missing FROM conversations a")
def missing_terms(spark, d):
    from ..operators.extractors import missing_terms as missing

    wanted = F.array(*map(F.lit, ["The", "und", "que", "license"]))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(missing(wanted, F.array(F.coalesce("text", F.lit("")))), ",").alias("missing"))


@query("""SELECT a.p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_type, '')))) / len(list_distinct(list_concat(string_split(p_name, ''), string_split(p_type, '')))), 6) AS sim FROM part a""")
def char_jaccard(spark, d):
    return read(spark, d, "part").select("p_partkey", r6(S.char_jaccard(F.col("p_name"), F.col("p_type"))).alias("sim"))


@query(f"""SELECT user_id, event_id, ts AS created_at, o_totalprice AS price, c_name AS organisation, {NAMES_SQL.replace(", coalesce(goals, '') AS goals", "")} FROM events JOIN orders ON o_orderkey = event_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN {LISTS_SQL} k ON l_orderkey = o_orderkey WHERE event_type = 'click'""")
def bookmarks_nested(spark, d):
    marks = read(spark, d, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("o_orderkey"), F.col("ts").alias("created_at"))
    org = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("organisation"))
    rows = marks.join(nested_events(spark, d, read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))), "o_orderkey").join(org, "o_custkey", "left")
    return rows.orderBy(F.desc("created_at"), "o_orderkey").select("user_id", F.col("o_orderkey").alias("event_id"), "created_at", "price", "organisation", *flat(rows)[:3])


# writes

COLUMNS = {"title": "o_orderpriority", "status": "o_orderstatus", "price": "o_totalprice", "day": "o_orderdate", "organisation": "o_custkey"}


def event_rows(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[F.col(c).alias(n) for n, c in COLUMNS.items()], F.col("o_orderdate").alias("created"), F.lit("old").alias("updated"))


ROWS_SQL = "t AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS day, o_custkey AS organisation, o_orderdate AS created, 'old' AS updated FROM orders)"


def changed(spark, d):
    x = event_rows(spark, d).where("id % 2 = 0")
    return x.withColumns({"title": F.lit("new"), "price": F.col("price") + 1, "created": F.lit("2000-01-01").cast("timestamp_ntz"), "updated": F.lit("now")})


CHANGED_SQL = "n AS (SELECT id, 'new' AS title, status, price + 1 AS price, day, organisation, TIMESTAMP '2000-01-01' AS created, 'now' AS updated FROM t WHERE id % 2 = 0)"
MERGE_SQL = "SELECT coalesce(n.id, o.id) AS id, {} FROM (SELECT * FROM t WHERE id % 3 <> 0) o FULL JOIN n ON n.id = o.id"


def merge_sql(update: list[str]) -> str:
    names = ["title", "status", "price", "day", "organisation", "created", "updated"]
    cells = [f"CASE WHEN n.id IS NOT NULL {'' if c in update else 'AND o.id IS NULL'} THEN n.{c} ELSE o.{c} END AS {c}" for c in names]
    return f"WITH {ROWS_SQL}, {CHANGED_SQL} {MERGE_SQL.format(', '.join(cells))}"


LISTED = ["title", "status", "price", "day", "updated"]


@query(merge_sql(LISTED))
def upsert_listed(spark, d):
    """Known ids take the listed columns and keep what isn't listed (creation); new ids come in whole."""
    return upsert.upsert(event_rows(spark, d).where("id % 3 <> 0"), changed(spark, d), "id", LISTED)


@query(merge_sql(["title", "status", "price", "day", "organisation", "created", "updated"]))
def upsert_full(spark, d):
    return upsert.upsert(event_rows(spark, d).where("id % 3 <> 0"), changed(spark, d), "id")


@query("""WITH n AS (SELECT event_id, user_id, value, value > 5 AS ok FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, user_id, value) AS r FROM n WHERE ok)
  SELECT (SELECT count(*) FROM n) AS fetched, count(*) FILTER (r = 1 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)) AS saved, (SELECT count(*) FROM n WHERE NOT coalesce(ok, false)) AS errors,
  count(*) - count(*) FILTER (r = 1 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)) AS duplicates FROM g""")
def save_counts(spark, d):
    have = read(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("user_id"))
    return upsert.save_counts(have, read(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], F.col("value") > 5)


@query("SELECT doc_id, text IS NOT NULL AND length(trim(source)) > 0 AND n_chars > 500 AS valid FROM documents")
def required_fields(spark, d):
    ok = F.col("text").isNotNull() & (F.length(F.trim("source")) > 0) & (F.col("n_chars") > 500)
    good, bad = upsert.valid_split(read(spark, d, "documents"), ok)
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(False).alias("valid")))


@query("""WITH a AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Unknown Company' ELSE 'Supplier ' || (page_id % 40) END AS name FROM pages) SELECT a.name, count(*) AS n, bool_or(s_name IS NOT NULL) AS known FROM a LEFT JOIN (SELECT 'Supplier ' || s_suppkey AS s_name FROM supplier WHERE s_suppkey % 2 = 0) ON s_name = name GROUP BY 1""")
def organisations(spark, d):
    name = F.when(F.col("page_id") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Supplier "), F.col("page_id") % 40))
    rows = read(spark, d, "pages").select("page_id", name.alias("company"))
    have = read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("Supplier "), "s_suppkey").alias("name"))
    every, linked = upsert.with_dimension(rows, "company", have)
    return linked.join(every, F.col("dimension_id") == F.col("id")).groupBy("name").agg(F.count("*").alias("n"), F.bool_or(~F.col("id").startswith("org_")).alias("known"))


@query("""WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY user_id, event_type, event_id) = 1 AS first FROM events)
  SELECT user_id, event_type, event_id, first AND user_id % 4 <> 0 AS is_new FROM n""")
def bookmark_is_new(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_type", "event_id")
    have = rows.where("user_id % 4 = 0").select("user_id", "event_type")
    return upsert.inserted(have, rows, ["user_id", "event_type"])


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events WHERE NOT (event_id = 3 AND user_id = (SELECT user_id FROM events WHERE event_id = 3))")
def delete_one(spark, d):
    rows = read(spark, d, "events")
    user = catalog.by_key(rows, event_id=3).first()["user_id"]
    return upsert.delete_one(rows, event_id=3, user_id=user).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("SELECT (SELECT count(*) FROM events WHERE value > 50) AS deleted, count(*) AS left_over FROM events WHERE NOT coalesce(value > 50, false)")
def delete_count(spark, d):
    left, gone = upsert.delete_count(read(spark, d, "events"), F.col("value") > 50)
    return gone.crossJoin(left.agg(F.count("*").alias("left_over")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_mktsegment FROM customer")
def update_supplied(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = rows.where("c_custkey % 2 = 0").select("c_custkey", F.lit("renamed").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return upsert.update_supplied(rows, new, "c_custkey")


@query("SELECT l_orderkey AS o_orderkey, 'skills' AS kind, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'goals', count(*) FROM lineitem GROUP BY 1")
def insert_nested(spark, d):
    events = nested_events(spark, d, read(spark, d, "orders").select("o_orderkey"), "skills", "goals")
    parts = upsert.split_nested(events, "o_orderkey", ["skills", "goals"])
    rows = [x.groupBy("o_orderkey").agg(F.lit(name).alias("kind"), F.count_distinct("id").alias("n")) for name, x in parts.items()]
    return rows[0].unionByName(rows[1])


@query("""SELECT 'lineitem.l_orderkey' AS reference, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS orphans UNION ALL
  SELECT 'events.event_id', (SELECT count(*) FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'orders.o_custkey', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def foreign_key_audit(spark, d):
    orders = read(spark, d, "orders")
    checks = {
        "lineitem.l_orderkey": (read(spark, d, "lineitem"), "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey"),
        "events.event_id": (read(spark, d, "events"), "event_id", orders, "o_orderkey"),
        "orders.o_custkey": (orders, "o_custkey", read(spark, d, "customer"), "c_custkey"),
    }
    rows = [upsert.orphans(*x).agg(F.lit(name).alias("reference"), F.count("*").alias("orphans")) for name, x in checks.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# payloads, reports


@query("""SELECT o_orderkey, to_json({'type': 'bubble', 'image': '', 'body': {'title': o_orderpriority, 'date': strftime(o_orderdate, '%Y-%m-%d'), 'place': o_orderstatus}, 'button': {'label': CASE WHEN m THEN 'ブックマーク解除' ELSE 'ブックマークに追加' END,
  'data': 'action=' || CASE WHEN m THEN 'unbookmark' ELSE 'bookmark' END || '&eventId=' || o_orderkey || '&userId=7'}, 'url': 'u'})::VARCHAR AS payload FROM (SELECT *, o_orderkey IN (SELECT event_id FROM events WHERE user_id = 7) AS m FROM orders)""")
def bubble_payload(spark, d):
    rows = catalog.marked(read(spark, d, "orders"), "o_orderkey", read(spark, d, "events").where("user_id = 7"), "event_id")
    card = payloads.bubble(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderstatus"), F.lit("u"), F.col("is_bookmarked"), F.lit(7))
    return rows.select("o_orderkey", F.to_json(card).alias("payload"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) SELECT user_id, '{"type":"carousel","contents":[' || string_agg('{"id":' || event_id || '}', ',' ORDER BY n) || ']}' AS payload FROM r WHERE n <= 10 GROUP BY 1""")
def carousel_payload(spark, d):
    rows = read(spark, d, "events").withColumn("card", F.struct(F.col("event_id").alias("id")))
    return payloads.carousel(rows, "user_id", "card", F.desc("ts"), F.col("event_id"))


@query("SELECT user_id, count(*) AS sent, count(*) FILTER (event_id % 3 = 0) AS succeeded FROM events GROUP BY 1")
def push_results(spark, d):
    rows = read(spark, d, "events").select("user_id", payloads.text_message(F.col("event_id").cast("string")).alias("payload"))
    return payloads.success_counts(payloads.delivered(rows, "user_id", _third), "user_id")


def _third(user, payload) -> bool:
    """A sender that reaches every third event, and breaks on the rest."""
    import json

    n = int(json.loads(payload)["text"])
    if n % 3 == 1:
        raise OSError("unreachable")
    return n % 3 == 0


@query("SELECT count(*) AS total, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS with_text, count(*) FILTER (NOT coalesce(n_chars > 300, false)) AS errors, round(100.0 * count(*) FILTER (n_chars > 300) / count(*), 2)::DOUBLE AS success_rate, 1.5::DOUBLE AS seconds FROM documents")
def run_report(spark, d):
    return payloads.run_summary(read(spark, d, "documents"), "text", F.col("n_chars") > 300, 1.5)


@query("SELECT source, arg_max(doc_id, struct_pack(n := n_chars, o := -doc_id)) AS representative, arg_min(doc_id, struct_pack(n := n_chars, o := doc_id)) AS first_place FROM documents GROUP BY 1")
def representatives(spark, d):
    best = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("representative")
    return read(spark, d, "documents").groupBy("source").agg(best, F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("first_place"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, r::INT AS place, round(1 - (r - 1) / n, 6) AS linear,
  CASE WHEN (r - 1) / n <= 0.3 OR (r - 1) / n >= 0.7 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS place_weight FROM r""")
def linear_rank(spark, d):
    return text.placed(read(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", "place", r6(F.col("linear")).alias("linear"), "place_weight")


@query(r"SELECT doc_id, coalesce(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[a-zA-Z0-9]+') AND NOT regexp_full_match(x, '\d+')), ' '), '') AS tokens FROM documents")
def token_filter(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(text.foreign_words(F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 1)), " ").alias("tokens"))


# ingestion


@query("""WITH r AS (SELECT doc_id AS id, coalesce(source, '') AS title, text AS description, (['東京都渋谷区', 'Zoom', '', '京都 meetup', 'online 札幌', NULL, 'virtual', '大阪'])[doc_id % 8 + 1] AS place, CASE WHEN doc_id % 3 = 0 THEN '北海道' WHEN doc_id % 3 = 1 THEN '青森市' END AS address,
  (['lt', 'contest', 'x', 'lightning_talk', 'Hackathon'])[doc_id % 5 + 1] AS tag FROM documents), p AS (SELECT *, coalesce(nullif(place, ''), '未定') AS venue, coalesce(nullif(place, ''), '未定') || ' ' || coalesce(address, '') AS spot FROM r)
  SELECT 'connpass_' || id AS id, title, coalesce(description, '') AS description, venue,
  CASE WHEN contains(spot, '北海道') THEN '北海道' WHEN contains(spot, '青森') THEN '青森県' WHEN contains(spot, '東京') THEN '東京都' WHEN contains(spot, '京都') THEN '京都府' WHEN contains(spot, '大阪') THEN '大阪府' WHEN regexp_matches(lower(spot), 'zoom|online|virtual') THEN 'オンライン' ELSE '不明' END AS location, '03:00' AS start_time,
  CASE WHEN regexp_matches(lower(coalesce(place, '')), 'online|zoom|meet|virtual') THEN 'ONLINE' ELSE 'OFFLINE' END AS format,
  CASE WHEN tag = 'Hackathon' THEN 'HACKATHON' WHEN tag = 'contest' THEN 'CONTEST' WHEN tag IN ('lt', 'lightning_talk') OR contains(lower(title), 'lt') THEN 'LIGHTNING_TALK' ELSE 'WORKSHOP' END AS event_type FROM p""")
def api_events(spark, d):
    def pick(values, by):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod("doc_id", F.lit(by)) + 1).cast("int"))

    rows = read(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("title"), F.lit(None).cast("string").alias("catch"), F.col("text").alias("description"), F.lit("u").alias("url"),
        F.lit("2025-03-03T18:00:00Z").alias("started_at"), F.lit(None).cast("string").alias("ended_at"), pick(["東京都渋谷区", "Zoom", "", "京都 meetup", "online 札幌", None, "virtual", "大阪"], 8).alias("place"),
        F.when(F.col("doc_id") % 3 == 0, "北海道").when(F.col("doc_id") % 3 == 1, "青森市").alias("address"), F.array(pick(["lt", "contest", "x", "lightning_talk", "Hackathon"], 5)).alias("tags"),
    )
    rows = rows.select(*normalise.api_event())
    return rows.select("id", "title", "description", "venue", "location", F.col("startTime").alias("start_time"), "format", F.col("eventType").alias("event_type"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'tokyo' WHEN 1 THEN 'kyoto' WHEN 2 THEN 'hokkaido' ELSE 'online' END AS code FROM nation")
def prefecture_codes(spark, d):
    place = F.element_at(F.array(*map(F.lit, ["東京都", "京都府京都市", "北海道", "nowhere"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return read(spark, d, "nation").select("n_nationkey", normalise.prefecture_code(place).alias("code"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '\s+', ' ', 'g')), '') AS heading,
  len(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1))::INT AS n_links FROM pages""")
def page_details(spark, d):
    rows = scraped.details(read(spark, d, "pages"), titles=("h1",))
    return rows.select("page_id", F.col("title").alias("heading"), "n_links")


@query(r"""WITH p AS (SELECT page_id, html FROM pages ORDER BY page_id LIMIT 10), l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS l FROM p) SELECT page_id, generate_subscripts(l, 1)::INT - 1 AS place, unnest(l) AS link FROM l""")
def page_links(spark, d):
    return scraped.listed(read(spark, d, "pages"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN CASE WHEN turn % 2 = 0 THEN 'unbookmark' ELSE 'bookmark' END WHEN turn % 5 = 0 THEN 'remind' ELSE 'free_text' END AS route, CASE WHEN role = 'assistant' THEN conv_id::VARCHAR END AS event_id
  FROM conversations WHERE role IN ('assistant', 'user')""")
def webhook_route(spark, d):
    data = F.concat(F.lit("action="), F.when(F.col("turn") % 2 == 0, "unbookmark").otherwise("bookmark"), F.lit("&eventId="), "conv_id")
    rows = read(spark, d, "conversations").select(
        F.when(F.col("role") == "assistant", "postback").when(F.col("role") == "user", "message").otherwise("follow").alias("type"), F.struct(F.concat_ws("/", "conv_id", "turn").alias("userId")).alias("source"),
        F.when(F.col("role") == "assistant", F.struct(data.alias("data"))).alias("postback"), F.struct(F.lit("text").alias("type"), F.when(F.col("turn") % 5 == 0, "リマインド").otherwise(F.col("text")).alias("text")).alias("message"),
    )
    found, place = webhook.routed(rows), F.split("user", "/")
    return found.select(place[0].cast("long").alias("conv_id"), place[1].cast("long").alias("turn"), "route", "event_id")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate + INTERVAL 14 DAY, '%Y%m%d') AS until, 'connpass_' || o_orderkey AS prefixed, o_orderstatus = 'F' AS known, '{{x}}' AS escaped, '{"a":1}' AS body FROM orders""")
def scalar_families(spark, d):
    low, high = S.day_range(F.col("o_orderdate").cast("date"), F.lit(None).cast("date"), F.col("o_orderdate").cast("date"))
    m = F.create_map(F.lit("F"), F.lit(True))
    return read(spark, d, "orders").select("o_orderkey", S.day_number(low).alias("day"), S.day_number(high).alias("until"), S.prefixed_id("connpass_", F.col("o_orderkey")).alias("prefixed"), S.mapped(m, F.col("o_orderstatus"), F.lit(False)).alias("known"), S.braces_escaped(F.lit("{x}")).alias("escaped"), S.json_in(F.lit('```{"a":1}```')).alias("body"))


# vectors and recommendations


@query(f"""WITH {SIMS}, a AS (SELECT query_id, label, max(greatest(0, sim)) AS s FROM s WHERE id % 2 = 0 GROUP BY 1, 2), b AS (SELECT query_id, label, greatest(0, avg(sim)) AS s FROM s WHERE id % 2 = 1 GROUP BY 1, 2),
  l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) AS r FROM a UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) AS r FROM b) SELECT query_id, label, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM l GROUP BY 1, 2""")
def rrf_rerank(spark, d):
    queries, corpus = asked_vectors(spark, d)
    best = vectors.pooled_nearest(queries, corpus.where("id % 2 = 0"), "label")
    mean = vectors.pooled_nearest(queries, corpus.where("id % 2 = 1"), "label", how="mean")
    return vectors.rerank_pooled(best, mean, "query_id", "label").withColumn("score", r6(F.col("score")))


@query(f"WITH {SIMS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s) SELECT query_id, id, round(sim, 6) AS sim FROM t WHERE r <= 50 AND sim >= 0.2 AND label <> 3")
def retrieve(spark, d):
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    found = nearest(spark, d, 50).join(labels, "id")
    return vectors.retrieved(found, 0.2, F.col("label") != 3).select("query_id", "id", r6(F.col("sim")).alias("sim"))


def profiles(spark, d):
    words = F.element_at(F.array(*map(F.lit, ["the, and", "der、und", "que", "les,license"])), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    return read(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("user"), F.array(words).alias("tags"), F.array(F.lit("source"), F.lit("src1")).alias("goals"), F.lit("").alias("place"))


@query("""WITH u AS (SELECT c_custkey AS user, list_concat(([['the', 'and'], ['der', 'und'], ['que'], ['les', 'license']])[c_custkey % 4 + 1], ['source', 'src1']) AS k FROM customer WHERE c_custkey % 20 = 0), e AS (SELECT doc_id AS id, lower(concat_ws(' ', coalesce(text, ''), coalesce(source, ''))) AS t FROM documents),
  m AS (SELECT user, id, list_filter(k, lambda w: contains(t, lower(w))) AS m FROM u, e), r AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY len(m) DESC, id) AS r FROM m)
  SELECT user, id, len(m)::INT AS score, least(100, len(m) * 10)::INT AS relevance, array_to_string(m, ',') AS matched FROM r WHERE r <= 5 AND len(m) * 10 >= 30""")
def recommend_by_profile(spark, d):
    events = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return recommend.by_profile(profiles(spark, d), events, ["text", "source"], least=30)


@query(r"""WITH q AS (SELECT conv_id || '/' || turn AS user, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 1)[1:5] AS w, text FROM conversations WHERE length(trim(text)) > 0), u AS (SELECT user, CASE WHEN len(w) > 0 THEN w ELSE [text] END AS k FROM q),
  e AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS t FROM documents), m AS (SELECT user, id, list_filter(k, lambda w: contains(t, lower(w))) AS m FROM u, e), r AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY len(m) DESC, id) AS r FROM m)
  SELECT user, id, len(m)::INT AS score, least(100, len(m) * 10)::INT AS relevance, coalesce(array_to_string(m, ','), '') AS matched FROM r WHERE r <= 5 AND len(m) * 10 >= 20""")
def recommend_by_question(spark, d):
    questions = read(spark, d, "conversations").where("length(trim(text)) > 0").select(F.concat_ws("/", "conv_id", "turn").alias("user"), F.col("text").alias("question"))
    return recommend.by_question(questions, read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["text"], least=20)


@query()
def recommend_hyde(spark, d):
    """Generated queries are stood in for by one for each keyword of the profile; embeddings by hashing of names."""
    events = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("page"), F.col("p_brand").alias("location"))
    users = read(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("user"), F.array(F.col("c_mktsegment")).alias("tags"), F.array(F.lit("ECONOMY STEEL")).alias("goals"), F.lit("").alias("place"))
    return recommend.hyde(users, events, least=0.2)


@query()
def recommend_by_tags(spark, d):
    events = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("keyPhrases"), F.array("p_type", "p_brand").alias("keySentences"))
    tags = read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_type").alias("tag"))
    rows = recommend.by_tags(tags, events, modes=("concat", "per_keyword"), methods=("rrf", "weighted", "hybrid"), threshold=0.2)
    return rows.select("tag", "id", "label", r6(F.col("score")).alias("score"), r6(F.col("mean_sim")).alias("mean_sim"))


@query()
def rag_context(spark, d):
    events = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("page"))
    questions = read(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("question"))
    return recommend.context(questions, events)


@query(r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || (['', '、b', ',c 、 d', '、'])[conv_id % 4 + 1] AS t FROM conversations), w AS (SELECT *, CASE WHEN contains(t, ',') THEN string_split(t, ',') WHEN contains(t, '、') THEN string_split(t, '、') ELSE [t] END AS w FROM c)
  SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(w, lambda x: trim(x)), lambda x: length(x) > 0))), '|'), '') AS words FROM w""")
def profile_keywords(spark, d):
    """Texts as profiles' tags, some with a comma of either script behind them."""
    tags = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, ["", "、b", ",c 、 d", "、"])), (F.col("conv_id") % 4 + 1).cast("int")))
    words = providers.profile_keywords(F.array(tags), F.lit(None).cast("array<string>"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(words), "|").alias("words"))


@query("SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'license')")
def result_count(spark, d):
    return read(spark, d, "documents").where(S.has(F.col("text"), "license")).agg(F.count("*").alias("total"))


@query("""SELECT event_id, round(coalesce(nullif((props::JSON->>'k')::DOUBLE / 100, 0), 0.5), 6) AS score, round(greatest(0.1, least(coalesce(nullif((props::JSON->>'k')::DOUBLE / 100, 0), 0.5), 1.0)), 6) AS confidence FROM events""")
def reply_scores(spark, d):
    """Replies as a model words them, with the numbers of events."""
    score = F.from_json("props", "k int")["k"] / 100.0
    reply = F.concat(F.lit('Sure: ```json {"keywords": [{"keyword": "w", "score": '), score.cast("string"), F.lit("}]} ```"))
    item = providers.confident(providers.parsed(reply, "keywords"), "keyword")[0]
    return read(spark, d, "events").select("event_id", r6(item["score"]).alias("score"), r6(item["confidence"]).alias("confidence"))


@query("""SELECT o_orderkey, user_id, '{"type":"text","text":"Event ' || o_orderkey || ': ' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS payload FROM orders JOIN events ON event_id = o_orderkey JOIN customer ON c_custkey = user_id
  WHERE o_orderdate >= TIMESTAMP '1995-06-08' AND o_orderdate < TIMESTAMP '1995-06-09' AND c_name IS NOT NULL""")
def reminder_payloads(spark, d):
    due = catalog.on_day(read(spark, d, "orders"), "o_orderdate", "1995-06-01")
    rows = due.join(read(spark, d, "events"), F.col("o_orderkey") == F.col("event_id")).join(read(spark, d, "customer").where("c_name is not null"), F.col("user_id") == F.col("c_custkey"))
    message = F.concat(F.lit("Event "), F.col("o_orderkey").cast("string"), F.lit(": "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rows.select("o_orderkey", "user_id", payloads.text_message(message).alias("payload"))


@query("SELECT o_orderkey AS id, len(string_split(o_orderpriority || ' ' || o_orderstatus, ' '))::INT AS n_words, 'タイトル: ' || o_orderpriority || chr(10) || '詳細URL: u' || chr(10) || '概要: ' || o_orderstatus AS page, strftime(o_orderdate, '%Y-%m-%d') AS day, 64 AS dims FROM orders ")
def vector_store(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("u").alias("url"), F.col("o_orderstatus").alias("description"), F.lit("v").alias("venue"), F.lit("").alias("address"), F.col("o_orderdate").alias("day"))
    words = F.size(F.split(F.concat_ws(" ", "metadata.title", F.regexp_extract("page", "概要: (.*)$", 1)), " "))
    return recommend.vector_store(rows).select("id", words.alias("n_words"), "page", F.col("metadata.eventDate").alias("day"), F.size("vec").alias("dims"))


@query("""WITH n AS (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part), u AS (SELECT name, min(p_partkey) AS first FROM n GROUP BY 1), s AS (SELECT a.name AS a, b.first, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS sim FROM u a JOIN u b ON a.name <> b.name),
  r AS (SELECT a, first, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, first) AS r FROM s WHERE sim > 0.7) SELECT p_partkey, first AS match, round(sim, 6) AS sim FROM n JOIN r ON a = name WHERE r = 1""")
def best_name_match(spark, d):
    """The name most like each part's own, of all other names; no blocking column."""
    rows = read(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("match"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return fuzzy.best_matches(rows, "p_partkey", "name", rows, "match", "name").withColumn("sim", r6(F.col("sim")))
