"""Queries over the driver's tables, one for each operator of the inventory, with their DuckDB forms.

orders stand for events, lineitem for their skills and for the junctions to part (categories) and supplier (speakers),
customer for users and organisations, events for bookmarks, documents for event texts, embeddings for vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import semantics as S
from ..operators import catalog, fuzzy, normalise, text, upsert, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "keyword_match_rank"

TEXT = ["title", "description"]
WORDS = ["the", "quedo", "schein", "license", "email", "moron"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# catalogue reads


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def event_list_by_type(spark, d):
    rows = catalog.by_type(read(spark, d, "orders"), "o_orderstatus", "open", {"open": "O"})
    return rows.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT doc_id, source, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1')")
def event_search_or(spark, d):
    return catalog.search(read(spark, d, "documents"), "License", "SRC1", ["text"], ["source"]).select("doc_id", "source", "lang")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(source), 'src1')")
def event_search_and(spark, d):
    return catalog.search(read(spark, d, "documents"), "License", "SRC1", ["text"], ["source"], compat=False).select("doc_id")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size > 40)""")
def event_search_semi(spark, d):
    import datetime as dt

    lines = read(spark, d, "lineitem")
    rows = catalog.between(read(spark, d, "orders"), "o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31))
    rows = catalog.having_some(rows, "o_orderkey", lines, "l_orderkey", F.col("l_returnflag") == "R")
    of = lines.join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return catalog.having_some(rows, "o_orderkey", of, "l_orderkey", F.col("p_size") > 40).select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(lang), 'de') OR lang = '不明'")
def location_or_unknown(spark, d):
    return catalog.at_place(read(spark, d, "documents"), "lang", "DE", None, ["text"]).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'mit license')")
def search_term_replaces_place(spark, d):
    return catalog.at_place(read(spark, d, "documents"), "lang", "DE", "MIT License", ["text"]).select("doc_id")


TOKENS_SQL = "list_filter(regexp_split_to_array(regexp_replace(text, '[[:punct:]。、！？「」『』（）]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1)"


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents) WHERE list_has_any(t, ['the', 'der', 'une'])")
def array_overlap(spark, d):
    rows = read(spark, d, "documents").withColumn("t", text.tokens(F.col("text"), None))
    return catalog.overlapping(rows, "t", ["the", "der", "une"]).select("doc_id")


@query("""SELECT o_orderkey, c_name AS organisation, coalesce(k.n, 0)::INT AS n_skills, coalesce(k.s, '') AS skills, coalesce(k.b, 0)::INT AS n_categories, coalesce(k.p, 0)::INT AS n_speakers
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (
    SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS s, count(p_brand) AS b, count(s_name) AS p
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) k ON l_orderkey = o_orderkey""")
def event_nested_counts(spark, d):
    org = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("organisation"))
    rows = nested_events(spark, d, read(spark, d, "orders").select("o_orderkey", "o_custkey")).join(org, "o_custkey", "left")
    return rows.select("o_orderkey", "organisation", F.size("skills").alias("n_skills"), F.array_join("skills.l_returnflag", ",").alias("skills"), F.size("categories").alias("n_categories"), F.size("speakers").alias("n_speakers"))


def nested_events(spark, d, events: DataFrame, *names: str) -> DataFrame:
    """Events with skills, categories, speakers and goals, or those asked for, which all come with one scan of their rows."""

    def item(c):
        return F.when(F.col(c).isNotNull(), F.struct("l_linenumber", c))

    lists = {"skills": F.struct("l_linenumber", "l_returnflag"), "categories": item("p_brand"), "speakers": item("s_name"), "goals": F.struct("l_linenumber", "l_linestatus")}
    lists = {name: lists[name] for name in names or lists}
    lines = read(spark, d, "lineitem")
    if "categories" in lists:
        lines = lines.join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "speakers" in lists:
        lines = lines.join(read(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return catalog.all_nested(events, "o_orderkey", lines, "l_orderkey", lists)


@query("""SELECT user_id, event_id, ts AS created_at, o_totalprice AS price, c_name AS organisation FROM events JOIN orders ON o_orderkey = event_id
  LEFT JOIN customer ON c_custkey = o_custkey WHERE event_type = 'click'""")
def bookmarks_by_user(spark, d):
    marks = read(spark, d, "events").where("event_type = 'click'")
    rows = marks.join(read(spark, d, "orders"), F.col("event_id") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("user_id", "event_id", F.col("ts").alias("created_at"), F.col("o_totalprice").alias("price"), F.col("c_name").alias("organisation"))


@query("SELECT o_orderkey, o_orderkey IN (SELECT event_id FROM events WHERE user_id = 7) AS is_bookmarked FROM orders")
def is_bookmarked(spark, d):
    marks = read(spark, d, "events").where("user_id = 7")
    return catalog.marked(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", marks, "event_id")


@query("""SELECT o_orderkey, user_id, c_name AS user_name FROM orders JOIN events ON event_id = o_orderkey JOIN customer ON c_custkey = user_id
  WHERE o_orderdate >= TIMESTAMP '1995-06-08' AND o_orderdate < TIMESTAMP '1995-06-09' AND c_name IS NOT NULL""")
def reminder_window(spark, d):
    due = catalog.on_day(read(spark, d, "orders"), "o_orderdate", "1995-06-01")
    users = read(spark, d, "customer").where("c_name is not null")
    rows = due.join(read(spark, d, "events"), F.col("o_orderkey") == F.col("event_id")).join(users, F.col("user_id") == F.col("c_custkey"))
    return rows.select("o_orderkey", "user_id", F.col("c_name").alias("user_name"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def first_five(spark, d):
    return catalog.first_rows(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), 5, F.col("o_orderdate"), F.col("o_orderkey"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 5")
def latest_five(spark, d):
    return catalog.first_rows(read(spark, d, "events").select("event_id", "ts"), 5, F.desc("ts"), F.col("event_id"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL AND c_nationkey IN (3, 5, 7)")
def users_with_line_id(spark, d):
    return catalog.having_value(read(spark, d, "customer"), "c_name", {"c_nationkey": [3, 5, 7]}).select("c_custkey", "c_name")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name)::INT AS ord FROM nation")
def dimension_by_name(spark, d):
    return catalog.dimension(read(spark, d, "nation"), "n_name")


@query("SELECT (EXISTS (FROM orders) AND EXISTS (FROM customer) AND EXISTS (FROM events))::INT AS ok")
def liveness(spark, d):
    return catalog.alive(*[read(spark, d, t) for t in ("orders", "customer", "events")])


@query("""SELECT o_orderkey, concat('Event ', o_orderkey, ' (', o_orderstatus, ')') AS title, strftime(o_orderdate, '%Y-%m-%d') AS day,
  coalesce(nullif(o_orderpriority, ''), 'オンライン') AS place FROM orders""")
def candidate_rendering(spark, d):
    title = F.format_string("Event %d (%s)", "o_orderkey", "o_orderstatus")
    return read(spark, d, "orders").select("o_orderkey", title.alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), S.falsy_or(F.col("o_orderpriority"), F.lit("オンライン")).alias("place"))


# writes


@query("SELECT event_id, min(user_id) AS user_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY event_id")
def insert_if_absent(spark, d):
    have = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return upsert.insert_if_absent(have, read(spark, d, "events").select("event_id", "user_id"), ["event_id"])


@query("""WITH t AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_totalprice + 1 AS p, 'N' AS s FROM orders WHERE o_orderkey % 2 = 0)
  SELECT coalesce(t.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.p IS NOT NULL THEN n.p ELSE t.o_totalprice END AS o_totalprice,
  CASE WHEN t.o_orderkey IS NULL THEN n.s ELSE t.o_orderstatus END AS o_orderstatus FROM t FULL JOIN n ON n.o_orderkey = t.o_orderkey""")
def upsert_partial(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = rows.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return upsert.upsert(rows.where("o_orderkey % 3 <> 0"), new, "o_orderkey", ["o_totalprice"])


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def upsert_keep_newest(spark, d):
    return upsert.keep_newest(read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", F.desc("ts"), F.col("event_id"))


@query("SELECT user_id, count(*) AS n FROM events WHERE NOT (event_type = 'view' AND user_id % 5 = 0) GROUP BY 1")
def delete_many(spark, d):
    rows = read(spark, d, "events")
    gone = rows.where("event_type = 'view' and user_id % 5 = 0")
    return upsert.without(rows, gone, ["event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 0) GROUP BY 1, 2")
def replace_children(spark, d):
    new = read(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("X").alias("l_returnflag"))
    rows = upsert.replace_children(read(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", new)
    return rows.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'BEGINNER' ELSE 'ADVANCED' END AS level FROM customer")
def level_backfill(spark, d):
    return read(spark, d, "customer").select("c_custkey", normalise.level(F.col("c_acctbal")).alias("level"))


@query("""SELECT o_orderkey, concat('{"title":"Event ', o_orderkey, '","price":', floor(o_totalprice)::BIGINT, ',"action":"bookmark&eventId=', o_orderkey, '"}') AS payload FROM orders""")
def payload_json(spark, d):
    key = F.col("o_orderkey").cast("string")
    body = F.struct(F.concat(F.lit("Event "), key).alias("title"), F.floor("o_totalprice").alias("price"), F.concat(F.lit("bookmark&eventId="), key).alias("action"))
    return read(spark, d, "orders").select("o_orderkey", F.to_json(body).alias("payload"))


# aggregates


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (value > 10) AS found, round(100.0 * count(*) FILTER (value > 10) / count(*), 2)::DOUBLE AS success_rate FROM events GROUP BY 1""")
def run_summary(spark, d):
    return catalog.success(read(spark, d, "events"), "event_type", F.col("value") > 10)


CATEGORIES = [("technology", ["license", "source"]), ("location", ["north", "south"]), ("other_language", ["quedo", "schein", "elle"])]


@query("""SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'source') THEN 'technology'
  WHEN contains(lower(text), 'north') OR contains(lower(text), 'south') THEN 'location'
  WHEN contains(lower(text), 'quedo') OR contains(lower(text), 'schein') OR contains(lower(text), 'elle') THEN 'other_language' ELSE 'other' END AS category FROM documents) GROUP BY 1 UNION ALL SELECT 'none', 0""")
def category_histogram(spark, d):
    label = S.first_match(F.col("text"), CATEGORIES, "other")
    return catalog.histogram(read(spark, d, "documents"), label, ["technology", "other", "none"])


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS labels, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1")
def string_aggregate(spark, d):
    rows = read(spark, d, "orders")
    return catalog.listed(rows, "o_custkey", "o_orderpriority", "labels").join(rows.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("kinds")), "o_custkey")


@query("""SELECT vec_id, label, round(CASE WHEN h = l THEN 0.5 ELSE (v - l) / (h - l) END, 6) AS norm FROM (SELECT vec_id, label, v, min(v) OVER (PARTITION BY label) AS l, max(v) OVER (PARTITION BY label) AS h
  FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS v FROM embeddings))""")
def minmax_norm(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("v"))
    return rows.select("vec_id", "label", r6(S.scaled(F.col("v"), "label")).alias("norm"))


# vectors and fusion

DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COS = f"{DOT} / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
SIMS = f"s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, a.label AS user, {COS} AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


def asked_vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, q0), every twentieth vector, and all vectors as corpus(id, label, v0)."""
    rows = read(spark, d, "embeddings")
    q = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q0"))
    return q, rows.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v0"))


def nearest(spark, d, k: int) -> DataFrame:
    """The k most similar of every twentieth vector, with the user that a query's vector has."""
    rows = read(spark, d, "embeddings")
    q = rows.where("vec_id % 20 = 0")
    found = vectors.nearest(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k)
    return found.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("user")), "query_id")


@query(f"WITH {SIMS} SELECT query_id, id, r::INT AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s) WHERE r <= 50")
def cosine_topk(spark, d):
    return nearest(spark, d, 50).select("query_id", "id", "rank", r6(F.col("sim")).alias("sim"))


@query(f"WITH {SIMS} SELECT query_id, label, round(greatest(0, max(sim)), 6) AS sim FROM s GROUP BY 1, 2")
def cosine_pool_max(spark, d):
    return vectors.pooled_nearest(*asked_vectors(spark, d), "label").withColumn("sim", r6(F.col("sim")))


@query(f"WITH {SIMS} SELECT query_id, label, round(greatest(0, avg(sim)), 6) AS sim FROM s GROUP BY 1, 2")
def cosine_pool_mean(spark, d):
    return vectors.pooled_nearest(*asked_vectors(spark, d), "label", how="mean").withColumn("sim", r6(F.col("sim")))


FUSE = f"WITH {SIMS}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s) SELECT id, round(sum({{}}), 6) AS score FROM l GROUP BY 1"


def _fused(spark, d, method):
    queries, corpus = asked_vectors(spark, d)
    return vectors.fused_nearest(queries, corpus.select("id", "v0"), method).withColumn("score", r6(F.col("score")))


@query(FUSE.format("1.0::DOUBLE / (60 + r)"))
def rrf(spark, d):
    return _fused(spark, d, "rrf")


@query(FUSE.format("sim / (60 + r)"))
def rrf_weighted(spark, d):
    return _fused(spark, d, "weighted")


@query(FUSE.format("0.5::DOUBLE * sim + 0.5::DOUBLE / (60 + r)"))
def rrf_hybrid(spark, d):
    return _fused(spark, d, "hybrid")


@query(f"""WITH p AS (SELECT a.vec_id AS tag, b.vec_id AS id, greatest(0, {COS}) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), q AS (SELECT a.vec_id - 1 AS tag, b.vec_id AS id, greatest(0, {COS}) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 1),
  l AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sim DESC, id) AS r FROM p UNION ALL SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sim DESC, id) AS r FROM q),
  f AS (SELECT tag, id, unnest([sum(1.0::DOUBLE / (60 + r)), sum(sim / (60 + r)), sum(0.5::DOUBLE * sim + 0.5::DOUBLE / (60 + r))]) AS score, unnest(['rrf', 'weighted', 'hybrid']) AS m, sum(sim) / 2 AS mean_sim FROM l GROUP BY 1, 2 HAVING sum(sim) / 2 >= 0.2),
  o AS (SELECT *, row_number() OVER (PARTITION BY tag, m ORDER BY score DESC, id) AS r FROM f) SELECT tag, id, concat('[mode:concat][fuse:', m, ']') AS label, round(score, 6) AS score, round(mean_sim, 6) AS mean_sim FROM o WHERE r <= 5""")
def keydata_recommend(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    tags = [rows.where(F.col("vec_id") % 20 == rest).select((F.col("vec_id") - rest).alias("tag"), F.col("embedding").alias(q)) for rest, q in ((0, "qa"), (1, "qb"))]
    events = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("va"))
    rows = vectors.recommend_nearest(tags[0].join(tags[1], "tag"), events, threshold=0.2, methods=("rrf", "weighted", "hybrid"))
    return rows.select("tag", "id", "label", r6(F.col("score")).alias("score"), r6(F.col("mean_sim")).alias("mean_sim"))


@query(f"""WITH {SIMS}, l AS (SELECT query_id, id, user, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM s), t AS (SELECT * FROM l WHERE r <= 10),
  m AS (SELECT user, id, min(query_id * 1000 + r) AS o FROM t GROUP BY 1, 2) SELECT user, id, row_number() OVER (PARTITION BY user ORDER BY o, id)::INT AS ord FROM m""")
def ordered_union_distinct(spark, d):
    return catalog.distinct_ordered(nearest(spark, d, 10), "user", "id", "query_id", "rank")


# text

TRIM = r"regexp_replace(x, '^[\s\x{3000}\x{00A0}\x{FEFF}]+|[\s\x{3000}\x{00A0}\x{FEFF}]+$', '', 'g')"
SENTENCE_A = rf"list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])', '\1' || chr(10), 'g'), chr(10)), lambda x: {TRIM}), lambda x: length(regexp_replace(x, '[[:punct:]\s。、！？「」『』（）]', '', 'g')) >= 10)"


@query(f"SELECT doc_id, len(s)::INT AS n, coalesce(array_to_string(s, '|'), '') AS joined FROM (SELECT doc_id, {SENTENCE_A} AS s FROM documents)")
def sentence_split_a(spark, d):
    s = text.sentences(F.col("text"), "a")
    return read(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.array_join(s, "|").alias("joined"))


SENTENCE_C = rf"list_filter(list_transform(regexp_split_to_array(text, '[。！？\n]'), lambda x: {TRIM}), lambda x: length(x) > 10)"


@query(f"SELECT doc_id, len(s)::INT AS n, coalesce(array_to_string(s, '|'), '') AS joined FROM (SELECT doc_id, {SENTENCE_C} AS s FROM documents)")
def sentence_split_c(spark, d):
    s = text.sentences(F.col("text"), "c")
    return read(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.array_join(s, "|").alias("joined"))


SENTENCE_B = rf"list_filter(list_transform(regexp_split_to_array(text, '[。！？．!?]+'), lambda x: {TRIM}), lambda x: length(x) > 0)"


@query(f"""SELECT doc_id, len(t)::INT AS n, coalesce(array_to_string(t, '|'), '') AS joined FROM (SELECT doc_id, CASE WHEN len(list_filter(s, lambda x: length(x) >= 10)) > 0 THEN list_filter(s, lambda x: length(x) >= 10) ELSE s[1:5] END AS t
  FROM (SELECT doc_id, {SENTENCE_B} AS s FROM documents))""")
def sentence_split_b(spark, d):
    s = text.sentences(F.col("text"), "b")
    return read(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.array_join(s, "|").alias("joined"))


@query("""WITH k AS (SELECT doc_id, list_filter(['the', 'quedo', 'schein', 'license', 'email', 'moron'], lambda w: contains(lower(text), w)) AS m FROM documents)
  SELECT doc_id, len(m)::INT AS score, array_to_string(m, ',') AS matched_keywords FROM k ORDER BY len(m) DESC, doc_id LIMIT 20""")
def keyword_match_rank(spark, d):
    m = text.matched_keywords(F.coalesce("text", F.lit("")), WORDS)
    rows = read(spark, d, "documents").select("doc_id", F.size(m).alias("score"), F.array_join(m, ",").alias("matched_keywords"))
    return rows.orderBy(F.desc("score"), "doc_id").limit(20)


@query(r"""WITH w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 1)[1:5] AS w FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(w, ',') ELSE coalesce(text, '') END AS keywords FROM w""")
def keyword_fallback(spark, d):
    words = providers.question_keywords(F.col("text"))
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(words, ",").alias("keywords"))


@query("""WITH k AS (SELECT doc_id, len(list_filter(['the', 'quedo', 'schein', 'license', 'email', 'moron'], lambda w: contains(lower(text), w))) AS s FROM documents)
  SELECT doc_id, least(100, s * 10)::INT AS relevance FROM k ORDER BY s DESC, doc_id LIMIT 5""")
def select_fallback(spark, d):
    score = F.size(text.matched_keywords(F.coalesce("text", F.lit("")), WORDS))
    rows = read(spark, d, "documents").select("doc_id", score.alias("s")).orderBy(F.desc("s"), "doc_id").limit(5)
    return rows.select("doc_id", providers.relevance(F.col("s")).alias("relevance"))


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations), w AS (SELECT *, greatest(0.1::DOUBLE, 1 - 0.1::DOUBLE * (r - 1)) AS s,
  CASE WHEN contains(lower(text), 'the') THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS k FROM t) SELECT conv_id, turn, round(s, 6) AS score, round(s * k, 6) AS weighted FROM w WHERE length(text) BETWEEN 20 AND 120""")
def rank_decay_weighting(spark, d):
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    rows = read(spark, d, "conversations").withColumn("s", text.decay(rank)).where(F.length("text").between(20, 120))
    weight = F.when(S.has(F.col("text"), "the"), 0.9).otherwise(0.5)
    return rows.select("conv_id", "turn", r6(F.col("s")).alias("score"), r6(F.col("s") * weight).alias("weighted"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS sim
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) > 0.7""")
def levenshtein_pairs(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return fuzzy.similar_within(p, "p_partkey", "p_name", ["p_brand", "p_type"], S.edit_similarity, 0.7).withColumn("sim", r6(F.col("sim")))


# normalisation


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM pages")
def html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", normalise.strip_html(F.col("html")).alias("stripped"))


def _page_sql() -> str:
    out = "html"
    for tag in ("script", "style", "nav", "header", "footer"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({out}, '<[^>]*>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages"


@query(_page_sql())
def page_text(spark, d):
    return read(spark, d, "pages").select("page_id", normalise.page_text(F.col("html")).alias("body"))


TITLE_WORDS = ["Tokyo Hackathon", "ハッカソン", "Coding Contest", "コンテスト", "Results", "LT大会", "ライトニングトーク", "Salt", "Meetup"]
TAG_WORDS = ["hackathon", "ハッカソン", "Contest", "コンテスト", "lightning_talk", "LT", "ライトニングトーク", "contests", "x", None]


def _picked(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


@query("""WITH r AS (SELECT doc_id, coalesce(source, '') || ' ' || (['Tokyo Hackathon', 'ハッカソン', 'Coding Contest', 'コンテスト', 'Results', 'LT大会', 'ライトニングトーク', 'Salt', 'Meetup'])[doc_id % 9 + 1] AS title,
  lower((['hackathon', 'ハッカソン', 'Contest', 'コンテスト', 'lightning_talk', 'LT', 'ライトニングトーク', 'contests', 'x', NULL])[doc_id // 9 % 10 + 1]) AS tag, text FROM documents)
  SELECT doc_id, CASE WHEN contains(title, 'ハッカソン') OR tag = 'hackathon' OR tag = 'ハッカソン' THEN 'HACKATHON' WHEN contains(title, 'コンテスト') OR tag = 'contest' OR tag = 'コンテスト' THEN 'CONTEST'
  WHEN contains(lower(title), 'lt') OR contains(title, 'ライトニングトーク') OR tag = 'lightning_talk' OR tag = 'lt' OR tag = 'ライトニングトーク' THEN 'LIGHTNING_TALK' ELSE 'WORKSHOP' END AS event_type,
  CASE WHEN contains(lower(text), 'オンライン') OR contains(lower(text), 'online') OR contains(lower(text), 'zoom') OR contains(lower(text), 'teams') OR contains(lower(text), 'meet') OR contains(lower(text), 'virtual') THEN 'ONLINE'
  WHEN contains(lower(text), 'ハイブリッド') OR contains(lower(text), 'hybrid') THEN 'HYBRID' ELSE 'OFFLINE' END AS format FROM r""")
def normalise_event(spark, d):
    title = F.concat_ws(" ", F.coalesce("source", F.lit("")), _picked(TITLE_WORDS, F.col("doc_id")))
    tags = F.array(_picked(TAG_WORDS, F.floor(F.col("doc_id") / 9)))
    return read(spark, d, "documents").select("doc_id", normalise.event_type(title, tags).alias("event_type"), normalise.event_format(F.col("text")).alias("format"))


STEM_SQL = "split_part(split_part(split_part(split_part(place, '都', 1), '道', 1), '府', 1), '県', 1)"
# The places of the SQL form, written out by hand: number, stem, formal name.
PLACES_SQL = """pl(n, stem, formal) AS (VALUES (1, '北海道', '北海道'), (2, '青森', '青森県'), (3, '岩手', '岩手県'), (4, '宮城', '宮城県'), (5, '秋田', '秋田県'), (6, '山形', '山形県'), (7, '福島', '福島県'), (8, '茨城', '茨城県'),
  (9, '栃木', '栃木県'), (10, '群馬', '群馬県'), (11, '埼玉', '埼玉県'), (12, '千葉', '千葉県'), (13, '東京', '東京都'), (14, '神奈川', '神奈川県'), (15, '新潟', '新潟県'), (16, '富山', '富山県'), (17, '石川', '石川県'), (18, '福井', '福井県'),
  (19, '山梨', '山梨県'), (20, '長野', '長野県'), (21, '岐阜', '岐阜県'), (22, '静岡', '静岡県'), (23, '愛知', '愛知県'), (24, '三重', '三重県'), (25, '滋賀', '滋賀県'), (26, '京都', '京都府'), (27, '大阪', '大阪府'), (28, '兵庫', '兵庫県'),
  (29, '奈良', '奈良県'), (30, '和歌山', '和歌山県'), (31, '鳥取', '鳥取県'), (32, '島根', '島根県'), (33, '岡山', '岡山県'), (34, '広島', '広島県'), (35, '山口', '山口県'), (36, '徳島', '徳島県'), (37, '香川', '香川県'), (38, '愛媛', '愛媛県'),
  (39, '高知', '高知県'), (40, '福岡', '福岡県'), (41, '佐賀', '佐賀県'), (42, '長崎', '長崎県'), (43, '熊本', '熊本県'), (44, '大分', '大分県'), (45, '宮崎', '宮崎県'), (46, '鹿児島', '鹿児島県'), (47, '沖縄', '沖縄県'))"""
ONLINE_SQL = "regexp_matches(lower({}), 'オンライン|online|zoom|teams|virtual')"


@query(f"""WITH {PLACES_SQL}, p AS (SELECT p_partkey, s.stem || (['都', '府', '県', '', '道 Zoom', ' online', ' VIRTUAL'])[p_partkey % 7 + 1] || (['', '渋谷区', 'x'])[p_partkey % 3 + 1] AS place FROM part JOIN (SELECT n, stem FROM pl UNION ALL SELECT 48, 'Teams' UNION ALL SELECT 49, 'somewhere') s ON s.n = p_partkey % 49 + 1),
  f AS (SELECT p_partkey, arg_min(formal, n) AS formal FROM p JOIN pl ON contains(place, pl.stem) GROUP BY 1)
  SELECT p_partkey, place, coalesce(formal, CASE WHEN {ONLINE_SQL.format("place")} THEN 'オンライン' END, '不明') AS named_first, CASE WHEN {ONLINE_SQL.format("place")} THEN 'オンライン' ELSE coalesce(formal, '不明') END AS online_first,
  {STEM_SQL} AS stem, CASE WHEN starts_with(place, '京都') THEN '京都' WHEN starts_with(place, '北海道') THEN '北海道' ELSE {STEM_SQL} END AS stem_corrected FROM p LEFT JOIN f USING (p_partkey)""")
def prefecture_lookup(spark, d):
    n = F.col("p_partkey")
    place = F.concat(_picked([*normalise.PREFECTURES, "Teams", "somewhere"], n), _picked(["都", "府", "県", "", "道 Zoom", " online", " VIRTUAL"], n), _picked(["", "渋谷区", "x"], n))
    p = F.col("place")
    return read(spark, d, "part").select("p_partkey", place.alias("place")).select("p_partkey", "place", normalise.location(p).alias("named_first"), normalise.location(p, online_first=True).alias("online_first"), normalise.prefecture_stem(p).alias("stem"), normalise.prefecture_stem(p, corrected=True).alias("stem_corrected"))


@query("""WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey % 4 AS kind, o_custkey % 90 AS n FROM orders) SELECT o_orderkey, CASE WHEN kind < 2 THEN day + INTERVAL 19 HOUR END AS starts, CASE kind WHEN 0 THEN day + INTERVAL 1290 MINUTE WHEN 1 THEN day + INTERVAL 19 HOUR END AS ends,
  CASE WHEN kind = 2 THEN '2025-' || strftime(day, '%m-%d') END AS day, CASE WHEN kind = 3 THEN n ELSE 0 END::INT AS current, CASE WHEN kind = 3 THEN n + 5 ELSE 0 END::INT AS most FROM r WHERE NOT (kind = 2 AND strftime(day, '%m-%d') = '02-29')""")
def date_and_capacity_parse(spark, d):
    """Scraped texts as pages word them, with the dates and numbers of orders."""
    day, n = F.col("o_orderdate"), (F.col("o_custkey") % 90)
    kind = F.col("o_orderkey") % 4
    slashed = F.date_format(day, "yyyy/MM/dd")
    raw = F.when(kind == 0, F.concat(slashed, F.lit("(火)19:00～21:30"))).when(kind == 1, F.concat(slashed, F.lit("(火)19:00")))
    raw = raw.when(kind == 2, F.concat(F.lit("受付, "), F.date_format(day, "M月d日"), F.lit("(土)"))).otherwise(F.concat(n.cast("string"), F.lit("人 ／ 定員"), (n + 5).cast("string"), F.lit("人")))
    rows = read(spark, d, "orders").where((kind != 2) | (F.date_format(day, "MM-dd") != "02-29")).select("o_orderkey", raw.alias("raw"))
    low, high = normalise.time_range(F.col("raw"))
    now, most = normalise.capacity(F.col("raw"))
    return rows.select("o_orderkey", low.cast("timestamp_ntz").alias("starts"), high.cast("timestamp_ntz").alias("ends"), normalise.month_day(F.col("raw"), 2025).cast("string").alias("day"), now.alias("current"), most.alias("most"))


@query("SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def json_extract(spark, d):
    body = F.regexp_extract("props", r"(?s)\{.*\}", 0)
    return read(spark, d, "events").select("event_id", F.from_json(body, "k int")["k"].alias("k"))


