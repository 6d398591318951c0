"""Queries of the text operators over documents, conversations and pages, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import classify, extractors, fuzzy, text
from .catalog_queries import SENTENCE_A, SENTENCE_B, SENTENCE_C, TOKENS_SQL, query, r6, read


def tokens_sql(x: str) -> str:
    return TOKENS_SQL.replace("text", x)


#: (doc_id, i, t, w): sentences with tokens, numbered from 0 among all sentences of the text; w: the first ten tokens.
def sentence_rows(kind: str) -> str:
    return f"""sl AS (SELECT doc_id, {kind} AS s FROM documents), sx AS (SELECT doc_id, len(s) AS n_s, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i FROM sl),
  sw AS (SELECT doc_id, n_s, i, t, {tokens_sql("t")}[1:10] AS w FROM sx)"""


#: scores (doc_id, node, s) of nodes (doc_id, node) by edges (doc_id, src, dst, w), stopping as the operator does.
def page_rank_sql(rounds: int, tolerance: str = "1e-4") -> str:
    return f"""sh AS MATERIALIZED (SELECT doc_id, src, dst, w / sum(w) OVER (PARTITION BY doc_id, src) AS share FROM edges),
  pr AS (SELECT doc_id, node, 1.0::DOUBLE AS s, 0 AS it, false AS done FROM nodes UNION ALL
    SELECT doc_id, node, s2, it + 1, max(abs(s2 - s)) OVER (PARTITION BY doc_id) < {tolerance} FROM (
      SELECT n.doc_id, n.node, n.s, n.it, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(g.g, 0) AS s2 FROM pr n
      LEFT JOIN (SELECT p.doc_id, sh.dst AS node, sum(sh.share * p.s) AS g FROM pr p JOIN sh ON sh.doc_id = p.doc_id AND sh.src = p.node WHERE NOT p.done GROUP BY 1, 2) g ON g.doc_id = n.doc_id AND g.node = n.node WHERE NOT n.done AND n.it < {rounds})),
  scores AS (SELECT doc_id, node, arg_max(s, it) AS s FROM pr GROUP BY 1, 2)"""


JACCARD_EDGES = """sd AS (SELECT doc_id, i, list_distinct(w) AS w FROM sw WHERE len(w) > 0), su AS (SELECT doc_id, i, len(w) AS n, unnest(w) AS x FROM sd),
  edges AS (SELECT a.doc_id, a.i AS src, b.i AS dst, count(*)::DOUBLE / (a.n + b.n - count(*)) AS w FROM su a JOIN su b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i <> b.i GROUP BY a.doc_id, a.i, b.i, a.n, b.n)"""


def docs(spark, d):
    """The texts, dealt over the cores: a file of one row group is one task otherwise."""
    return read(spark, d, "documents").select("doc_id", "text").repartition("doc_id")


@query(f"WITH {sentence_rows(SENTENCE_A)}, {JACCARD_EDGES} SELECT doc_id, count(*) AS n_pairs, round(sum(w), 6) AS total FROM edges GROUP BY 1")
def sentence_jaccard(spark, d):
    rows = text.sentence_pairs(docs(spark, d), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), r6(F.sum("sim")).alias("total"))


def textrank_sql(share: str = "0.4", source: str = "documents") -> str:
    """CTEs up to picked (doc_id, i, t, s), the sentences chosen, and listed (doc_id, l, few, s): those in order, and all."""
    return f"""{sentence_rows(SENTENCE_A).replace("FROM documents", f"FROM {source}")}, {JACCARD_EDGES}, nodes AS (SELECT doc_id, i AS node FROM sd), {page_rank_sql(50)},
  kept AS (SELECT doc_id, count(*) AS n FROM nodes GROUP BY 1),
  best AS (SELECT s.doc_id, node, s, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(s, 9) DESC, node) AS r, n FROM scores s JOIN kept USING (doc_id)),
  fw AS (SELECT sw.doc_id, i, t, row_number() OVER (PARTITION BY sw.doc_id ORDER BY i) AS r FROM sw LEFT JOIN kept USING (doc_id) WHERE coalesce(n, 0) < 2 AND (n_s < 2 OR len(w) > 0)),
  picked AS (SELECT b.doc_id, node AS i, t, s FROM best b JOIN sw ON sw.doc_id = b.doc_id AND sw.i = b.node WHERE n >= 2 AND r <= least(10, ceil({share}::DOUBLE * n)) UNION ALL SELECT doc_id, i, t, 1.0 FROM fw WHERE r <= 5),
  pl AS (SELECT doc_id, list(t ORDER BY i) AS l FROM picked GROUP BY 1),
  listed AS (SELECT sl.doc_id, coalesce(l, []::VARCHAR[]) AS l, coalesce(n, 0) < 2 AS few, coalesce(s, []::VARCHAR[]) AS s FROM sl LEFT JOIN pl USING (doc_id) LEFT JOIN kept USING (doc_id))"""


@query(f"WITH RECURSIVE {textrank_sql()} SELECT doc_id, i::INT AS ord, t AS sentence, round(s, 6) AS score FROM picked")
def textrank_sentences(spark, d):
    rows = extractors.rank_sentences(docs(spark, d), "doc_id", "text").select("doc_id", F.explode("found").alias("x"))
    return rows.select("doc_id", F.col("x.ord").alias("ord"), F.col("x.text").alias("sentence"), r6(F.col("x.score")).alias("score"))


WORDS_SQL = f"tk AS (SELECT doc_id, unnest({TOKENS_SQL}) AS w, generate_subscripts({TOKENS_SQL}, 1) AS p FROM documents), tl AS (SELECT doc_id, p, lower(w) AS w FROM tk)"


@query(f"""WITH {WORDS_SQL}
  SELECT a.doc_id, least(a.w, b.w) AS a, greatest(a.w, b.w) AS b, count(*) AS n FROM tl a JOIN tl b ON a.doc_id = b.doc_id AND b.p > a.p AND b.p <= a.p + 2 AND a.w <> b.w GROUP BY 1, 2, 3""")
def cooccurrence_band(spark, d):
    return text.forward_pairs(docs(spark, d), "doc_id", F.transform(text.tokens(F.col("text"), None), F.lower), 2)


@query(f"""WITH RECURSIVE {WORDS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM tl GROUP BY 1), nodes AS (SELECT doc_id, w AS node, min(p) AS p FROM tl JOIN n USING (doc_id) WHERE n >= 3 GROUP BY 1, 2),
  edges AS (SELECT a.doc_id, a.w AS src, b.w AS dst, count(*)::DOUBLE AS w FROM tl a JOIN tl b ON a.doc_id = b.doc_id AND a.p <> b.p AND abs(a.p - b.p) <= 2 AND a.w <> b.w GROUP BY 1, 2, 3),
  {page_rank_sql(30)}, best AS (SELECT doc_id, node, s, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, p) AS r FROM scores JOIN nodes USING (doc_id, node))
  SELECT doc_id, r::INT AS rank, node AS word, round(s, 6) AS score FROM best WHERE r <= 20 UNION ALL SELECT doc_id, p::INT, w, 1.0 FROM tl JOIN n USING (doc_id) WHERE n < 3""")
def textrank_keywords(spark, d):
    return text.rank_words(docs(spark, d), "doc_id", "text").withColumn("score", r6(F.col("score")))


ALL_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(text, '[[:punct:]。、！？「」『』（）]', ' ', 'g'), '\s+'), lambda x: length(x) > 0)"


# Words within five places meet by equal places, shifted; nodes are numbers, as PageRank joins them round by round.
WORD_RANKS = f"""tk AS (SELECT doc_id, unnest({ALL_WORDS}) AS w, generate_subscripts({ALL_WORDS}, 1) AS p FROM documents),
  tl AS MATERIALIZED (SELECT doc_id, p, w AS form, dense_rank() OVER (ORDER BY doc_id, lower(w)) AS w FROM tk WHERE length(w) >= 2),
  v AS (SELECT doc_id, count(DISTINCT w) AS v FROM tl GROUP BY 1), nodes AS MATERIALIZED (SELECT doc_id, w AS node, min(p) AS p, arg_min(form, p) AS form, count(*) AS n FROM tl JOIN v USING (doc_id) WHERE v >= 2 GROUP BY 1, 2),
  ahead AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM (SELECT doc_id, p, w, unnest([1, 2, 3, 4, 5]) AS d FROM tl) a JOIN tl b ON b.doc_id = a.doc_id AND b.p = a.p + a.d WHERE a.w <> b.w),
  edges AS MATERIALIZED (SELECT doc_id, src, dst, count(*)::DOUBLE AS w FROM (SELECT doc_id, x AS src, y AS dst FROM ahead UNION ALL SELECT doc_id, y, x FROM ahead) GROUP BY 1, 2, 3),
  {page_rank_sql(50)}, best AS (SELECT doc_id, form, s * ln(n + 1) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY round(s * ln(n + 1), 9) DESC, p) AS r FROM scores JOIN nodes USING (doc_id, node))"""


@query(f"WITH RECURSIVE {WORD_RANKS} SELECT doc_id, r::INT AS rank, form AS word, round(s, 6) AS score FROM best WHERE r <= 50")
def word_textrank(spark, d):
    return extractors.rows_of(extractors.word_ranks(docs(spark, d), "doc_id", "text"), "doc_id", "word").withColumn("score", r6(F.col("score")))


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS w, generate_subscripts({TOKENS_SQL}, 1) - 1 AS p FROM documents), c AS (SELECT doc_id, lower(w) AS w, p // 15 AS chunk FROM t),
  k AS (SELECT doc_id, chunk FROM c GROUP BY 1, 2 HAVING count(*) >= 3), x AS (SELECT c.* FROM c JOIN k USING (doc_id, chunk)), f AS (SELECT doc_id, chunk, w, count(*) AS tf FROM x GROUP BY 1, 2, 3),
  n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1), g AS (SELECT f.*, count(*) OVER (PARTITION BY f.doc_id, w) AS df FROM f),
  s AS (SELECT g.doc_id, chunk, w, round(tf * (1 + ln(n.n / (1 + df))), 9) AS s FROM g JOIN n USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY s DESC, w) AS r FROM s),
  m AS (SELECT doc_id, w, max(s) AS score FROM b WHERE r <= 10 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w) AS r FROM m),
  z AS (SELECT doc_id, count(*) AS words FROM t GROUP BY 1), few AS (SELECT z.doc_id, words FROM z LEFT JOIN n USING (doc_id) WHERE words < 10 OR coalesce(n, 0) < 2)
  SELECT doc_id, r::INT AS rank, w AS word, round(score, 6) AS score FROM o WHERE r <= 20 AND doc_id NOT IN (SELECT doc_id FROM few)
  UNION ALL SELECT doc_id, (p + 1)::INT, lower(w), NULL FROM t JOIN few USING (doc_id) WHERE p < CASE WHEN words < 10 THEN 10 ELSE 20 END""")
def tfidf_keywords(spark, d):
    return text.chunk_tfidf(docs(spark, d), "doc_id", "text").withColumn("score", r6(F.col("score")))


TFIDF_SCORES = f"""{sentence_rows(f"CASE WHEN len(list_filter({SENTENCE_B}, lambda x: length(x) >= 10)) > 0 THEN list_filter({SENTENCE_B}, lambda x: length(x) >= 10) ELSE ({SENTENCE_B})[1:5] END")},
  tw AS (SELECT doc_id, i, len(w) AS n, unnest(w) AS x FROM sw), tf AS (SELECT doc_id, i, x, count(*) AS c, n FROM tw GROUP BY ALL), df AS (SELECT doc_id, x, count(*) AS df FROM tf GROUP BY 1, 2),
  ts AS (SELECT tf.doc_id, i, sum(c * (c / n * ln(n_s / df))) FILTER (c / n * ln(n_s / df) > 0) / sum(c) FILTER (c / n * ln(n_s / df) > 0) AS s FROM tf JOIN df USING (doc_id, x) JOIN (SELECT DISTINCT doc_id, n_s FROM sw) USING (doc_id) GROUP BY 1, 2),
  sc AS (SELECT sw.doc_id, sw.i, sw.t, coalesce(s, 0) AS s FROM sw LEFT JOIN ts ON ts.doc_id = sw.doc_id AND ts.i = sw.i)"""


@query(f"WITH {TFIDF_SCORES} SELECT doc_id, count(*) AS n, round(avg(s) FILTER (s > 0), 6) AS mean, round(max(s) FILTER (s > 0), 6) AS most, round(min(s) FILTER (s > 0), 6) AS least FROM sc GROUP BY 1")
def sentence_score_statistics(spark, d):
    x = extractors.weigh_sentences(docs(spark, d), "doc_id", "text").select("doc_id", F.explode("found").alias("x")).select("doc_id", F.col("x.score").alias("s"))
    some = F.when(F.col("s") > 0, F.col("s"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), r6(F.avg(some)).alias("mean"), r6(F.max(some)).alias("most"), r6(F.min(some)).alias("least"))


@query(f"""WITH RECURSIVE {TFIDF_SCORES}, st AS (SELECT doc_id, avg(s) * 1.2::DOUBLE AS least, count(*) AS n FROM sc WHERE s > 0 GROUP BY 1),
  ov AS (SELECT doc_id, count(*) AS n_over FROM sc JOIN st USING (doc_id) WHERE s > 0 AND s >= least GROUP BY 1),
  ch AS (SELECT sc.doc_id, i, t, s, CASE WHEN st.n IS NULL THEN i WHEN coalesce(n_over, 0) < least(20, 0.3::DOUBLE * st.n) THEN NULL ELSE i END AS o FROM sc LEFT JOIN st USING (doc_id) LEFT JOIN ov USING (doc_id)
    WHERE st.n IS NULL OR s > 0 AND (s >= least OR coalesce(n_over, 0) < least(20, 0.3::DOUBLE * st.n))),
  rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, round(s, 9) DESC, i) AS r FROM ch), ls AS (SELECT doc_id, list(struct_pack(i := i, t := t, s := s) ORDER BY r) AS l FROM rk WHERE r <= 20 GROUP BY 1),
  fo AS (SELECT doc_id, l, 0 AS k, l[1:0] AS kept FROM ls UNION ALL SELECT doc_id, l, k + 1, CASE WHEN len(list_filter(kept, lambda y: len(list_intersect(list_distinct(string_split(y.t, '')), list_distinct(string_split(l[k + 1].t, ''))))
    / len(list_distinct(list_concat(string_split(y.t, ''), string_split(l[k + 1].t, '')))) > 0.8)) > 0 THEN kept ELSE list_append(kept, l[k + 1]) END FROM fo WHERE k < len(l)),
  un AS (SELECT doc_id, unnest(kept) AS x FROM fo WHERE k = len(l)) SELECT doc_id, x.i::INT AS ord, x.t AS sentence, round(x.s, 6) AS score FROM un""")
def tfidf_sentences(spark, d):
    rows = extractors.tfidf_sentences(docs(spark, d), "doc_id", "text").select("doc_id", F.explode("found").alias("x"))
    return rows.select("doc_id", F.col("x.ord").alias("ord"), F.col("x.text").alias("sentence"), r6(F.col("x.score")).alias("score"))


@query(f"""WITH {sentence_rows(SENTENCE_A)}, tw AS (SELECT doc_id, i, unnest(w) AS x FROM sw WHERE len(w) > 0), tf AS (SELECT doc_id, i, x, count(*)::DOUBLE AS c FROM tw GROUP BY ALL),
  nm AS (SELECT doc_id, i, sqrt(sum(c * c)) AS norm FROM tf GROUP BY 1, 2), v AS (SELECT doc_id, i, x, c / norm AS c FROM tf JOIN nm USING (doc_id, i)), k AS (SELECT doc_id, count(*) AS n FROM nm GROUP BY 1),
  p AS (SELECT a.doc_id, a.i, sum(a.c * b.c) AS s FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i <> b.i GROUP BY 1, 2)
  SELECT doc_id, count(*) AS n, round(sum(coalesce(s, 0) / greatest(k.n - 1, 1)), 6) AS total, round(max(coalesce(s, 0) / greatest(k.n - 1, 1)), 6) AS most FROM nm LEFT JOIN p USING (doc_id, i) JOIN k USING (doc_id) GROUP BY 1""")
def sentence_centrality(spark, d):
    """Without deduplication or limit, so all scores are compared."""
    x = extractors.central_sentences(docs(spark, d), "doc_id", "text", most=1 << 30, least=2.0).select("doc_id", F.explode("found").alias("x"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), r6(F.sum("x.score")).alias("total"), r6(F.max("x.score")).alias("most"))


@query()
def central_sentences(spark, d):
    return extractors.rows_of(extractors.central_sentences(docs(spark, d), "doc_id", "text"), "doc_id", "sentence").withColumn("score", r6(F.col("score")))


@query()
def topicrank(spark, d):
    return extractors.rows_of(extractors.topic_words(docs(spark, d), "doc_id", "text"), "doc_id", "phrase").withColumn("score", r6(F.col("score")))


@query()
def multipartite(spark, d):
    return extractors.rows_of(extractors.multipartite_sentences(docs(spark, d), "doc_id", "text"), "doc_id", "sentence").withColumn("score", r6(F.col("score")))


# classes


def class_sql(rules, default: str, x: str) -> str:
    def any_of(words):
        return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"

    out = "CASE"
    for label, words in rules:
        test = any_of(words) + (f" AND NOT {any_of(classify.ONLINE)}" if rules is classify.PHRASE_RULES and words is classify.PLACES else "")
        out += f" WHEN {test} THEN '{label}'"
    return f"{out} ELSE '{default}' END"


def weight_sql(weights, missing: float, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v or missing}::DOUBLE" for k, v in weights.items()) + f" ELSE {missing}::DOUBLE END"


@query(f"SELECT {class_sql(classify.PHRASE_RULES, 'other', 't')} AS category, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS t FROM documents) GROUP BY 1")
def phrase_categories(spark, d):
    words = read(spark, d, "documents").select(F.explode(text.tokens(F.col("text"), None)).alias("t"))
    different = words.groupBy("t").agg(F.count("*").alias("n"))  # a word's class is looked up once
    return different.groupBy(classify.phrase_category(F.col("t")).alias("category")).agg(F.sum("n").alias("n"))


@query(f"SELECT {class_sql(classify.SENTENCE_RULES, 'contextual', 't')} AS kind, count(*) AS n FROM (SELECT unnest({SENTENCE_C}) AS t FROM documents) GROUP BY 1")
def sentence_types(spark, d):
    rows = read(spark, d, "documents").select(F.explode(text.sentences(F.col("text"), "c")).alias("t"))
    return rows.groupBy(classify.sentence_type(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT {class_sql(classify.KEYWORD_RULES, 'other', 't')} AS category, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS t FROM documents) GROUP BY 1")
def keyword_categories(spark, d):
    words = read(spark, d, "documents").select(F.explode(text.tokens(F.col("text"), None)).alias("t"))
    different = words.groupBy("t").agg(F.count("*").alias("n"))  # a word's class is looked up once
    return different.groupBy(classify.keyword_category(F.col("t")).alias("category")).agg(F.sum("n").alias("n"))


def refined_sql(items: str, label: str, weights, missing: float, step: str, low: int, high: int) -> str:
    """(doc_id, i, t, category, score, weighted) of lists items(doc_id, l)."""
    return f"""ri AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM {items}), rc AS (SELECT doc_id, i, t, {label} AS category, greatest(0.1::DOUBLE, 1 - {step}::DOUBLE * i) AS score FROM ri),
  rw AS (SELECT *, score * {weight_sql(weights, missing, "category")} AS weighted FROM rc WHERE length(t) BETWEEN {low} AND {high})"""


@query(f"""WITH it AS (SELECT doc_id, {TOKENS_SQL} AS l FROM documents), {refined_sql("it", class_sql(classify.KEYWORD_RULES, "other", "t"), classify.KEYWORD_WEIGHTS, 1.0, "0.1", 2, 15)},
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weighted DESC, i) AS r FROM rw) SELECT doc_id, r::INT AS rank, t AS keyword, category, round(score, 6) AS score, round(weighted, 6) AS weighted FROM o WHERE r <= 10""")
def keyword_refinement(spark, d):
    items = extractors.refine_keywords(text.tokens(F.col("text"), None))
    x = read(spark, d, "documents").select("doc_id", F.posexplode(items).alias("p", "x"))
    return x.select("doc_id", (F.col("p") + 1).alias("rank"), F.col("x.text").alias("keyword"), "x.category", r6(F.col("x.score")).alias("score"), r6(F.col("x.weighted")).alias("weighted"))


DEDUP = """{0} AS (SELECT doc_id, list(struct_pack(t := t, category := category, weighted := weighted) ORDER BY i) AS l FROM {1} GROUP BY 1),
  fo AS (SELECT doc_id, l, 0 AS k, l[1:0] AS kept, NULL::BIGINT AS at FROM {0} UNION ALL SELECT doc_id, l, k + 1, CASE WHEN hit = 0 THEN list_append(kept, l[k + 1])
    WHEN l[k + 1].weighted > kept[hit].weighted THEN list_concat(list_append(kept[1:hit - 1], l[k + 1]), kept[hit + 1:]) ELSE kept END, hit
    FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda y: 1 - levenshtein(lower(y.t), lower(l[k + 1].t)) / greatest(length(y.t), length(l[k + 1].t)) >= {2}), true), 0) AS hit FROM fo WHERE k < len(l))),
  dd AS (SELECT doc_id, unnest(kept) AS x, generate_subscripts(kept, 1) AS o FROM fo WHERE k = len(l))"""


@query(f"""WITH RECURSIVE it AS (SELECT conv_id * 1000 + turn AS doc_id, {SENTENCE_C} AS l FROM conversations), {refined_sql("it", class_sql(classify.SENTENCE_RULES, "contextual", "t"), classify.SENTENCE_WEIGHTS, 1.0, "0.15", 20, 120)},
  {DEDUP.format("dl", "rw", "0.8")}, wo AS (SELECT doc_id, x, o FROM dd WHERE NOT ({" OR ".join(f"contains(lower(x.t), '{w}')" for w in extractors.STRONG_NOISE)}) AND NOT (x.category = 'actionable' AND x.weighted < 0.7))
  SELECT doc_id AS place, row_number() OVER (PARTITION BY doc_id ORDER BY x.weighted DESC, o)::INT AS rank, x.t AS sentence, x.category AS kind, round(x.weighted, 6) AS weighted FROM wo""")
def sentence_refinement(spark, d):
    items = extractors.refine_sentences(text.sentences(F.col("text"), "c"))
    x = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("place"), F.posexplode(items).alias("p", "x"))
    return x.select("place", (F.col("p") + 1).alias("rank"), F.col("x.text").alias("sentence"), F.col("x.category").alias("kind"), r6(F.col("x.weighted")).alias("weighted"))


@query(f"""WITH RECURSIVE it AS (SELECT conv_id * 1000 + turn AS doc_id, {SENTENCE_A} AS l FROM conversations), {refined_sql("it", class_sql(classify.PHRASE_RULES, "other", "t"), classify.PHRASE_WEIGHTS, 0.5, "0.1", 6, 30)},
  rn AS (SELECT * FROM rw WHERE NOT (category = 'other' AND weighted < 0.25)), {DEDUP.format("dl", "rn", "0.75")}
  SELECT doc_id AS place, row_number() OVER (PARTITION BY doc_id ORDER BY x.weighted DESC, o)::INT AS rank, x.t AS phrase, x.category, round(x.weighted, 6) AS weighted FROM dd""")
def phrase_refinement(spark, d):
    items = extractors.refine_phrases(text.sentences(F.col("text"), "a"))
    x = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("place"), F.posexplode(items).alias("p", "x"))
    return x.select("place", (F.col("p") + 1).alias("rank"), F.col("x.text").alias("phrase"), "x.category", r6(F.col("x.weighted")).alias("weighted"))


@query(f"""WITH RECURSIVE l AS (SELECT conv_id, turn, {SENTENCE_C} AS s FROM conversations), f AS (SELECT conv_id, turn, s, 0 AS k, s[1:0] AS kept FROM l UNION ALL
  SELECT conv_id, turn, s, k + 1, CASE WHEN len(list_filter(kept, lambda y: 1 - levenshtein(y, s[k + 1]) / greatest(length(y), length(s[k + 1])) >= 0.8)) > 0 THEN kept ELSE list_append(kept, s[k + 1]) END FROM f WHERE k < len(s))
  SELECT conv_id, turn, len(kept)::INT AS n, coalesce(array_to_string(kept, '|'), '') AS kept FROM f WHERE k = len(s)""")
def greedy_dedup(spark, d):
    s = text.keep_first(text.sentences(F.col("text"), "c"), text.alike_by_edits(0.8))
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(s).alias("n"), F.array_join(s, "|").alias("kept"))


# whole extractors: what they return for each text


def _joined(found, name):
    return found.select("doc_id", F.size(name).alias("n"), F.array_join(name, "|").alias(name))


def clean_sql(x: str) -> str:
    return rf"list_filter(list_transform({x}, lambda y: trim(regexp_replace(regexp_replace(regexp_replace(y, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g'))), lambda y: length(y) > 0)"


KEY_PHRASES = f"""WITH RECURSIVE {textrank_sql()}, it AS (SELECT doc_id, l FROM listed WHERE NOT few), {refined_sql("it", class_sql(classify.PHRASE_RULES, "other", "t"), classify.PHRASE_WEIGHTS, 0.5, "0.1", 6, 30)},
  rn AS (SELECT * FROM rw WHERE NOT (category = 'other' AND weighted < 0.25)), {DEDUP.format("dl", "rn", "0.75")}, bl AS (SELECT doc_id, list(x.t ORDER BY x.weighted DESC, o) AS b FROM dd GROUP BY 1),
  fs AS (SELECT doc_id, CASE WHEN few THEN l ELSE coalesce(b, []::VARCHAR[]) END AS a, CASE WHEN few THEN s ELSE l END AS c FROM listed LEFT JOIN bl USING (doc_id)),
  pd AS (SELECT doc_id, list_concat(a, list_filter(c, lambda x, i: list_position(c, x) = i AND NOT list_contains(a, x))[1:greatest(0, 3 - len(a))]) AS v FROM fs) SELECT doc_id, {clean_sql("v")} AS v FROM pd"""
KEY_SENTENCES = f"""WITH RECURSIVE {textrank_sql("0.5")}, it AS (SELECT doc_id, l FROM listed WHERE NOT few), {refined_sql("it", class_sql(classify.SENTENCE_RULES, "contextual", "t"), classify.SENTENCE_WEIGHTS, 1.0, "0.15", 20, 120)},
  {DEDUP.format("dl", "rw", "0.8")}, wo AS (SELECT doc_id, x, o FROM dd WHERE NOT ({" OR ".join(f"contains(lower(x.t), '{w}')" for w in extractors.STRONG_NOISE)}) AND NOT (x.category = 'actionable' AND x.weighted < 0.7)),
  bl AS (SELECT doc_id, list(x.t ORDER BY x.weighted DESC, o) AS b FROM wo GROUP BY 1), fs AS (SELECT doc_id, CASE WHEN few THEN l ELSE coalesce(b, []::VARCHAR[]) END AS v FROM listed LEFT JOIN bl USING (doc_id)) SELECT doc_id, {clean_sql("v")} AS v FROM fs"""
KEY_WORDS = f"""WITH RECURSIVE {WORD_RANKS}, it AS (SELECT doc_id, list(form ORDER BY r) AS l FROM best WHERE r <= 50 GROUP BY 1), {refined_sql("it", class_sql(classify.KEYWORD_RULES, "other", "t"), classify.KEYWORD_WEIGHTS, 1.0, "0.1", 2, 15)},
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weighted DESC, i) AS r FROM rw), g AS (SELECT doc_id, list(t ORDER BY r) AS v FROM o WHERE r <= 10 GROUP BY 1) SELECT doc_id, coalesce(v, []::VARCHAR[]) AS v FROM documents LEFT JOIN g USING (doc_id)"""


def joined_sql(found: str, name: str) -> str:
    return f"SELECT doc_id, len(v)::INT AS n, coalesce(array_to_string(v, '|'), '') AS {name} FROM ({found})"


@query(joined_sql(KEY_PHRASES, "phrases"))
def key_phrases(spark, d):
    return _joined(extractors.key_phrases(docs(spark, d), "doc_id", "text"), "phrases")


@query(joined_sql(KEY_SENTENCES, "sentences"))
def key_sentences(spark, d):
    return _joined(extractors.key_sentences(docs(spark, d), "doc_id", "text"), "sentences")


@query(joined_sql(KEY_WORDS, "keywords"))
def key_words(spark, d):
    return _joined(extractors.key_words(docs(spark, d), "doc_id", "text"), "keywords")


@query(f"SELECT a.doc_id, coalesce(array_to_string(a.v, '|'), '') AS keywords, coalesce(array_to_string(b.v, '|'), '') AS phrases, coalesce(array_to_string(c.v, '|'), '') AS sentences FROM ({KEY_WORDS}) a JOIN ({KEY_PHRASES}) b ON b.doc_id = a.doc_id JOIN ({KEY_SENTENCES}) c ON c.doc_id = a.doc_id")
def event_key_data(spark, d):
    found = extractors.event_key_data(docs(spark, d), "doc_id", "text")
    return found.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("keywords", "phrases", "sentences")])


@query(f"""WITH RECURSIVE sm AS (SELECT doc_id, text AS whole, CASE WHEN length(text) > 350 THEN left(text, 350) ELSE text END AS text FROM documents), {textrank_sql(source="sm")},
  tt AS (SELECT doc_id, list_transform(list_concat({", ".join(f"regexp_extract_all(coalesce(whole, ''), '(?i)(?:{p})')" for p in classify.TECH_TERMS)}), lambda x: lower(x)) AS q FROM sm), tm AS (SELECT doc_id, list_filter(q, lambda x, i: list_position(q, x) = i) AS q FROM tt),
  fd AS (SELECT doc_id, q, 0 AS k, l AS v FROM listed JOIN tm USING (doc_id) UNION ALL SELECT doc_id, q, k + 1, CASE WHEN len(v) < 6 AND len(list_filter(v, lambda x: contains(lower(x), q[k + 1]))) = 0 THEN list_append(v, q[k + 1] || 'を活用') ELSE v END FROM fd WHERE k < len(q))
  SELECT doc_id, len(v)::INT AS n, coalesce(array_to_string(v, '|'), '') AS phrases FROM fd WHERE k = len(q)""")
def summary_phrases(spark, d):
    return _joined(extractors.summary_phrases(docs(spark, d), "doc_id", "text"), "phrases")


RUNS = "[ァ-ヴー]+|[ぁ-ゔー]+|[一-龠]+|[a-zA-Z]+"
TERMS = "list_distinct(list_transform(list_concat({}), lambda x: lower(x)))"


def terms_sql(x: str) -> str:
    parts = ", ".join(f"regexp_extract_all({x}, '(?i)(?:{p})')" for p in classify.TECH_TERMS)
    return TERMS.format(parts)


@query(f"""WITH q AS (SELECT doc_id, text, CASE WHEN length(text) > 350 THEN left(text, 350) ELSE text END AS s FROM documents), w AS (SELECT *, list_distinct(regexp_extract_all(text, '{RUNS}')) AS a, list_distinct(regexp_extract_all(s, '{RUNS}')) AS b,
  len({terms_sql("text")}) AS ta, len({terms_sql("s")}) AS tb FROM q) SELECT doc_id, floor(length(s) / length(text) * 100 + 0.5) / 100 AS compression_ratio, length(text) - length(s) AS length_reduction,
  floor(len(list_intersect(a, b)) / nullif(len(a), 0) * 100 + 0.5) / 100 AS word_preservation, CASE WHEN ta > 0 THEN floor(tb / ta * 100 + 0.5) / 100 ELSE 1.0::DOUBLE END AS term_preservation FROM w WHERE length(text) > 0""")
def summary_quality(spark, d):
    rows = read(spark, d, "documents").where("length(text) > 0").withColumn("s", extractors.summarised(F.col("text")))
    found = extractors.summary_quality(F.col("text"), F.col("s"))
    kinds = {"compression_ratio": "double", "length_reduction": "long", "word_preservation": "double", "term_preservation": "double"}
    return rows.select("doc_id", *[found[c].cast(k).alias(c) for c, k in kinds.items()])


@query(f"SELECT doc_id, len({terms_sql('text')})::INT AS n, coalesce(array_to_string(list_sort({terms_sql('text')}), ','), '') AS terms FROM documents WHERE text IS NOT NULL")
def tech_terms(spark, d):
    found = classify.tech_terms(F.col("text"))
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.size(found).alias("n"), F.array_join(F.array_sort(found), ",").alias("terms"))


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS w, generate_subscripts({TOKENS_SQL}, 1) AS p FROM documents), c AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM t GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS r FROM c), l AS (SELECT doc_id, string_agg(w, ',' ORDER BY r) AS words FROM r WHERE r <= 10 GROUP BY 1)
  SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN l USING (doc_id)""")
def frequent_words(spark, d):
    return extractors.frequent_words(docs(spark, d), "doc_id", "text").select("doc_id", F.array_join("words", ",").alias("words"))


@query(rf"""WITH RECURSIVE gl AS (SELECT doc_id, {SENTENCE_A} AS l FROM documents), gx AS (SELECT doc_id, len(l) AS n, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS node FROM gl), nodes AS (SELECT doc_id, node FROM gx WHERE n >= 2),
  gd AS (SELECT doc_id, node, list_distinct(regexp_split_to_array(t, '\s+')) AS w FROM gx WHERE n >= 2), gu AS (SELECT doc_id, node, len(w) AS n, unnest(w) AS x FROM gd),
  edges AS (SELECT a.doc_id, a.node AS src, b.node AS dst, count(*)::DOUBLE / (a.n + b.n - count(*)) AS w FROM gu a JOIN gu b ON a.doc_id = b.doc_id AND a.x = b.x AND a.node <> b.node GROUP BY a.doc_id, a.node, b.node, a.n, b.n), {page_rank_sql(30)},
  nm AS (SELECT doc_id, node, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0.5 END AS s FROM scores WINDOW w AS (PARTITION BY doc_id)),
  rk AS (SELECT doc_id, node, s, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, node) AS r FROM nm)
  SELECT rk.doc_id, r::INT AS rank, t AS phrase, round(s, 6) AS score FROM rk JOIN gx ON gx.doc_id = rk.doc_id AND gx.node = rk.node WHERE r <= 15 UNION ALL SELECT doc_id, 1, t, 1.0 FROM gx WHERE n = 1""")
def graph_phrases(spark, d):
    lists = docs(spark, d).select("doc_id", F.coalesce(text.sentences(F.col("text"), "a"), F.array().cast("array<string>")).alias("p"))
    return extractors.rows_of(extractors.graph_phrases(lists, "doc_id", "p"), "doc_id", "phrase").withColumn("score", r6(F.col("score")))


LONG_WORDS = r"list_filter(string_split(regexp_replace(text, '[、。！？\.!\?,\s]', ' ', 'g'), ' '), lambda x: length(x) BETWEEN 3 AND 20)"


@query(f"SELECT doc_id, array_to_string(CASE WHEN len({LONG_WORDS}) > 0 THEN ({LONG_WORDS})[1:8] ELSE ['技術セミナー', 'プログラミング', '実践的学習'] END, '|') AS words FROM documents WHERE text IS NOT NULL")
def long_words(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(extractors.long_words(F.col("text")), "|").alias("words"))


@query()
def hybrid_merge(spark, d):
    rows = docs(spark, d)
    ranked = extractors.rank_sentences(rows, "doc_id", "text").select("doc_id", F.transform("found", lambda x: x["text"]).alias("a"))
    both = ranked.join(rows.select("doc_id", extractors.long_words(F.coalesce("text", F.lit(""))).alias("b")), "doc_id")
    found = extractors.hybrid_merge(both, "doc_id", "a", "b")
    return found.select("doc_id", F.posexplode("found").alias("p", "x"), "confidence").select("doc_id", (F.col("p") + 1).alias("rank"), F.col("x.text").alias("text"), F.col("x.source").alias("source"), r6(F.col("x.score")).alias("score"), r6(F.col("confidence")).alias("confidence"))


@query(f"WITH RECURSIVE {textrank_sql()} SELECT doc_id, len(l)::INT AS n, coalesce(array_to_string(l, '|'), '') AS phrases FROM listed")
def staged_phrases(spark, d):
    return _joined(extractors.staged(docs(spark, d), "doc_id", "text"), "phrases")


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, {SENTENCE_C} AS s, list_transform(({TOKENS_SQL})[1:3], lambda x, i: struct_pack(t := x, score := 1 - 0.2::DOUBLE * i)) AS a FROM documents), f AS (SELECT doc_id, s, 0 AS k, a AS kept FROM l UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN len(kept) >= 10 OR len(list_filter(kept, lambda y: contains(y.t, s[k + 1]) OR contains(s[k + 1], y.t))) > 0 THEN kept
  ELSE list_append(kept, struct_pack(t := s[k + 1], score := greatest(0.1::DOUBLE, 1 - 0.1::DOUBLE * k))) END FROM f WHERE k < len(s)),
  u AS (SELECT doc_id, list_filter(kept, lambda y: y.score >= 0.3)[1:10] AS kept FROM f WHERE k = len(s)) SELECT doc_id, len(kept)::INT AS n, coalesce(array_to_string(list_transform(kept, lambda y: y.t), '|'), '') AS merged FROM u""")
def merge_contained(spark, d):
    rows = read(spark, d, "documents").where("text is not null")
    first = F.transform(F.slice(text.tokens(F.col("text"), None), 1, 3), lambda x, i: F.struct(x.alias("text"), (1.0 - 0.2 * (i + 1)).alias("score")))
    kept = F.transform(extractors.merge_contained(first, text.sentences(F.col("text"), "c")), lambda x: x["text"])
    return rows.select("doc_id", F.size(kept).alias("n"), F.array_join(kept, "|").alias("merged"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents), g AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram FROM t, range(1, 5) x(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p))
  SELECT doc_id, n::INT AS n, count(*) AS runs, count(DISTINCT gram) AS grams FROM g GROUP BY 1, 2""")
def word_runs(spark, d):
    rows = text.word_runs(docs(spark, d), "doc_id", text.tokens(F.col("text"), None), 4)
    return rows.groupBy("doc_id", "n").agg(F.sum("times").alias("runs"), F.count("*").alias("grams"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: length(x) > 0)) >= 3 AS valid FROM documents WHERE text IS NOT NULL")
def valid_documents(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", S.is_document(F.col("text")).alias("valid"))


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS w, generate_subscripts({TOKENS_SQL}, 1) - 1 AS p FROM documents) SELECT doc_id, lower(w) AS word, arg_min(w, p) AS form, count(*) AS times, string_agg(p::VARCHAR, ',' ORDER BY p) AS places FROM t GROUP BY 1, 2""")
def word_positions(spark, d):
    rows = text.word_positions(docs(spark, d), "doc_id", text.tokens(F.col("text"), None))
    return rows.select("doc_id", "word", "form", "times", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


@query(f"""SELECT doc_id, w AS word, CASE WHEN w IN ('the', 'and') THEN 'en' WHEN w IN ('der', 'und', 'the') THEN 'de' END AS category FROM (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS w FROM documents) WHERE w IN ('the', 'and', 'der', 'und', 'que')""")
def first_categories(spark, d):
    lists = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, w)).alias("phrases")) for n, w in (("en", ["the", "and"]), ("de", ["der", "und", "the"]))])
    rows = read(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"), None)).alias("word")).where(F.col("word").isin("the", "and", "der", "und", "que")).distinct()
    return rows.select("doc_id", "word", text.first_category(F.col("word"), lists).alias("category"))


@query()
def stop_word_keywords(spark, d):
    found = text.stop_word_phrases(F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").where("lang = 'en'").select("doc_id", F.size(found).alias("n"), F.array_join(found, "|").alias("keywords"))


JARO_SQL = """n AS (SELECT p_partkey, p_name AS a, coalesce(lead(p_name) OVER (ORDER BY p_partkey), p_name) AS b FROM part), d AS (SELECT DISTINCT a, b FROM n),
  m AS (SELECT a, b, 0 AS i, []::INT[] AS taken, ''::VARCHAR AS mine FROM d UNION ALL
    SELECT a, b, i + 1, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END, CASE WHEN j IS NULL THEN mine ELSE mine || a[i + 1] END FROM (
      SELECT *, list_min(list_filter(range(greatest(1, i + 1 - r), least(length(b), i + 1 + r) + 1)::INT[], lambda k: b[k] = a[i + 1] AND NOT list_contains(taken, k))) AS j FROM (SELECT *, greatest(length(a), length(b)) // 2 - 1 AS r FROM m WHERE i < length(a)))),
  f AS (SELECT a, b, mine, list_reduce(list_prepend('', list_transform(list_sort(taken), lambda k: b[k])), lambda x, y: x || y) AS theirs FROM m WHERE i = length(a)),
  o AS (SELECT a, b, length(mine) AS k, len(list_filter(range(1, length(mine) + 1), lambda x: mine[x] <> theirs[x])) / 2 AS t FROM f),
  j AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN k = 0 THEN 0.0::DOUBLE ELSE (k / length(a) + k / length(b) + (k - t) / k) / 3 END AS jaro FROM o),
  w AS (SELECT a, b, jaro + 0.1::DOUBLE * len(list_filter([1, 2, 3, 4], lambda x: x <= least(length(a), length(b)) AND a[1:x] = b[1:x])) * (1 - jaro) AS sim FROM j)"""


def name_sql() -> str:
    pairs = "n AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)"
    ranked = JARO_SQL[JARO_SQL.index("d AS"):]
    return f"""WITH RECURSIVE {pairs}, {ranked} SELECT a.p_partkey AS a, b.p_partkey AS b, round(sim, 6) AS sim FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey JOIN w ON w.a = a.p_name AND w.b = b.p_name WHERE sim > 0.75"""


@query(name_sql())
def name_similarity(spark, d):
    """Half transpositions count as they are (DuckDB's own function rounds them down, so the SQL form matches letters itself)."""
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return fuzzy.similar_within(p, "p_partkey", "p_name", ["p_brand", "p_type"], S.jaro_winkler, 0.75).withColumn("sim", r6(F.col("sim")))


@query(f"""WITH RECURSIVE {JARO_SQL} SELECT p_partkey, round(0.7::DOUBLE * sim + 0.3::DOUBLE * len(list_intersect(list_distinct(string_split(n.a, ' ')), list_distinct(string_split(n.b, ' ')))) / len(list_distinct(list_concat(string_split(n.a, ' '), string_split(n.b, ' ')))), 6) AS sim FROM n JOIN w ON w.a = n.a AND w.b = n.b""")
def phrase_similarity(spark, d):
    """Each part's name with the next one's, words in another place and all."""
    p = read(spark, d, "part")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey", "left")
    return both.select("p_partkey", r6(S.phrase_similarity(F.col("p_name"), F.coalesce("next", "p_name"))).alias("sim"))
