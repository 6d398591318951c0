"""Recommendation pipelines over DataFrames of users and events, on deterministic providers by default."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import providers
from ..operators import catalog, text, vectors
from ..operators.keywords import best_texts
from ..sources.lineage import cut


def by_tags(tags: DataFrame, events: DataFrame, embed: providers.Embedding | None = None, modes: Sequence[str] = ("concat",), methods: Sequence[str] = ("weighted",), threshold: float = 0.35, n: int = 5, select: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """tag, id, label, score, mean_sim for tags(tag) and events(id, keyPhrases, keySentences): every mode and method, all tags
    in one job. select: a model's final choice; without it the first ten of each tag stay."""
    embed = embed or providers.hashed_embedding()
    out = None
    for mode in modes:
        lists = [vectors.interest_of_tags(tags, events, "id", words, embed, mode) for words in ("keyPhrases", "keySentences")]
        found = vectors.recommend(*lists, "tag", "id", threshold, n, methods, mode)
        out = found if out is None else out.unionByName(found)
    if select:
        return select(out)
    order = F.row_number().over(Window.partitionBy("tag").orderBy("label", F.desc("score"), "id"))
    return out.withColumn("__n", order).where("__n <= 10").drop("__n")


def message_tag(message: Column, tags: Column) -> Column:
    """The one tag that a message and tags are searched as."""
    return F.array_join(F.filter(F.concat(F.array(message), F.coalesce(tags, F.array().cast("array<string>"))), lambda x: F.length(x) > 0), "・")


def user_ids(found: DataFrame, tags: DataFrame) -> DataFrame:
    """user, id: the union of what a user's tags found (tags(user, tag))."""
    return tags.join(found.select("tag", "id"), "tag").select("user", "id").distinct()


def first_of_each(events: DataFrame, k: int) -> DataFrame:
    """Of the events of each page, those with the k smallest ids, written: equal pages are equally near to any query, so no
    other can be among its k nearest. Only these need a vector."""
    place = F.row_number().over(Window.partitionBy("page").orderBy("id"))
    return cut(events.withColumn("__n", place).where(F.col("__n") <= k).drop("__n"))


def by_queries(queries: DataFrame, events: DataFrame, embed: providers.Embedding | None = None, k: int = 50, least: float = 0.8, n: int = 10) -> DataFrame:
    """user, id, ord for queries(user, query_no, query, place) and events(id, page, location): each query's k nearest of at least
    so much near the user's place, united in order, the first n."""
    embed = embed or providers.hashed_embedding()
    q = queries.select("query", embed(F.col("query")).alias("q")).dropDuplicates(["query"]).withColumnRenamed("query", "query_id")
    best = vectors.nearest(q, first_of_each(events.select("id", "page", "location"), k).select("id", "location", embed(F.col("page")).alias("v")), k)
    found = queries.join(vectors.retrieved(best, least).withColumnRenamed("query_id", "query"), "query")
    near = F.col("place").isNull() | (F.col("place") == "") | F.contains(F.coalesce("location", F.lit("")), F.col("place"))
    for w in catalog.ONLINE_PLACE:
        near = near | F.contains(F.lower(F.coalesce("location", F.lit(""))), F.lit(w))
    return catalog.distinct_ordered(found.where(near), "user", "id", "query_no", "rank").where(F.col("ord") <= n)


def hyde(users: DataFrame, database: DataFrame, api: DataFrame | None = None, generate: Callable[[Column, Column], Column] | None = None, **options) -> DataFrame:
    """by_queries() for users(user, tags, goals, place) over the catalogue and, undeduplicated, the API's events."""
    events = database if api is None else database.unionByName(api)
    generated = (generate or providers.profile_queries)(F.col("tags"), F.col("goals"))
    queries = users.select("user", "place", F.posexplode(generated).alias("query_no", "query"))
    return by_queries(queries, events, **options)


def by_keywords(users: DataFrame, events: DataFrame, keywords: Callable[[DataFrame], Column], fields: Sequence[str], most: int = 10, n: int = 5, least: int = 70, round_first: bool = False) -> DataFrame:
    """user, id, score, relevance, matched: events ranked for each user by how many of the user's keywords their fields
    contain; the most best go on (ten or fewer events in all: all of them, with score 1), the first n are judged, those of at
    least so much relevance stay. Without a model's judgement, relevance is ten times the score.

    All users' different lists of keywords are looked for in one pass over the events; each task gives the best of its own
    events for each list, ranked once more for all users that have it."""
    asked = users.select("user", keywords(users).alias("keywords")).where("keywords is not null")
    lists = asked.select("keywords").distinct()
    if len(events.limit(most + 1).take(most + 1)) <= most:
        rows = lists.join(F.broadcast(events.select("id"))).select("keywords", "id", F.lit(1).alias("score"), F.slice("keywords", 1, 0).alias("matched"))
        best = vectors.top(rows, "keywords", "score", "id", most)
    else:
        lists = cut(lists.withColumn("list", F.monotonically_increasing_id()))
        whole = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))
        rows = best_texts(events.select("id", whole.alias("whole")), "id", "whole", lists.select("list", F.transform("keywords", F.lower).alias("words")), most)
        best = vectors.top(rows, "list", "score", "id", most).join(lists, "list")
        best = best.select("keywords", "id", "score", F.transform("at", lambda i: F.get("keywords", i)).alias("matched"), "rank")
        if least <= 0:  # events without a match fill up what others leave, in order of id
            have = lists.join(best.groupBy("keywords").agg(F.count("*").alias("have")), "keywords", "left").where(f"coalesce(have, 0) < {most}").select("keywords")
            rest = have.join(F.broadcast(events.select("id").orderBy("id").limit(2 * most))).join(best.select("keywords", "id"), ["keywords", "id"], "left_anti")
            rest = rest.select("keywords", "id", F.lit(0).alias("score"), F.slice("keywords", 1, 0).alias("matched"))
            best = vectors.top(best.drop("rank").unionByName(rest), "keywords", "score", "id", most)
    judged = best.where(F.col("rank") <= n).withColumn("relevance", providers.relevance(F.col("score"), round_first).cast("int"))
    kept = judged.where(F.col("relevance") >= least).select("keywords", "id", "score", "relevance", F.array_join("matched", ",").alias("matched"))
    return asked.join(kept, "keywords").select("user", "id", "score", "relevance", "matched")


def by_profile(users: DataFrame, events: DataFrame, fields: Sequence[str], **options) -> DataFrame:
    """by_keywords() with the keywords of a profile: users(user, tags, goals)."""
    return by_keywords(users, events, lambda u: providers.profile_keywords(F.col("tags"), F.col("goals")), fields, **options)


def by_question(questions: DataFrame, events: DataFrame, fields: Sequence[str], **options) -> DataFrame:
    """by_keywords() with the keywords of a question: questions(user, question)."""
    return by_keywords(questions, events, lambda u: providers.question_keywords(F.col("question")), fields, round_first=True, **options)


def context(questions: DataFrame, events: DataFrame, embed: providers.Embedding | None = None, k: int = 3) -> DataFrame:
    """query_id, context: the pages of the k nearest events of questions(query_id, question), best first, as an answer's context. No
    answer is generated offline."""
    embed = embed or providers.hashed_embedding()
    # a null question is asked as an empty one, as its vector is the same
    questions = questions.select("query_id", F.coalesce("question", F.lit("")).alias("question"))
    asked = questions.select("question").distinct().select(F.col("question").alias("query_id"), embed(F.col("question")).alias("q"))
    best = vectors.nearest(asked, first_of_each(events.select("id", "page"), k).select("id", "page", embed(F.col("page")).alias("v")), k)
    found = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]), "\n\n").alias("context"))
    return questions.join(found.withColumnRenamed("query_id", "question"), "question").select("query_id", "context")


def vector_store(events: DataFrame, embed: providers.Embedding | None = None) -> DataFrame:
    """id, page, metadata, vec of events(id, title, url, description, venue, address, day)."""
    embed = embed or providers.hashed_embedding()
    page = catalog.page_content(F.col("title"), F.col("url"), F.col("description"))
    meta = F.struct("id", "title", catalog.full_place(F.col("venue"), F.col("address")).alias("location"), F.date_format("day", "yyyy-MM-dd").alias("eventDate"), F.coalesce("url", F.lit("")).alias("detailUrl"))
    return events.select("id", page.alias("page"), meta.alias("metadata")).withColumn("vec", embed(F.col("page")))


def keyword_score(fields: Sequence[Column], words: Sequence[str]) -> tuple[Column, Column]:
    """Score and matched words of an event's fields taken together."""
    whole = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in fields])
    matched = text.matched_keywords(whole, words)
    return F.size(matched), matched
