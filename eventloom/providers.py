"""What the catalogue gets from services elsewhere, as functions from columns to columns, with offline defaults.

A provider is passed to an operator; without one the operator uses the default here, which needs no network and gives the
same result everywhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .operators.text import tokens

#: Text to a vector (array<double>); text to tokens (array<string>); ranked texts to better ones; a text to queries.
Embedding = Callable[[Column], Column]
Tokenizer = Callable[[Column], Column]
Refiner = Callable[[Column], Column]


def hashed_embedding(dims: int = 64) -> Embedding:
    """Signed hashing of lower-cased tokens into so many dimensions; a text without tokens is the zero vector."""

    def hashes(text: Column) -> Column:
        return F.transform(tokens(F.lower(F.coalesce(text, F.lit(""))), None), lambda w: F.xxhash64(w))

    def vectors(lists: pa.ListArray) -> pa.ListArray:
        h = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        cells = np.bincount(row * dims + np.mod(h, dims), np.where(h < 0, -1.0, 1.0), len(lists) * dims)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dims), pa.array(cells))

    @F.arrow_udf("array<double>")
    def one(lists: pa.Array) -> pa.Array:
        return vectors(lists)

    @F.arrow_udf("array<array<double>>")
    def each(texts: pa.Array) -> pa.Array:
        sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, vectors(texts.flatten()), mask=texts.is_null())

    zero = F.array_repeat(F.lit(0.0), dims)

    def embed(text: Column) -> Column:
        return F.coalesce(one(hashes(text)), zero)  # never null, so that no filter asks for it

    def of_array(texts: Column) -> Column:
        """Vectors of each text of an array (Spark has no Python functions within transform)."""
        return each(F.transform(texts, hashes))

    embed.of_array = of_array
    return embed


def profile_keywords(tags: Column, goals: Column) -> Column:
    """Keywords of a profile: tags cut at commas (of either script), and goals; trimmed, blank ones dropped, once each."""
    def cut(t):
        return F.when(t.contains(","), F.split(t, ",")).when(t.contains("、"), F.split(t, "、")).otherwise(F.array(t))

    none = F.array().cast("array<string>")
    parts = F.flatten(F.transform(F.coalesce(tags, none), lambda t: F.transform(cut(t), lambda x: F.trim(x))))
    return F.array_distinct(F.filter(F.concat(parts, F.coalesce(goals, none)), lambda x: F.length(x) > 0))


def question_keywords(question: Column, most: int = 5) -> Column:
    """Keywords of a question: its first words of more than one character; the whole question where there are none."""
    words = F.slice(F.filter(F.split(question, r"\s+"), lambda x: F.length(x) > 1), 1, most)
    return F.when(F.size(words) > 0, words).otherwise(F.array(question))


def profile_queries(tags: Column, goals: Column) -> Column:
    """Search queries of a profile: one for each keyword. This stands in for generated ones and is a choice of our own."""
    return profile_keywords(tags, goals)


def listed_queries(reply: Column) -> Column:
    """Queries of a generated reply: the lines that begin with "- "."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(x))
    return F.filter(F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: F.trim(F.substring(x, 3, 1 << 20))), lambda x: F.length(x) > 0)


def relevance(score: Column, round_first: bool = False) -> Column:
    """Relevance of 0 to 100 from a keyword score, where no model judges."""
    return F.least(F.lit(100), F.floor(score * 10 + 0.5) if round_first else score * 10)


# Replies of a language model, where one is given.

REPLY = {
    "phrases": "refined_keyphrases array<struct<phrase:string,score:double,reason:string>>", "sentences": "key_sentences array<struct<sentence:string,type:string,score:double,reason:string>>",
    "keywords": "keywords array<struct<keyword:string,category:string,score:double,reason:string>>", "events": "recommendedEvents array<struct<eventId:string,title:string,relevanceScore:double>>",
}


def parsed(reply: Column, kind: str) -> Column:
    """The items of a reply: of the JSON between its first and last brace; null where there is none. kind: a key of REPLY."""
    name = REPLY[kind].split()[0]
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), REPLY[kind])[name]


def confident(items: Column, text: str) -> Column:
    """Structs (text, score, confidence) of items: a missing or zero score is 0.5; confidence is the score within 0.1 and 1."""

    def one(x):
        score = F.coalesce(F.nullif(x["score"], F.lit(0.0)), F.lit(0.5))
        return F.struct(F.trim(x[text]).alias("text"), score.alias("score"), F.greatest(F.lit(0.1), F.least(score, F.lit(1.0))).alias("confidence"))

    return F.transform(F.filter(items, lambda x: F.length(F.trim(F.coalesce(x[text], F.lit("")))) > 0), one)


def chosen(reply: Column) -> Column:
    """Ids and reasons of a final choice: the JSON list in a reply; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), "array<struct<id:string,reason:string>>")


def cached(texts, cache, text: str, compute):
    """(rows with reply, the new cache): replies of texts from cache(key, reply), computed once for each text that it lacks.
    The key is a hash of the whole text."""
    keyed = texts.withColumn("key", F.sha2(F.coalesce(text, F.lit("")), 256))
    new = compute(keyed.select("key", text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")).select("key", "reply")
    every = cache.select("key", "reply").unionByName(new)
    return keyed.join(every, "key", "left").drop("key"), every


def no_answer(context: Column) -> Column:
    """Answers are a model's: without one asking for them is an error."""
    return F.raise_error(F.lit("answers need a language model provider")).cast("string")
