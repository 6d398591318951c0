"""Text mining: sentences, tokens, co-occurrence, TF-IDF, PageRank, keyword ranking, greedy deduplication."""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import packed, unpacked
from ..functions.semantics import edit_similarity, trimmed
from . import graphs


#: ASCII punctuation and full-width marks; ASCII white space. As lists of characters, which a table looks up.
MARKS, SPACES = string.punctuation + "。、！？「」『』（）", " \t\n\x0b\f\r"


def spaced(text: Column) -> Column:
    """Marks to spaces."""
    return F.translate(text, MARKS, " " * len(MARKS))


def sentences(text: Column, kind: str = "a") -> Column:
    """Sentence arrays. a: cut after closing marks, 10 characters without punctuation at least; b: cut at full-width marks
    and !?, 10 at least, else the first 5; c: cut at full-width marks and line ends, more than 10."""
    if kind == "a":
        parts = F.split(F.regexp_replace(text, "([。！？.!?])", "$1\n"), "\n")
        parts = F.transform(parts, trimmed)
        return F.filter(parts, lambda x: F.length(F.translate(x, MARKS + SPACES, "")) >= 10)
    if kind == "b":
        parts = F.filter(F.transform(F.split(text, "[。！？．!?]+"), trimmed), lambda x: F.length(x) > 0)
        long = F.filter(parts, lambda x: F.length(x) >= 10)
        return F.when(F.size(long) > 0, long).otherwise(F.slice(parts, 1, 5))
    return F.filter(F.transform(F.split(text, "[。！？\n]"), trimmed), lambda x: F.length(x) > 10)


def tokens(text: Column, most: int | None = 10) -> Column:
    """The default tokenizer: punctuation to spaces, words of more than one character; the first so many, or all."""
    words = F.filter(F.split(spaced(text), r"\s+"), lambda x: F.length(x) > 1)
    return words if most is None else F.slice(words, 1, most)


#: Parts that texts are dealt into by key before their words become rows, which are many times the text.
KEY_PARTS = 400


def _dealt(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """key, w: the texts' words; a key's rows lie in one part, so that groupings by key and more shuffle no words."""
    return docs.repartition(KEY_PARTS, key).select(key, words.alias("w"))


def forward_pairs(docs: DataFrame, key: str, words: Column, window: int = 2) -> DataFrame:
    """key, a, b, n: undirected counts of different words (an array in the text's order) at most window apart."""
    rows = _dealt(docs, key, words)
    ahead = [F.arrays_zip(F.col("w").alias("x"), F.slice("w", d + 1, F.greatest(F.size("w") - d, F.lit(0))).alias("y")) for d in range(1, window + 1)]
    pairs = rows.select(key, F.explode(F.flatten(F.array(*ahead))).alias("p")).where("p.y is not null and p.x <> p.y")
    return pairs.select(key, F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).groupBy(key, "a", "b").agg(F.count("*").alias("n"))


def page_rank(weights: np.ndarray, rounds: int = 50, tolerance: float = 1e-4) -> np.ndarray:
    """PageRank of a dense weight matrix (row: from)."""
    source, target = np.nonzero(weights)
    return graphs.page_rank(len(weights), source, target, np.asarray(weights, float)[source, target], rounds, tolerance)


def rank_words(docs: DataFrame, key: str, text: str, n: int = 20) -> DataFrame:
    """TextRank on forward co-occurrence: key, rank, word, score of the n best; fewer than three words: the words as they come."""
    rows = docs.select(key, F.transform(tokens(F.col(text), None), F.lower).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b["t"], strict=True):
                if t is None:
                    continue
                if len(t) < 3:
                    out += [(k, i + 1, w, 1.0) for i, w in enumerate(t)]
                    continue
                index: dict[str, int] = {}
                at = np.array([index.setdefault(w, len(index)) for w in t])
                v = len(index)
                a = np.concatenate([at[:-1], at[:-2]])
                c = np.concatenate([at[1:], at[2:]])
                ok = a != c
                pair, weight = np.unique(np.concatenate([a[ok] * v + c[ok], c[ok] * v + a[ok]]), return_counts=True)
                src, dst = pair // v, pair % v
                s = graphs.page_rank(v, src, dst, weight.astype(float), 30)
                words = list(index)
                best = np.lexsort((np.arange(v), -np.round(s, 9)))[:n]
                out += [(k, r + 1, words[i], float(s[i])) for r, i in enumerate(best)]
            yield pd.DataFrame(out, columns=[key, "rank", "word", "score"])

    return rows.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, rank int, word string, score double")


def chunk_tfidf(docs: DataFrame, key: str, text: str, size: int = 15, n: int = 20) -> DataFrame:
    """TF-IDF of words over chunks of so many words of a text (three at least): tf is the count, idf 1 + ln(N / (1 + df)).
    Of each chunk the ten best; a word's score is its best; key, rank, word, score of the n best. A text of fewer than ten
    words gives its first ten, one of fewer than two chunks its first n, as they stand and without scores. No shuffle."""

    def best_of(words: list[str]) -> list[tuple[str, float | None]]:
        chunks = [x for x in (words[i : i + size] for i in range(0, len(words), size)) if len(x) >= 3]
        if len(words) < 10 or len(chunks) < 2:
            return [(w, None) for w in words[: 10 if len(words) < 10 else n]]
        counts = [Counter(x) for x in chunks]
        df = Counter(w for c in counts for w in c)
        best: dict[str, float] = {}
        for c in counts:
            scored = sorted((-round(tf * (1 + math.log(len(chunks) / (1 + df[w]))), 9), w) for w, tf in c.items())
            for s, w in scored[:10]:
                best[w] = max(best.get(w, -math.inf), -s)
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, r + 1, w, s) for k, t in zip(b[key], b["t"], strict=True) for r, (w, s) in enumerate([] if t is None else best_of(t.tolist()))]
            yield pd.DataFrame(out, columns=[key, "rank", "word", "score"]).astype({"score": "float64"})

    rows = docs.select(key, F.transform(tokens(F.col(text), None), F.lower).alias("t"))
    out = rows.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, rank int, word string, score double")
    return out.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def keep_first(items: Column, alike, n: int | None = None) -> Column:
    """Greedy deduplication of an array: an item stays unless it is alike to one that stayed before it."""
    zero = F.slice(items, 1, 0)
    kept = F.aggregate(items, zero, lambda acc, x: F.when(F.exists(acc, lambda y: alike(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return kept if n is None else F.slice(kept, 1, n)


def alike_by_edits(least: float):
    return lambda x, y: edit_similarity(x, y) >= least


def matched_keywords(text: Column, words: Sequence[str]) -> Column:
    """Those of the words that the text contains, in their order."""
    lowered = F.lower(text)
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(lowered, F.lower(w)))


def decay(rank: Column, step: float = 0.1, least: float = 0.1) -> Column:
    """Score of a place (from 1) in a list."""
    return F.greatest(F.lit(least), 1 - step * (rank - 1))


#: Pairs that a Python worker hands on at a time.
PAIRS = 200_000


def sentence_pairs(docs: DataFrame, key: str, text: str, kind: str = "a") -> DataFrame:
    """key, i, j, sim: Jaccard of the token sets of all ordered pairs of a text's sentences that share a token (i, j: places
    among its sentences)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, n = [], 0
            for p, t in enumerate(b["t"]):
                if t is not None and len(t) > 1:
                    held.append((p, *graphs.overlaps([set(x) for x in t])))
                    n += len(held[-1][1])
                if held and (n >= PAIRS or p == len(b) - 1):
                    at = np.repeat([x[0] for x in held], [len(x[1]) for x in held])
                    yield pd.DataFrame({key: b[key].to_numpy()[at]} | {name: np.concatenate([x[c] for x in held]) for c, name in enumerate(("i", "j", "sim"), 1)})
                    held, n = [], 0

    rows = docs.select(key, F.transform(sentences(F.col(text), kind), lambda x: tokens(x)).alias("t"))
    return rows.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, i int, j int, sim double")


def word_runs(docs: DataFrame, key: str, words: Column, longest: int = 4) -> DataFrame:
    """key, n, run, first, times: runs of 1 to longest words, where each stands first (from 0), and how often."""
    rows = _dealt(docs, key, words).where("size(w) > 0")

    def of(n):
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        runs = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("run"), (i - 1).alias("p")))
        return F.when(F.size("w") >= n, runs).otherwise(F.slice(runs, 1, 0) if n == 1 else F.array().cast("array<struct<n:int,run:string,p:int>>"))

    runs = rows.select(key, F.explode(F.concat(*[of(n) for n in range(1, longest + 1)])).alias("x"))
    return runs.groupBy(key, F.col("x.n").alias("n"), F.col("x.run").alias("run")).agg(F.min("x.p").alias("first"), F.count("*").alias("times"))


def foreign_words(words: Column) -> Column:
    """Words that aren't ASCII letters and digits only. It drops every word of a Latin script, so it is never a default."""
    return F.filter(words, lambda x: ~x.rlike("^[a-zA-Z0-9]+$"))


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with place (from 1) in their group's order, linear (1 - earlier share) and place_weight (1.2 in the first and last
    three tenths)."""
    w, names = Window.partitionBy(key), ("place", "linear", "place_weight")
    found = rows.select(packed(rows), F.row_number().over(w.orderBy(*order)).alias("place"), F.count("*").over(w).alias("n"))
    share = (F.col("place") - 1) / F.col("n")
    weight = F.when((share <= 0.3) | (share >= 0.7), 1.2).otherwise(1.0)
    return found.select(*unpacked(c for c in rows.columns if c not in names), "place", (1 - share).alias("linear"), weight.alias("place_weight"))


# English words that carry no topic.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off "
    "on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your"
).split()


def stop_word_phrases(text: Column, stop: Sequence[str] = STOP_WORDS, longest: int = 3) -> Column:
    """Keywords between stop words and punctuation: lower-cased runs of 1 to longest words, longer runs cut, once each in
    order. Our own contract, where a package decides elsewhere."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}'\s]+", " | ")
    words = F.filter(F.split(spaced, r"\s+"), lambda x: F.length(x) > 0)
    kept = F.transform(words, lambda x: F.when(x.isin("|", *stop), F.lit("|")).otherwise(x))
    runs = F.filter(F.transform(F.split(F.array_join(kept, " "), r"\|"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)

    def cut(run):
        w = F.split(run, " ")
        return F.transform(F.sequence(F.lit(1), F.size(w), F.lit(longest)), lambda i: F.array_join(F.slice(w, i, longest), " "))

    return F.array_distinct(F.flatten(F.transform(runs, cut)))


def word_positions(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """key, word (lower case), form (as it stands first), times, places (from 0, ascending)."""
    rows = _dealt(docs, key, words).select(key, F.posexplode("w").alias("p", "form")).withColumn("word", F.lower("form"))
    return rows.groupBy(key, "word").agg(F.min_by("form", "p").alias("form"), F.count("*").alias("times"), F.array_sort(F.collect_list("p")).alias("places"))


def first_category(phrase: Column, categories: Column) -> Column:
    """The first of categories (array of name and phrases) that lists the phrase; null where none does."""
    return F.try_element_at(F.transform(F.filter(categories, lambda c: F.array_contains(c["phrases"], phrase)), lambda c: c["name"]), F.lit(1))


# Tokens of a morphological analyser, where one is given as a provider: array<struct<surface, base, pos, detail>>.

# Parts of speech and details as the analyser names them.
NOUN, VERB, ADJECTIVE, SYMBOL = "名詞", "動詞", "形容詞", "記号"
LESSER_NOUNS, DEPENDENT = ["接続詞的", "数", "非自立", "代名詞"], "非自立"


def useful_tokens(tagged: Column, verbs: bool = True, symbols: bool = False) -> Column:
    """Base forms of nouns that stand alone, adjectives and, if asked for, verbs and symbols; two characters at least."""

    def good(t):
        ok = (t["pos"] == NOUN) & ~F.coalesce(t["detail"], F.lit("")).isin(*LESSER_NOUNS)
        free = F.coalesce(t["detail"], F.lit("")) != DEPENDENT
        ok = ok | (t["pos"] == ADJECTIVE) & free
        ok = ok | (t["pos"] == VERB) & free if verbs else ok
        return ok | (t["pos"] == SYMBOL) if symbols else ok

    words = F.transform(F.filter(tagged, good), lambda t: F.coalesce(F.nullif(t["base"], F.lit("")), t["surface"]))
    return F.filter(words, lambda x: F.length(x) > 1)


def noun_phrases(tagged: Column) -> Column:
    """Phrases of adjectives and nouns in a row: at each noun all of the row so far, two characters at least, once each."""
    zero = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        noun = t["pos"].startswith(NOUN) & ~t["pos"].contains("代名詞") & ~t["pos"].contains(DEPENDENT)
        part = noun | t["pos"].startswith(ADJECTIVE)
        now = F.when(part, F.concat(acc["now"], t["surface"])).otherwise(F.lit(""))
        add = noun & (F.length(now) >= 2) & ~F.array_contains(acc["out"], now)
        return F.struct(now.alias("now"), F.when(add, F.concat(acc["out"], F.array(now))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tagged, zero, step, lambda acc: acc["out"])
