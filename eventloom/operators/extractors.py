"""Extractors of sentences, phrases and keywords from texts, one row a text.

What needs a graph of the whole text runs in Arrow batches (operators.graphs); splitting, classes, weights, windows and
deduplication are column expressions. Where a language model would refine, its stated fallback is the default; a provider
can be given instead (see providers). Null and blank texts give empty results. Ties keep the order of the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import edit_similarity, half_up, once
from . import classify as K
from . import graphs as G
from .text import sentences, spaced, tokens

#: Texts that a Python worker takes at a time, with their sentences and tokens as Python objects.
TEXTS = 500
RANKED = "array<struct<ord:int,text:string,score:double>>"


def small_batches(rows: DataFrame) -> DataFrame:
    """rows, of which a Python worker takes TEXTS at a time, unless the session already says how many."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, TEXTS)
    return rows


def per_text(rows: DataFrame, key: str, f: Callable, kind: str) -> DataFrame:
    """(key, found: kind) with f of the other columns' values; a null list is an empty one."""
    names = [c for c in rows.columns if c != key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = zip(*[[[] if x is None else x for x in b[c]] for c in names], strict=True)
            yield pd.DataFrame({key: b[key], "found": [f(*v) for v in values]})

    return small_batches(rows).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, found {kind}")


def rows_of(found: DataFrame, key: str, name: str = "text") -> DataFrame:
    """key, rank, name, score of (key, found)."""
    return found.select(key, F.posexplode("found").alias("p", "x")).select(key, (F.col("p") + 1).alias("rank"), F.col("x.text").alias(name), F.col("x.score").alias("score"))


def _listed(pairs: Sequence[tuple[str, float]]) -> list:
    return [{"ord": i, "text": t, "score": float(s)} for i, (t, s) in enumerate(pairs)]


def split_tokens(docs: DataFrame, key: str, text: str, kind: str, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """key, s (sentences), t (their tokens)."""
    rows = docs.select(key, F.coalesce(sentences(F.col(text), kind), F.array().cast("array<string>")).alias("s"))
    # a tokenizer in Python takes a whole array, as it can't stand within transform
    whole = getattr(tokenizer, "of_array", None)
    return rows.withColumn("t", whole(F.col("s")) if whole else F.transform("s", lambda x: tokenizer(x)))


# sentences by TextRank and what is made of them


def ranked_sentences(s: Sequence[str], t: Sequence[Sequence[str]], shares: Sequence[float], most: int = 10) -> list[list[dict]]:
    """TextRank of one text's sentences s with their tokens t: for each share, that share of them, the best, in order."""
    kept = [i for i in range(len(s)) if len(t[i])]
    if len(kept) < 2:
        first = kept if len(s) > 1 else range(len(s))
        return [[{"ord": i, "text": s[i], "score": 1.0} for i in list(first)[:5]] for _ in shares]
    i, j, w = G.overlaps([set(t[k]) for k in kept])
    scores = G.page_rank(len(kept), i, j, w)
    order = G.descending(scores)
    best = [sorted(order[: min(most, int(np.ceil(share * len(kept))))]) for share in shares]
    return [[{"ord": kept[b], "text": s[kept[b]], "score": float(scores[b])} for b in some] for some in best]


def rank_sentences(docs: DataFrame, key: str, text: str, share: float = 0.4, most: int = 10, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """TextRank: key, s (all sentences), found: the best ceil(share n) of those with tokens, at most so many, in the text's
    order (ord: place in the text); fewer than two such: the first five of them with score 1, and few is true."""

    rows = split_tokens(docs, key, text, "a", tokenizer)
    few = F.size(F.filter("t", lambda x: F.size(x) > 0)) < 2
    both = rows.select(key, "s", "t", few.alias("few"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "s": b["s"], "few": b["few"], "found": [ranked_sentences(s, t, (share,), most)[0] for s, t in zip(b["s"], b["t"], strict=True)]})

    return small_batches(both).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, s array<string>, few boolean, found {RANKED}")


def drop_alike(items: Column, least: float) -> Column:
    """Greedy deduplication of an array of structs (text, weighted, ...): a later one alike to one that stayed takes its place
    if it weighs more, else it goes."""

    def placed(acc, x, at):
        other = F.try_element_at(acc, at)["weighted"]
        heavier = (x["weighted"] > 0) & (other > 0) & (x["weighted"] > other)
        swapped = F.transform(acc, lambda y, i: F.when(i + 1 == at, x).otherwise(y))
        return F.when(at == 0, F.concat(acc, F.array(x))).when(heavier, swapped).otherwise(acc)

    def step(acc, x):
        alike = F.transform(acc, lambda y: edit_similarity(F.lower(x["text"]), F.lower(y["text"])) >= least)
        return once(F.array_position(alike, F.lit(True)).cast("int"), lambda at: placed(acc, x, at))

    return F.aggregate(items, F.slice(items, 1, 0), lambda acc, x: step(acc, x))


def by_weight(items: Column, most: int | None = None) -> Column:
    """Heaviest first, ties as they stand."""
    placed = F.transform(items, lambda x, i: F.struct((-x["weighted"]).alias("w"), i.alias("i"), x.alias("x")))
    out = F.transform(F.array_sort(placed), lambda y: y["x"])
    return out if most is None else F.slice(out, 1, most)


def weighted(texts: Column, label: Callable[[Column], Column], weights: dict[str, float], missing: float, step: float, low: int, high: int, strict_zero: bool = False) -> Column:
    """Structs (text, category, score, weighted) of those of ranked texts that have low to high characters: the score falls by
    step a place among all, to 0.1 at least."""
    placed = F.transform(texts, lambda x, i: F.struct(x.alias("text"), i.alias("i")))

    def one(x):
        score = F.greatest(F.lit(0.1), 1.0 - step * x["i"])
        return once(label(x["text"]), lambda c: F.struct(x["text"].alias("text"), c.alias("category"), score.alias("score"), (score * K.weight(c, weights, missing, strict_zero)).alias("weighted")))

    return F.transform(F.filter(placed, lambda x: F.length(x["text"]).between(low, high)), one)


def refine_phrases(texts: Column, noise: float = 0.25, strict_zero: bool = False) -> Column:
    """What replaces a language model's refinement of phrases: category weights, 6 to 30 characters, light ones of no
    category dropped, alike ones (0.75) merged, heaviest first. noise: 0.3 for a model's own phrases, 0.2 as a last resort."""
    items = weighted(texts, K.phrase_category, K.PHRASE_WEIGHTS, 0.5, 0.1, 6, 30, strict_zero)
    items = F.filter(items, lambda x: ~((x["category"] == "other") & (x["weighted"] < noise)))
    return by_weight(drop_alike(items, 0.75))


# Words that make a sentence worthless whatever its class.
STRONG_NOISE = ["gmail", "zoom", "申し込み後", "ご案内", "インストール", "ダウンロード", "早稲田大学", "慶應大学", "東京大学", "大学", "i-mode", "株式会社"]


def worthwhile(items: Column) -> Column:
    """Sentences without strong noise, and calls to action only if they weigh 0.7."""
    return F.filter(items, lambda x: ~K.matches_any(F.lower(x["text"]), STRONG_NOISE) & ~((x["category"] == "actionable") & (x["weighted"] < 0.7)))


def refine_sentences(texts: Column) -> Column:
    """What replaces a model's sentences: type weights, 20 to 120 characters, alike ones (0.8) merged, noise out."""
    items = weighted(texts, K.sentence_type, K.SENTENCE_WEIGHTS, 1.0, 0.15, 20, 120)
    return by_weight(worthwhile(drop_alike(items, 0.8)))


def refine_keywords(texts: Column, most: int = 10, strict_zero: bool = False) -> Column:
    """What replaces a model's keywords: category weights, 2 to 15 characters, the heaviest; not deduplicated."""
    return by_weight(weighted(texts, K.keyword_category, K.KEYWORD_WEIGHTS, 1.0, 0.1, 2, 15, strict_zero), most)


def pad(first: Column, second: Column, least: int = 3) -> Column:
    """first, filled up from second to so many, nothing twice."""
    return F.aggregate(second, first, lambda acc, x: F.when((F.size(acc) < least) & ~F.array_contains(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def without_markup(texts: Column) -> Column:
    """Tags and lower-case entities to spaces, white space collapsed, blank ones dropped."""
    clean = F.transform(texts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "&[a-z]+;", " "), r"\s+", " ")))
    return F.filter(clean, lambda x: F.length(x) > 0)


def _texts(c: Column) -> Column:
    return F.transform(c, lambda x: x["text"])


def _phrases(own: Column, few: Column, s: Column, refine: bool) -> Column:
    better = _texts(refine_phrases(own)) if refine else own
    second = F.when(few, s).otherwise(own if refine else s)
    return without_markup(pad(F.when(few, own).otherwise(better), second))


def _sentences(own: Column, few: Column, refine: bool) -> Column:
    better = _texts(refine_sentences(own)) if refine else own
    return without_markup(F.when(few, own).otherwise(better))


def _words(own: Column, refine: bool, most: int = 10) -> Column:
    return _texts(refine_keywords(own, most)) if refine else F.slice(own, 1, most)


def key_phrases(docs: DataFrame, key: str, text: str, refine: bool = True) -> DataFrame:
    """key, phrases: TextRank's sentences refined (or as they are), at least three where the text has them, without markup."""
    return rank_sentences(docs, key, text).select(key, _phrases(_texts(F.col("found")), F.col("few"), F.col("s"), refine).alias("phrases"))


def key_sentences(docs: DataFrame, key: str, text: str, refine: bool = True) -> DataFrame:
    """key, sentences: the better half of TextRank's sentences, refined or as they are, without markup."""
    return rank_sentences(docs, key, text, 0.5).select(key, _sentences(_texts(F.col("found")), F.col("few"), refine).alias("sentences"))


def all_words(text: Column) -> Column:
    """Everything between punctuation and white space."""
    return F.filter(F.split(spaced(text), r"\s+"), lambda x: F.length(x) > 0)


def ranked_words(t: Sequence[str], window: int = 5, most: int = 50) -> list[dict]:
    """TextRank of one text's tokens, see word_ranks()."""
    index: dict[str, int] = {}
    forms: list[str] = []
    at = np.full(len(t), -1)
    for p, w in enumerate(t):
        if len(w) >= 2:
            low = w.lower()
            if low not in index:
                index[low] = len(index)
                forms.append(w)
            at[p] = index[low]
    v = len(index)
    if v < 2:
        return []
    codes = [np.zeros(0, np.int64)]
    for d in range(1, min(window, len(at) - 1) + 1):
        a, b = at[:-d], at[d:]
        ok = (a >= 0) & (b >= 0) & (a != b)
        codes += [a[ok] * v + b[ok], b[ok] * v + a[ok]]
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    scores = G.page_rank(v, code // v, code % v, n.astype(float)) * np.log(np.bincount(at[at >= 0], minlength=v) + 1)
    return [{"ord": int(i), "text": forms[i], "score": float(scores[i])} for i in G.descending(scores)[:most]]


def word_ranks(docs: DataFrame, key: str, text: str, window: int = 5, most: int = 50, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """TextRank of a text's words (lower-cased, two characters at least): key, found of the best by score times ln(frequency
    + 1). Words at most window places apart, counted over all tokens, are neighbours; each pair of places counts. The text
    is a word's first form; fewer than two words give nothing."""
    whole = tokenizer or all_words
    rows = docs.select(key, F.coalesce(whole(F.col(text)), F.array().cast("array<string>")).alias("t"))
    return per_text(rows, key, lambda t: ranked_words(t, window, most), RANKED)


def key_words(docs: DataFrame, key: str, text: str, refine: bool = True, most: int = 10) -> DataFrame:
    """key, keywords: the ranked words refined, or the first so many."""
    return word_ranks(docs, key, text).select(key, _words(_texts(F.col("found")), refine, most).alias("keywords"))


def event_key_data(docs: DataFrame, key: str, text: str, refine: bool = True) -> DataFrame:
    """key, keywords, phrases, sentences of each text: the three live extractors in one pass over the texts, without a
    shuffle. A text on which an extractor breaks has empty lists, and the others theirs."""
    none = F.array().cast("array<string>")
    rows = docs.select(key, F.coalesce(sentences(F.col(text), "a"), none).alias("s"), F.coalesce(all_words(F.col(text)), none).alias("words"))
    rows = rows.withColumn("t", F.transform("s", lambda x: tokens(x)))
    few = F.size(F.filter("t", lambda x: F.size(x) > 0)) < 2
    both = rows.select(key, "s", "t", "words", few.alias("few"))
    names = ["phrases", "sentences", "keywords"]

    def one(s, t, words) -> tuple:
        try:
            ranked = ranked_sentences(s, t, (0.4, 0.5))
            return *([x["text"] for x in found] for found in (*ranked, ranked_words(words))), False
        except Exception:  # that text's lists are empty; a job of many goes on
            return [], [], [], True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(*([] if x is None else x for x in row)) for row in zip(b["s"], b["t"], b["words"], strict=True)]
            yield pd.DataFrame({key: b[key], "s": b["s"], "few": b["few"]} | {n: [f[k] for f in found] for k, n in enumerate([*names, "broken"])})

    kind = docs.schema[key].dataType.simpleString()
    ranked = small_batches(both).mapInPandas(run, f"{key} {kind}, s array<string>, few boolean, phrases array<string>, sentences array<string>, keywords array<string>, broken boolean")
    cells = {"keywords": _words(F.col("keywords"), refine), "phrases": _phrases(F.col("phrases"), F.col("few"), F.col("s"), refine), "sentences": _sentences(F.col("sentences"), F.col("few"), refine)}
    return ranked.select(key, *[F.when(F.col("broken"), none).otherwise(c).alias(n) for n, c in cells.items()])


# sentences by term weights


def weigh_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, found: every sentence (cut as kind b) with the mean of its words' tf ln(N / df) over occurrences, positives only."""

    def weigh(s, t):
        df: dict[str, int] = {}
        for words in t:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        out = []
        for i, (x, words) in enumerate(zip(s, t, strict=True)):
            part = [list(words).count(w) / len(words) * np.log(len(s) / df[w]) for w in words]
            part = [p for p in part if p > 0]
            out.append({"ord": i, "text": x, "score": float(sum(part) / len(part)) if part else 0.0})
        return out

    return per_text(split_tokens(docs, key, text, "b"), key, weigh, RANKED)


def tfidf_sentences(docs: DataFrame, key: str, text: str, most: int = 20, factor: float = 1.2) -> DataFrame:
    """key, found: sentences of at least factor times the mean positive weight (if those are fewer than min(most, 0.3 n), the
    heaviest), at most so many, those of more than 0.8 common characters dropped, in the text's order."""

    def choose(found):
        rows = [(x["ord"], x["text"], x["score"]) for x in found]
        some = [x for x in rows if x[2] > 0]
        if some:
            least = sum(x[2] for x in some) / len(some) * factor
            rows = [x for x in some if x[2] >= least]
            if len(rows) < min(most, 0.3 * len(some)):
                rows = sorted(some, key=lambda x: -round(x[2], 9))
        kept = G.keep_unlike(rows[:most], lambda a, b: G.char_jaccard(a[1], b[1]) > 0.8)
        return [{"ord": x[0], "text": x[1], "score": x[2]} for x in sorted(kept)]

    return per_text(weigh_sentences(docs, key, text), key, choose, RANKED)


def central_sentences(docs: DataFrame, key: str, text: str, most: int = 20, least: float = 0.8, by_place: bool = False) -> DataFrame:
    """key, found: sentences by their mean cosine with the others (term frequencies over the joint vocabulary), those of
    cosine least with a better one dropped, the best in the text's order. by_place: the first and last three tenths count
    1.2 times."""

    def rank(s, t):
        kept = [i for i in range(len(s)) if len(t[i])]
        if not kept:
            return []
        n = len(kept)
        row, word, w = G.term_weights([t[i] for i in kept])
        total = np.bincount(word, w)
        score = np.bincount(row, w * (total[word] - w), n) / max(n - 1, 1)
        if by_place:
            place = np.array(kept) / n
            score = score * np.where((place <= 0.3) | (place >= 0.7), 1.2, 1.0)
        order = G.descending(score).tolist()
        if least > 1 + 1e-9:  # no cosine is
            stay = order[:most]
        else:
            by = np.argsort(word, kind="stable")
            ends, own = np.cumsum(np.bincount(word)), np.searchsorted(row, np.arange(n + 1))
            near, stay = np.full(n, -np.inf), []  # cosine with the nearest that stays
            for i in order:
                if near[i] < least - 1e-12:
                    stay.append(i)
                    if len(stay) == most:
                        break
                    mine = slice(own[i], own[i + 1])
                    there = [by[ends[x - 1] if x else 0 : ends[x]] for x in word[mine]]  # where i's words stand
                    all_ = np.concatenate(there)
                    near = np.maximum(near, np.bincount(row[all_], w[all_] * np.repeat(w[mine], [len(x) for x in there]), n))
        return [{"ord": kept[i], "text": s[kept[i]], "score": float(score[i])} for i in sorted(stay)]

    return per_text(split_tokens(docs, key, text, "a"), key, rank, RANKED)


# topics


def topic_words(docs: DataFrame, key: str, text: str, n: int = 20) -> DataFrame:
    """key, found: TopicRank over the tokens. Where words are written with spaces, candidates are joined by one."""
    rows = docs.select(key, F.coalesce(tokens(F.col(text), None), F.array().cast("array<string>")).alias("t"))
    return per_text(rows, key, lambda t: _listed(G.topic_rank(list(t), n=n, joiner=" ")), RANKED)


def multipartite_sentences(docs: DataFrame, key: str, text: str, n: int = 20) -> DataFrame:
    """key, found: MultipartiteRank over sentences cut as kind c, their tokens as keywords."""

    def rank(s, t):
        kept = [i for i in range(len(s)) if len(t[i])]
        return _listed(G.multipartite_rank([s[i] for i in kept], [list(dict.fromkeys(t[i])) for i in kept], kept, n))

    return per_text(split_tokens(docs, key, text, "c"), key, rank, RANKED)


# summaries, frequencies, merges


def summarised(text: Column, most: int = 350) -> Column:
    """What replaces a model's summary: the first so many characters of a longer text."""
    return F.when(F.length(text) > most, F.substring(text, 1, most)).otherwise(text)


def missing_terms(wanted: Column, have: Column) -> Column:
    """Those of wanted that no text of have contains, ignoring case."""
    return F.filter(wanted, lambda w: ~F.exists(have, lambda x: F.contains(F.lower(x), F.lower(w))))


def summary_phrases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, phrases: TextRank of the summary; technical terms of the text that no phrase has are added while there are fewer
    than six."""
    rows = docs.select(key, summarised(F.col(text)).alias("summary"), K.tech_terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    ranked = rank_sentences(rows, key, "summary").join(rows.select(key, "terms"), key)
    add = F.aggregate("terms", _texts(F.col("found")), lambda acc, w: F.when((F.size(acc) < 6) & ~F.exists(acc, lambda x: F.contains(F.lower(x), w)), F.concat(acc, F.array(F.concat(w, F.lit("を活用"))))).otherwise(acc))
    return ranked.select(key, add.alias("phrases"))


def summary_quality(text: Column, summary: Column) -> dict[str, Column]:
    """Compression ratio, reduction, share of words and of technical terms that are preserved; two digits."""
    run = F.lit(r"[ァ-ヴー]+|[ぁ-ゔー]+|[一-龠]+|[a-zA-Z]+")
    a, b = (F.array_distinct(F.regexp_extract_all(x, run, F.lit(0))) for x in (text, summary))
    terms, kept = K.tech_terms(text), K.tech_terms(summary)
    return {
        "compression_ratio": half_up(F.try_divide(F.length(summary), F.length(text)), 2),
        "length_reduction": F.length(text) - F.length(summary),
        "word_preservation": half_up(F.try_divide(F.size(F.array_intersect(b, a)), F.size(a)), 2),
        "term_preservation": F.when(F.size(terms) > 0, half_up(F.size(kept) / F.greatest(F.size(terms), F.lit(1)), 2)).otherwise(1.0),
    }


def frequent_words(docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """key, words: the n most frequent tokens, first seen first among equals; what replaces a model's phrases."""

    def top(t):
        counts: dict[str, int] = {}
        for w in t:
            counts[w] = counts.get(w, 0) + 1
        return sorted(counts, key=lambda w: -counts[w])[:n]

    rows = docs.select(key, F.coalesce(tokens(F.col(text), None), F.array().cast("array<string>")).alias("t"))
    return per_text(rows, key, top, "array<string>").withColumnRenamed("found", "words")


def graph_phrases(rows: DataFrame, key: str, phrases: str, n: int = 15) -> DataFrame:
    """key, found: phrases by PageRank (30 rounds) of the Jaccard graph of their words, scores brought to 0..1 (0.5 where all
    agree); fewer than two: 1."""

    def rank(p, t):
        p = list(p)
        if len(p) < 2:
            return _listed([(x, 1.0) for x in p])
        i, j, w = G.overlaps([set(x) for x in t])
        s = G.page_rank(len(p), i, j, w, 30)
        span = s.max() - s.min()
        s = (s - s.min()) / span if span > 0 else np.full(len(p), 0.5)
        return _listed([(p[k], s[k]) for k in G.descending(s)[:n]])

    return per_text(rows.select(key, F.col(phrases).alias("p"), F.transform(phrases, lambda x: F.split(x, r"\s+")).alias("t")), key, rank, RANKED)


def long_words(text: Column, most: int = 8) -> Column:
    """What replaces a model's list beside TextRank: the first words of 3 to 20 characters, or three stock phrases."""
    words = F.filter(F.split(F.regexp_replace(text, r"[、。！？\.\!\?,\s]", " "), " "), lambda x: F.length(x).between(3, 20))
    # fixed values: what stands in for an empty list
    return F.when(F.size(words) > 0, F.slice(words, 1, most)).otherwise(F.array(*map(F.lit, ["技術セミナー", "プログラミング", "実践的学習"])))


MERGED = "struct<found:array<struct<text:string,rank_score:double,other_score:double,score:double,source:string>>,confidence:double>"


def hybrid_merge(rows: DataFrame, key: str, first: str, second: str, share: float = 0.6, other: float = 0.4, most: int = 10) -> DataFrame:
    """key, found, confidence: two ranked lists, scored 1 - place / length each. An item of the second joins the most alike
    item (edit similarity over 0.7) that is there so far, else it comes in itself; best first. Confidence: 0.7 of the share
    that both lists have plus 0.3 of size / 8, 1 at most."""

    def merge(a, b):
        a, b = list(a), list(b)
        out = [[x, 1 - i / len(a), 0.0, (1 - i / len(a)) * share, "textrank"] for i, x in enumerate(a)]
        for i, x in enumerate(b):
            score, best, at = 1 - i / len(b), 0.7, None
            low = x.lower()
            for y in out:
                other_low = y[0].lower()
                if 1 - abs(len(low) - len(other_low)) / max(len(low), len(other_low), 1) <= best:
                    continue  # lengths alone are too far apart
                alike = G.edit_similarity(low, other_low)
                if alike > best:
                    best, at = alike, y
            if at is None:
                out.append([x, 0.0, score, score * other, "ai"])
            else:
                at[2:] = [score, at[1] * share + score * other, "both"]
        n, agreed = len(out), sum(x[4] == "both" for x in out)
        confidence = min(0.7 * agreed / n + 0.3 * min(n / 8, 1), 1.0) if n else 0.0
        out.sort(key=lambda x: -round(x[3], 9))
        return {"found": [dict(zip(["text", "rank_score", "other_score", "score", "source"], x, strict=True)) for x in out[:most]], "confidence": confidence}

    found = per_text(rows.select(key, first, second), key, merge, MERGED)
    return found.select(key, F.col("found.found").alias("found"), F.col("found.confidence").alias("confidence"))


def merge_contained(first: Column, second: Column, most: int = 10, least: float = 0.3) -> Column:
    """Structs (text, score): first, then those of second (scored by place) that neither contain nor are contained in what is
    there, up to most; then those of the least score."""
    items = F.transform(second, lambda x, i: F.struct(x.alias("text"), F.greatest(F.lit(0.1), 1.0 - 0.1 * i).alias("score")))
    both = F.aggregate(items, first, lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: F.contains(y["text"], x["text"]) | F.contains(x["text"], y["text"])), F.concat(acc, F.array(x))).otherwise(acc))
    return F.slice(F.filter(both, lambda x: x["score"] >= least), 1, most)


def staged(docs: DataFrame, key: str, text: str, clean: Callable[[Column], Column] | None = None, shorten: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, preprocessed, ranked, phrases: the stages clean, TextRank and shorten; without providers the first and the last
    hand on what they get."""
    rows = docs.select(key, (clean(F.col(text)) if clean else F.col(text)).alias("preprocessed"))
    ranked = rank_sentences(rows, key, "preprocessed").select(key, _texts(F.col("found")).alias("ranked"))
    return rows.join(ranked, key).withColumn("phrases", shorten(F.col("ranked")) if shorten else F.col("ranked"))
