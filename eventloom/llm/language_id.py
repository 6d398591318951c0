"""Language identification by Bayesian evidence fusion.

The text model is naive Bayes over 4-grams of character classes of the lower-cased text, fitted on a bounded sample of documents with a known
language (FIT_DOCS per language at most). Every language that has labelled text is fitted; tables go to the texts in blocks
of LANG_BLOCK languages, a pass over the texts for each block. A text's log-likelihood is tempered to that of TEXT_GRAMS grams, as grams that
follow one another are not independent. To it are added the logarithms of
- the declared language's likelihood given each language: a table counted over all rows, by text posteriors,
- the address suffix's likelihood, counted likewise,
- the host's prior: its own counts, smoothed towards its parent domain's, and those towards all rows' (each level holds
  SMOOTHING rows' weight of the level above).
From the suffix's and the host's counts a row's own share is taken out first.
Counts are grouped aggregates of posteriors, combined map-side, so a host with a third of all rows is a row a task; they
come back to the rows by equi-joins.

Nulls and empty texts: the text adds nothing. No address: no host and no suffix. No declaration: counted as one. An
unknown declaration is a value of its own. Ties go to the first language in alphabetical order. Without labelled
documents the language is null. Repeated rows and ids: a row each. Empty tables give no rows.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FIT_DOCS, LANG_BLOCK = 500, 16
ORDER, CLASSES = 4, 40
TEXT_GRAMS, ALPHA, SMOOTHING, FLOOR = 60.0, 0.05, 5.0, 0.5

RAW = re.compile(r"<(script|style)\b", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in ("script", "style")}
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})"


def _class_table() -> np.ndarray:
    t = np.zeros(0x3000, np.int32)
    for cp in range(len(t)):
        ch = chr(cp)
        if ch.isspace():
            t[cp] = 0
        elif "a" <= ch <= "z":
            t[cp] = cp - 96
        elif ch.isdigit():
            t[cp] = 35
        elif ch.isupper():
            t[cp] = 33 if cp < 128 else 34
        elif cp >= 128 and ch.isalpha():
            t[cp] = 27 + cp % 6
        elif ch in ".,":
            t[cp] = 36
        elif ch in "'\"-()’“”«»":
            t[cp] = 37
        elif ch in "!?¡¿":
            t[cp] = 38
        else:
            t[cp] = 39
    return t


_TABLE = _class_table()


def grams(column: pa.Array):
    """(first row, gram codes, how many of each row) by blocks; a text is preceded by ORDER - 1 blanks."""
    lengths = pc.fill_null(pc.utf8_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, data, offsets in C.text_blocks(column):
        n = lengths[i : i + len(offsets) - 1]
        cps = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        cls = np.where(cps < len(_TABLE), _TABLE[np.minimum(cps, len(_TABLE) - 1)], 27 + (cps % 6).astype(np.int32))
        at = np.arange(len(cps)) + np.repeat((np.arange(len(n)) + 1) * (ORDER - 1), n)
        padded = np.zeros(len(cps) + len(n) * (ORDER - 1), np.int32)
        padded[at] = cls
        codes = np.zeros(len(cps), np.int32)
        for back in range(ORDER - 1, -1, -1):
            codes = codes * CLASSES + padded[at - back]
        yield i, codes, n


def without_markup(page: str) -> str:
    """Comments, scripts, styles and tags as a space each. What never ends is looked for once, so time is in proportion to the
    page."""
    out, at, open_ended = [], 0, set()
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        end = -1
        if page.startswith("<!--", start) and "comment" not in open_ended:
            end = page.find("-->", start + 4) + 3
            if end < 3:
                end = -1
                open_ended.add("comment")
        elif (m := RAW.match(page, start)) and (tag := m[1].lower()) not in open_ended:
            closing = RAW_END[tag].search(page, m.end())
            end = closing.end() if closing else -1
            if closing is None:
                open_ended.add(tag)
        if end < 0:
            end = page.find(">", start + 1) + 1
            if not end:
                break
        out += [page[at:start], " "]
        at = end
    out.append(page[at:])
    return "".join(out)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and lang <> '' and length(text) > 0")


def fit(docs: DataFrame, counts: list) -> np.ndarray:
    """For each (language, number of labelled documents), the log-likelihood of every gram; from at most FIT_DOCS documents
    of each language."""
    langs = [r[0] for r in counts]
    known = labelled(docs).where(F.col("lang").isin(langs))
    share = {r[0]: min(1.0, 2 * FIT_DOCS / r[1]) for r in counts}
    least = F.lit(0.0)
    for lang, x in share.items():
        least = F.when(F.col("lang") == lang, x).otherwise(least)
    # ids in the order of a hash: the first FIT_DOCS of a language, from a share that holds about twice as many
    some = known.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)).where(F.col("u") <= least)
    texts = some.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("u", "doc_id"))), 1, FIT_DOCS).alias("x")).select("lang", F.explode("x.doc_id").alias("doc_id"))
    sample = some.select("doc_id", "lang", "text").join(F.broadcast(texts), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(0).to_pylist()
            for i, codes, n in grams(pc.utf8_lower(b.column(1))):
                owner = np.repeat(np.arange(len(n)), n)
                for name in set(names[i : i + len(n)]):
                    mine = np.array([x == name for x in names[i : i + len(n)]])
                    at, count = np.unique(codes[mine[owner]], return_counts=True)
                    s = sums.setdefault(name, np.zeros(CLASSES**ORDER, np.int64))
                    s[at] += count
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at])], ["lang", "gram", "n"])

    rows = sample.mapInArrow(C.tidy(run), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.full((len(langs), CLASSES**ORDER), ALPHA)
    lang, gram, n = rows["lang"].to_numpy(zero_copy_only=False), rows["gram"].to_numpy(), rows["n"].to_numpy()
    for k, name in enumerate(langs):
        out[k, gram[lang == name]] += n[lang == name]
    return np.log(out / out.sum(1, keepdims=True)).astype(np.float32)


def text_evidence(rows: DataFrame, table: np.ndarray, markup: bool, name: str, last: bool) -> DataFrame:
    """rows with the array name: tempered log-likelihoods by the table's languages; after the last pass without text."""
    n_langs = len(table)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = [c for c in rows.columns if c != "text" or not last]

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            if markup:
                column = pa.array([html.unescape(without_markup(x)) if x else x for x in column.to_pylist()], pa.string())
            out = np.zeros((b.num_rows, n_langs))
            for i, codes, n in grams(pc.utf8_lower(column)):
                some = np.flatnonzero(n)
                if len(some):
                    starts = (np.cumsum(n) - n)[some]
                    for k in range(n_langs):
                        s = np.add.reduceat(shared.value[k][codes].astype(np.float64), starts)
                        out[i + some, k] = s * np.minimum(1.0, TEXT_GRAMS / n[some])
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n_langs, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), values], [*names, name])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(C.tidy(run), f"{schema}, {name} array<double>")


def posterior(scores: Column) -> Column:
    """Normalised exponentials of an array."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def identify(rows: DataFrame, langs: list[str]) -> DataFrame:
    """rows(..., declared, suffix, domain, host, evidence) with language, posterior and text_language."""
    n = len(langs)
    rows = C.stored(rows.withColumn("p", posterior(F.col("evidence"))))

    def sums(*keys: str) -> DataFrame:
        cells = [F.sum(F.col("p")[k]) for k in range(n)]
        return rows.groupBy(*keys).agg(F.array(*cells).alias("sums"))

    total = sums().first()["sums"]
    whole = sum(x or 0.0 for x in total) or 1.0
    base = [((x or 0.0) + FLOOR) / (whole + FLOOR * n) for x in total]

    def likelihood(counts: Column) -> Column:
        """Of a value with such counts: log P(value | language) - log P(value), smoothed."""
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.array(*[F.log((counts[k] + FLOOR * F.lit(base[k])) / ((size + FLOOR) * F.lit(base[k]))) for k in range(n)])

    value = F.coalesce("declared", F.lit("\0"))  # no declaration is a value
    declared = sums("declared").select(value.alias("declared_key"), likelihood(F.col("sums")).alias("declared_likelihood"))
    out = rows.join(declared, value == F.col("declared_key"), "left").drop("declared_key")
    nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id", "doc_id"), F.lit(1 << 16)))  # rows without a key match nothing, and don't meet
    for key in ("suffix", "domain", "host"):
        own = sums(key).where(F.col(key).isNotNull()).select(F.col(key).alias(f"{key}_key"), F.col("sums").alias(f"{key}_sums"))
        out = out.join(own, F.coalesce(key, nowhere) == F.col(f"{key}_key"), "left").drop(f"{key}_key")

    def others(key: str) -> Column:
        return F.zip_with(f"{key}_sums", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))

    out = out.withColumn("suffix_others", others("suffix"))
    out = out.withColumn("suffix_likelihood", F.when(F.col("suffix").isNull(), F.array(*[F.lit(0.0)] * n)).otherwise(likelihood(F.col("suffix_others"))))
    prior = F.array(*[F.lit(x) for x in base])
    for key in ("domain", "host"):
        # without the row itself, weighted with the level above
        counts, above = others(key), prior
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn(f"{key}_prior", F.when(F.col(key).isNull(), above).otherwise(_smoothed(counts, above, size)))
        prior = F.col(f"{key}_prior")
    cells = [F.col("evidence")[k] + F.log(F.col("host_prior")[k]) + F.col("declared_likelihood")[k] + F.col("suffix_likelihood")[k] for k in range(n)]
    out = out.withColumn("fused", posterior(F.array(*cells)))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("fused")
    return out.withColumns({"language": F.element_at(names, F.array_position("fused", best).cast("int")), "posterior": best, "text_language": F.when(F.array_max("evidence") > F.array_min("evidence"), F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))})


def _smoothed(counts: Column, above: Column, size: Column) -> Column:
    return F.zip_with(counts, above, lambda c, a: (c + SMOOTHING * a) / (size + SMOOTHING))


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain: last two labels, suffix: last label) of an address; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(F.length(host) > 0, host)
    return host, F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0), F.regexp_extract(host, r"[^.]+$", 0)


def languages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each page and document: page_id or doc_id, language, posterior, text_language, declared, host.

    A document's declared language is its lang, its host its source."""
    texts = documents.select("doc_id", "lang", "text")
    counts = sorted(labelled(texts).groupBy("lang").count().collect())
    langs = [r[0] for r in counts]
    host, domain, suffix = address(F.col("url").cast("string"))
    declared = F.lower(F.regexp_extract("html", DECLARED, 1))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("long").alias("doc_id"), F.when(F.length(declared) > 0, declared).alias("declared"), suffix.alias("suffix"), domain.alias("domain"), host.alias("host"), F.col("html").alias("text"))
    none = F.lit(None).cast("string")
    d = documents.select(F.lit(None).cast("long").alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("lang").alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").cast("string").alias("host"), "text")
    if not langs:
        both = p.unionByName(d)
        return both.select("page_id", "doc_id", none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), "declared", "host")
    parts, blocks = [p, d], [counts[i : i + LANG_BLOCK] for i in range(0, len(counts), LANG_BLOCK)]
    for i, block in enumerate(blocks):
        table, before = fit(texts, block), parts
        parts = [text_evidence(x, table, markup, f"evidence{i}", i == len(blocks) - 1) for x, markup in zip(before, (True, False), strict=True)]
        if len(blocks) > 1:  # a block's tables are done with before the next block's
            parts = [C.stored(x) for x in parts]
            if i:
                C.discard(*before)
    names = [f"evidence{i}" for i in range(len(blocks))]
    raw = F.concat(*names)
    rows = parts[0].unionByName(parts[1]).withColumn("evidence", F.transform(raw, lambda x: x - F.array_max(raw))).drop(*names)
    return identify(rows, langs).select("page_id", "doc_id", "language", "posterior", "text_language", "declared", "host")
