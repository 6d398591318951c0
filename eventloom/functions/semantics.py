"""Column helpers for the catalogue's value semantics: falsy defaults, trimming, half-up rounding, null-safe tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: White space as the catalogue's clients see it: ASCII, the ideographic space, the no-break space, the byte-order mark.
WHITE = r"[\s\x{3000}\x{00A0}\x{FEFF}]"
WHITE_CHARS = " \t\n\x0b\f\r\u3000\u00a0\ufeff"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it, also within the lambdas of higher-order functions,
    where Spark shares no subexpressions."""
    return F.transform(F.array(value), use)[0]


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def falsy_or(*cs: Column) -> Column:
    """The first that is neither null nor the empty string, else the last."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs[:-1]], cs[-1])


def half_up(c: Column, digits: int = 0) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def has(c: Column, part: str | Column) -> Column:
    """Case-insensitive containment; a null never matches."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(F.contains(F.lower(c), F.lower(part)), F.lit(False))


def any_has(cs: Sequence[Column], part: str) -> Column:
    found = F.lit(False)
    for c in cs:
        found = found | has(c, part)
    return found


def first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule one of whose words the text contains."""
    out = None
    for label, words in rules:
        hit = any_has([text], words[0])
        for w in words[1:]:
            hit = hit | has(text, w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of different lengths are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    unequal = F.raise_error(F.lit("vectors of different dimensions")).cast("double")
    return F.when(F.size(a) != F.size(b), unequal).when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 0 where either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def is_document(text: Column, least: int = 3) -> Column:
    """Whether a text is there, not blank, and has so many words at least."""
    return F.coalesce(F.size(F.filter(F.split(trimmed(text), f"{WHITE}+"), lambda x: F.length(x) > 0)) >= least, F.lit(False))


def char_jaccard(a: Column, b: Column) -> Column:
    """Of two strings as sets of characters; 0 where both are empty."""
    x, y = (F.filter(F.array_distinct(F.split(c, "")), lambda v: F.length(v) > 0) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def query_string(text: Column) -> Column:
    """A URL's query string as a map, decoded."""
    return F.transform_values(F.str_to_map(text, F.lit("&"), F.lit("=")), lambda k, v: F.url_decode(F.coalesce(v, F.lit(""))))


def day_number(day: Column) -> Column:
    """YYYYMMDD."""
    return F.date_format(day, "yyyyMMdd")


def day_range(start: Column, end: Column, as_of: Column, days: int = 14) -> tuple[Column, Column]:
    """start and end, by default as_of and so many days later."""
    low = F.coalesce(start, as_of)
    return low, F.coalesce(end, F.date_add(as_of, days))


def mapped(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def json_in(text: Column) -> Column:
    """What stands between the first and the last brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def braces_escaped(text: Column) -> Column:
    """For templates in which a brace opens a variable."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def prefixed_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity, in Arrow batches (Spark has no function for it); null where either is null."""
    @F.pandas_udf("double")
    def sim(x: pd.Series, y: pd.Series) -> pd.Series:
        from ..operators.graphs import jaro_winkler as one

        return pd.Series([None if i is None or j is None else one(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return sim(a, b)


def phrase_similarity(a: Column, b: Column, share: float = 0.7) -> Column:
    """Jaro-Winkler of two phrases with a share, Jaccard of their words with the rest."""
    both = F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))) / F.size(F.array_union(F.split(a, " "), F.split(b, " ")))
    return share * jaro_winkler(a, b) + (1 - share) * both


def scaled(value: Column, *partition: str) -> Column:
    """A value between its group's least and greatest as 0 to 1; 0.5 where all are the same."""
    w = Window.partitionBy(*partition)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))
