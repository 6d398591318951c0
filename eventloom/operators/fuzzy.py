"""Edit-similarity join: pairs of texts of two tables whose similarity 1 - distance / longer length exceeds a threshold,
without comparing all with all and without a blocking column.

Two texts within distance t: cut the longer one into t + 1 segments, and at least one of them stands unchanged in the shorter
one, near its own place. So each text gives its segments (for its own length) and its substrings at the places where a segment
of a longer text may stand; both meet by an equi-join on (length, segment number, substring), and what meets is verified.
Different texts are joined once, however often they occur. A substring that very many texts share makes many candidates, as
rows of a join that Spark can split, never in one task's memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import edit_similarity

#: Parts that rows are dealt into before they meet those of like names.
JOIN_PARTS = 240


def _farthest(length: Column, least: float) -> Column:
    """The largest distance that a pair with this longer length may have."""
    return F.floor(length * (1 - least) + 1e-9).cast("int")


def _segments(texts: DataFrame, least: float) -> DataFrame:
    """text, long, part, piece: each text cut into one segment more than the distance allowed at its length."""
    x = texts.withColumn("long", F.length("text")).withColumn("far", _farthest(F.col("long"), least))
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), "far")))
    at, size = _segment(F.col("long"), F.col("far"), F.col("part"))
    return x.select("text", "long", "part", F.col("text").substr(at + 1, size).alias("piece"))


def _segment(long: Column, far: Column, part: Column) -> tuple[Column, Column]:
    """First place and length of a segment; the last ones have one character more."""
    size = F.floor(long / (far + 1)).cast("int")
    short = far + 1 - long % (far + 1)
    return part * size + F.greatest(F.lit(0), part - short), size + F.when(part >= short, 1).otherwise(0)


def _substrings(texts: DataFrame, least: float) -> DataFrame:
    """text, long, part, piece: what may be segments of texts at least as long."""
    own = F.col("own")
    x = texts.withColumn("own", F.length("text"))
    x = x.withColumn("long", F.explode(F.sequence(own, F.floor(own / least + 1e-9).cast("int"))))
    x = x.withColumn("far", _farthest(F.col("long"), least)).where("long - own <= far")
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), "far")))
    at, size = _segment(F.col("long"), F.col("far"), F.col("part"))
    # edits before a segment number at most part, or else those behind it at most far - part: either bounds its shift
    behind = F.col("far") - F.col("part")
    gap = own - F.col("long")
    low = F.greatest(F.lit(0), at - F.col("part"), at + gap - behind)
    high = F.least(own - size, at + F.col("part"), at + gap + behind)
    x = x.withColumn("at", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("size", size)
    return x.select("text", "long", "part", F.col("text").substr(F.col("at") + 1, F.col("size")).alias("piece")).distinct()


def similar_texts(left: DataFrame, right: DataFrame, least: float = 0.7) -> DataFrame:
    """a, b, sim: all pairs of different texts of left(text) and right(text) with similarity over least (over 0). Null and
    empty texts are like nothing; equal texts have similarity 1."""
    a, b = (x.where("text is not null and text <> ''").select("text").distinct() for x in (left, right))
    longer_b = _substrings(a, least).select(F.col("text").alias("a"), "long", "part", "piece").join(_segments(b, least).withColumnRenamed("text", "b"), ["long", "part", "piece"])
    longer_a = _substrings(b, least).select(F.col("text").alias("b"), "long", "part", "piece").join(_segments(a, least).withColumnRenamed("text", "a"), ["long", "part", "piece"])
    near = longer_b.select("a", "b").unionByName(longer_a.select("a", "b")).distinct()
    return near.withColumn("sim", edit_similarity(F.col("a"), F.col("b"))).where(F.col("sim") > least)


def similar_within(rows: DataFrame, key: str, name: str, blocks: Sequence[str], similarity: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """a, b, sim: pairs of rows(key, name, blocks) of the same block, a the smaller key, with similarity over least.

    The different names of a block are compared once each way, across all blocks once; a row then meets only the rows whose
    name is like its own."""
    names = rows.where(F.col(name).isNotNull()).select(*blocks, name).distinct()
    both = names.withColumnRenamed(name, "__a").join(names.withColumnRenamed(name, "__b"), list(blocks))
    alike = both.select("__a", "__b").distinct().withColumn("sim", similarity(F.col("__a"), F.col("__b"))).where(F.col("sim") > least)
    left = rows.select(*blocks, F.col(name).alias("__a"), F.col(key).alias("a")).join(alike, "__a")
    right = rows.select(*blocks, F.col(name).alias("__b"), F.col(key).alias("b"))
    left = left.repartition(JOIN_PARTS, *blocks, "__b")  # a small table makes many pairs, so its rows are dealt out first
    return left.join(right.hint("merge"), [*blocks, "__b"]).where("a < b").select("a", "b", "sim")


def best_matches(left: DataFrame, key: str, text: str, right: DataFrame, other: str, name: str, least: float = 0.7, same: bool = False) -> DataFrame:
    """key, other, sim: for each row of left(key, text) the most similar row of right(other, name) over least; ties go to the
    smaller other. Rows without a match are left out. same: equal texts count too."""
    pairs = similar_texts(left.select(F.col(text).alias("text")), right.select(F.col(name).alias("text")), least)
    # of a text's matches only the best can win, and of the rows that have it the first
    first = right.where(F.col(name).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(name).alias("b")).agg(F.min(other).alias("other"))
    rows = (pairs if same else pairs.where("a <> b")).join(first, "b")
    best = rows.groupBy("a").agg(F.min(F.struct((-F.col("sim")).alias("less"), "other", "sim")).alias("x"))
    return left.select(key, F.col(text).alias("a")).join(best, "a").select(key, F.col("x.other").alias(other if other != key else f"other_{other}"), F.col("x.sim").alias("sim"))
