"""Catalogue reads: filters, semi-joins, nested relations, marks, ordered limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import named, packed, unpacked
from ..functions.semantics import any_has

UNKNOWN_PLACE, ALL_TYPES = "不明", "すべて"


def by_type(events: DataFrame, column: str, wanted: str | None, labels: dict[str, str] | None = None) -> DataFrame:
    """Equality after mapping a label; None or the all-types label keeps every row."""
    if wanted is None or wanted == ALL_TYPES:
        return events
    return events.where(F.col(column) == (labels or {}).get(wanted, wanted))


def search(events: DataFrame, keyword: str | None, location: str | None, text: Sequence[str], places: Sequence[str], compat: bool = True) -> DataFrame:
    """Substring search. compat: keyword and location are alternatives, as executed; else both are asked for."""
    tests: list[Column] = []
    if keyword:
        tests.append(any_has([F.col(c) for c in text], keyword))
    if location:
        tests.append(any_has([F.col(c) for c in places], location))
    if not tests:
        return events
    joined = tests[0]
    for t in tests[1:]:
        joined = joined | t if compat else joined & t
    return events.where(joined)


def at_place(events: DataFrame, column: str, location: str | None, term: str | None, text: Sequence[str], compat: bool = True) -> DataFrame:
    """Rows of a place, or of unknown place. compat: a search term replaces the place test, as executed."""
    place = None if location is None else any_has([F.col(column)], location) | F.coalesce(F.col(column) == UNKNOWN_PLACE, F.lit(False))
    found = None if term is None else any_has([F.col(c) for c in text], term)
    if found is not None and (compat or place is None):
        return events.where(found)
    if place is None:
        return events
    return events.where(place if found is None else place & found)


def between(events: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive, either bound optional."""
    if low is not None:
        events = events.where(F.col(column) >= F.lit(low))
    return events if high is None else events.where(F.col(column) <= F.lit(high))


def on_day(events: DataFrame, column: str, as_of: str, days: int = 7) -> DataFrame:
    """The half-open day that is so many days after as_of."""
    day = F.date_add(F.to_date(F.lit(as_of)), days)
    return events.where((F.col(column) >= day.cast("timestamp_ntz")) & (F.col(column) < F.date_add(day, 1).cast("timestamp_ntz")))


def overlapping(events: DataFrame, column: str, wanted: str | Sequence[str]) -> DataFrame:
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    return events.where(F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, wanted))), F.lit(False)))


def having_some(events: DataFrame, key: str, children: DataFrame, foreign: str, condition: Column) -> DataFrame:
    """Semi-join: events with a child for which the condition holds."""
    return events.join(children.where(condition).select(F.col(foreign).alias(key)), key, "left_semi")


def nested(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str, *columns: str) -> DataFrame:
    """Left outer, children as a sorted array of structs, empty where there are none."""
    grouped = children.groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    out = parents.join(grouped, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def marked(events: DataFrame, key: str, marks: DataFrame, foreign: str, name: str = "is_bookmarked") -> DataFrame:
    keys = marks.select(named(foreign).alias("key"), F.lit(True).alias("hit")).distinct()
    rows = events.select(packed(events), named(key).alias("key")).join(keys, "key", "left")
    return rows.select(*unpacked(c for c in events.columns if c != name), F.col("hit").isNotNull().alias(name))


def first_rows(events: DataFrame, n: int, *order: Column) -> DataFrame:
    return events.orderBy(*order).limit(n)


def distinct_ordered(lists: DataFrame, user: str, key: str, query: str, rank: str) -> DataFrame:
    """user, key, ord: the ordered union of a user's ranked lists, each key at its first place, numbered anew."""
    first = lists.groupBy(user, key).agg(F.min(F.struct(query, rank)).alias("at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(user).orderBy("at", key))).select(user, key, "ord")


def all_nested(parents: DataFrame, key: str, children: DataFrame, foreign: str, lists: dict[str, Column]) -> DataFrame:
    """nested() of several lists that come with the same child rows: one grouping. A null item is left out."""
    grouped = children.groupBy(F.col(foreign).alias(key)).agg(*[F.array_sort(F.collect_list(c)).alias(name) for name, c in lists.items()])
    out = parents.join(grouped, key, "left")
    return out.withColumns({name: F.coalesce(name, F.array().cast(out.schema[name].dataType)) for name in lists})


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """nested() for each name: (rows, their foreign key, their columns)."""
    for name, (rows, foreign, columns) in children.items():
        parents = nested(parents, key, rows, foreign, name, *columns)
    return parents


def by_key(rows: DataFrame, **keys) -> DataFrame:
    """The row of a primary or unique key: all conditions hold; one row at most."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.limit(1)


def first_match(rows: DataFrame, condition: Column, *order: Column) -> DataFrame:
    """The first row for which a condition holds, in a stated order."""
    return rows.where(condition).orderBy(*order).limit(1)


def place_filter(events: DataFrame, place: str | None, form: str, location: str, online: str = "ONLINE") -> DataFrame:
    """None: all; "online" in any case: events of that form; else events whose location contains the place."""
    if not place:
        return events
    return events.where(F.col(form) == online) if place.lower() == "online" else events.where(any_has([F.col(location)], place))


# Words by which a place or an address counts as online.
ONLINE_PLACE, ONLINE_ADDRESS = ["オンライン", "online", "teams", "zoom"], ["オンライン", "online"]


def reachable(place: Column, address: Column, prefecture: str | None) -> Column:
    """Whether an event is online, by its place or address, or its place or address contains a prefecture."""
    both = F.concat_ws(" ", F.coalesce(place, F.lit("")), F.coalesce(address, F.lit("")))
    found = F.lit(False)
    for w in ONLINE_ADDRESS:
        found = found | any_has([both], w)
    for w in ONLINE_PLACE:
        found = found | any_has([place], w)
    return found | both.contains(prefecture) if prefecture else found


def nearby(location: Column, place: str | None) -> Column:
    """Whether a found event suits a user's place: none given, contained in the location, or held online."""
    if not place:
        return F.lit(True)
    found = F.coalesce(location.contains(place), F.lit(False))
    for w in ("オンライン", "online", "zoom", "teams"):
        found = found | any_has([location], w)
    return found


def key_record(row: dict[str, Column]) -> list[Column]:
    """id, title, detail (from the description), and the three key lists, empty where missing."""
    lists = [F.coalesce(row[c], F.array().cast("array<string>")).alias(c) for c in ("keywords", "keyPhrases", "keySentences")]
    return [row["id"].alias("id"), row["title"].alias("title"), row["description"].alias("detail"), *lists]


def page_content(title: Column, url: Column, summary: Column) -> Column:
    """The text that an event is indexed as."""
    empty = F.lit("")
    return F.concat(F.lit("タイトル: "), title, F.lit("\n詳細URL: "), F.coalesce(url, empty), F.lit("\n概要: "), F.coalesce(summary, empty))


def full_place(venue: Column, address: Column) -> Column:
    """Venue, and the address in brackets where there is one."""
    there = F.length(F.coalesce(address, F.lit(""))) > 0
    return F.concat(F.coalesce(venue, F.lit("")), F.when(there, F.concat(F.lit(" ("), address, F.lit(")"))).otherwise(F.lit("")))


def candidate_line(number: Column, title: Column, text: Column, day: Column, venue: Column, address: Column, most: int = 200) -> Column:
    """One event as a prompt shows it: so many characters of its text, its day, and its venue, address or online."""
    place = F.coalesce(F.nullif(venue, F.lit("")), F.nullif(address, F.lit("")), F.lit("オンライン"))
    short = F.concat(F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit("..."))
    return F.concat(number.cast("string"), F.lit(". "), title, F.lit(" | "), short, F.lit(" | "), F.date_format(day, "yyyy-MM-dd"), F.lit(" | "), place)


def spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left with right's columns over them: right wins where it has the key, even with null."""
    both = left.select(packed(left, "l"), named(key).alias("key")).join(right.select(packed(right, "r"), named(key).alias("key")), "key", "left")
    there = F.col("r").isNotNull()
    cells = [F.when(there, F.col("r").getField(c)).otherwise(F.col("l").getField(c)) if c in right.columns and c != key else F.col("l").getField(c) for c in left.columns]
    more = [F.col("r").getField(c).alias(c) for c in right.columns if c not in left.columns]
    return both.select(*[x.alias(c) for x, c in zip(cells, left.columns, strict=True)], *more)


def enriched(found: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Found ids with their full rows; ids without a row go."""
    return found.join(rows, key)


def with_reasons(candidates: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Candidates that a selection names, with its reason; other ids in it go."""
    return candidates.join(answers.select(key, "reason"), key)


def page(rows: DataFrame, start: int, count: int, *order: Column) -> DataFrame:
    """count rows from place start (from 0) of an ordered table."""
    return rows.orderBy(*order).offset(start).limit(count)


def ranked_or_few(rows: DataFrame, score: Column, matched: Column, key: str, most: int = 10) -> DataFrame:
    """The most best rows by score; where there are no more than that, all of them with score 1 and nothing matched."""
    if len(rows.limit(most + 1).take(most + 1)) <= most:
        return rows.select("*", F.lit(1).alias("score"), F.array().cast("array<string>").alias("matched"))
    return rows.select("*", score.alias("score"), matched.alias("matched")).orderBy(F.desc("score"), key).limit(most)


def having_value(rows: DataFrame, column: str, among: dict[str, Sequence] | None = None) -> DataFrame:
    """Rows whose column isn't null and whose other columns, where asked for, are in a list."""
    rows = rows.where(F.col(column).isNotNull())
    for name, values in (among or {}).items():
        rows = rows.where(F.col(name).isin(list(values)))
    return rows


def dimension(rows: DataFrame, name: str) -> DataFrame:
    """A dimension list: names in order, numbered. It is a list that a person picks from, so one task orders it."""
    return rows.select(name).distinct().orderBy(name).withColumn("ord", F.row_number().over(Window.orderBy(name)))


def listed(rows: DataFrame, key: str, column: str, name: str, separator: str = ", ") -> DataFrame:
    """key, name: a group's different non-blank values in order, as one text."""
    items = F.filter(F.array_sort(F.collect_set(column)), lambda x: F.length(F.trim(x)) > 0)
    return rows.groupBy(key).agg(F.array_join(items, separator).alias(name))


def alive(*tables: DataFrame) -> DataFrame:
    """ok: 1 where every table can be read and has rows, else 0."""
    out = None
    for t in tables:
        row = t.limit(1).agg((F.count("*") > 0).alias("there"))
        out = row if out is None else out.unionByName(row)
    return out.agg(F.coalesce(F.bool_and("there"), F.lit(False)).cast("int").alias("ok"))


def histogram(rows: DataFrame, label: Column, labels: Sequence[str] = ()) -> DataFrame:
    """category, n; of labels that are listed, those without rows too."""
    counts = rows.groupBy(label.alias("category")).agg(F.count("*").alias("n"))
    if not labels:
        return counts
    all_ = rows.sparkSession.createDataFrame([(x, 0) for x in labels], "category string, n long")
    return counts.unionByName(all_).groupBy("category").agg(F.sum("n").alias("n"))


def success(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """key, total, found, success_rate (percent, two digits)."""
    found = F.count_if(ok)
    return rows.groupBy(key).agg(F.count("*").alias("total"), found.alias("found"), F.round(100.0 * found / F.count("*"), 2).alias("success_rate"))
