"""Events of a search API: over HTTP as a Python data source, or from recorded pages (JSON) with the same parameters.

    spark.dataSource.register(EventApi)
    spark.read.format("event_api").options(url=..., key=..., keyword="a,b", ymd="20250101", count=100, limit=300).load()

Pages are read one after another with pauses, until one is empty; readStream goes on where it was. Rows are told apart by id
afterwards (distinct_pages), as pages can move between requests. Lists go as comma-joined text; options that are missing
aren't sent."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators.catalog import ONLINE_ADDRESS, reachable
from ..operators.normalise import prefecture_code, prefecture_stem
from ..schemas import API_EVENT, API_PAGE

#: Options that are sent as they are; the rest steer the reading.
SENT = ("event_id", "keyword", "keyword_or", "ym", "ymd", "ymd_end", "nickname", "group_id", "tag", "prefectures", "offset", "order")
ORDERS = {1: "updated_at", 2: "started_at", 3: "id"}


def search_options(keywords: Sequence[str] = (), any_of: Sequence[str] = (), start: str | None = None, end: str | None = None, tags: Sequence[str] = (), nickname: str | None = None, group: int | None = None, count: int | None = None, offset: int | None = None, order: int | None = None) -> dict[str, str]:
    """Options of a search request; dates as YYYY-MM-DD; an order other than 1, 2 or 3 is left out."""
    values = {"keyword": ",".join(keywords), "keyword_or": ",".join(any_of), "ymd": (start or "").replace("-", ""), "ymd_end": (end or "").replace("-", ""), "tag": ",".join(tags), "nickname": nickname, "group_id": group, "count": count, "offset": offset, "order": order if order in ORDERS else None}
    return {k: str(v) for k, v in values.items() if v not in (None, "")}


class Walk(InputPartition):
    """Places to be read one after another."""

    def __init__(self, places: list[str | None]):
        self.places = places


class EventApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_api"

    def schema(self) -> str:
        return API_EVENT

    def _reader(self, schema) -> EventApiReader:
        return EventApiReader({k.lower(): v for k, v in self.options.items()}, [f.name for f in schema.fields])

    def reader(self, schema) -> DataSourceReader:
        return self._reader(schema)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return EventApiStream(self._reader(schema))


class EventApiReader(DataSourceReader):
    """Options besides those sent: url, key (both needed), count (rows of a page), limit (rows of a place), pause and
    place_pause (seconds before each page and each place but the first), tries, places (prefecture codes, read in turn).

    An API takes so many requests a second from one key, however many machines ask, so all requests are made one after
    another by one task. A place ends at an empty page or at its limit."""

    def __init__(self, options: dict[str, str], names: list[str]):
        if not options.get("url") or not options.get("key"):
            raise ValueError("event_api needs the options url and key")
        self.options, self.names = options, names
        self.count = int(options.get("count", 100))
        self.limit = int(options.get("limit", self.count))
        self.places: list[str | None] = [p for p in options.get("places", "").split(",") if p] or [None]

    def partitions(self) -> list[Walk]:
        return [Walk(self.places)]

    def read(self, partition: Walk) -> Iterator[tuple]:
        for k, place in enumerate(partition.places):
            if k:
                time.sleep(float(self.options.get("place_pause", 2)))
            start = 1
            while start <= self.limit:
                if start > 1:
                    time.sleep(float(self.options.get("pause", 0.8)))
                rows = self.page(place, start)
                if not rows:
                    break
                yield from rows
                start += self.count

    def page(self, place: str | None, start: int) -> list[tuple]:
        """The rows of one page, after a few tries."""
        o = self.options
        sent = {k: o[k] for k in SENT if o.get(k)} | ({"prefectures": place} if place else {})
        sent |= {"start": str(start), "count": str(min(self.count, self.limit - start + 1))}
        request = urllib.request.Request(f"{o['url']}?{urllib.parse.urlencode(sent)}", headers={"X-API-Key": o["key"]})
        tries = int(o.get("tries", 3))
        for t in range(tries):
            try:
                with urllib.request.urlopen(request, timeout=float(o.get("timeout", 30))) as got:
                    body = json.load(got)
                break
            except OSError:
                if t == tries - 1:
                    raise
                time.sleep(2**t)
        out = []
        for e in body.get("events") or []:
            row = {k: e.get(k) for k in self.names}
            for k in ("owner", "group"):
                if k in row:
                    row[k] = tuple(row[k].get(x) for x in (("id", "nickname", "display_name") if k == "owner" else ("id", "title", "url"))) if row[k] else None
            out.append(tuple(row[k] for k in self.names))
        return out


class EventApiStream(SimpleDataSourceStreamReader):
    """The same walk as a stream: an offset is a place's number and the page it goes on with, so a pull that was stopped goes
    on where it was. A micro-batch makes at most as many requests as the option budget says (so many pages of count rows are
    what the driver passes on), with the same pauses."""

    def __init__(self, source: EventApiReader):
        self.source = source
        self.budget = int(source.options.get("budget", 10))
        self.asked = False

    def initialOffset(self) -> dict:
        return {"place": 0, "start": 1}

    def _pages(self, at: dict):
        """(rows, offset behind them), page by page, until the places are done."""
        place, start = at["place"], at["start"]
        while place < len(self.source.places):
            if self.asked:
                time.sleep(float(self.source.options.get("pause", 0.8) if start > 1 else self.source.options.get("place_pause", 2)))
            self.asked = True
            rows = self.source.page(self.source.places[place], start)
            start += self.source.count
            if not rows or start > self.source.limit:
                place, start = place + 1, 1
            yield rows, {"place": place, "start": start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = [], start
        for n, (rows, after) in enumerate(self._pages(start), 1):
            out, end = out + rows, after
            if n >= self.budget:
                break
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if start != end:
            for rows, after in self._pages(start):
                yield from rows
                if after == end:
                    break

    def commit(self, end: dict) -> None:
        pass


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Events of recorded pages, a JSON document a file, through Spark's own reader."""
    return spark.read.schema(API_PAGE).json(path, multiLine=True).select(F.explode("events").alias("e")).select("e.*")


def distinct_pages(events: DataFrame, most: int | None = None) -> DataFrame:
    """Events of all pages once each by id, the first so many by id."""
    once = events.dropDuplicates(["id"])
    return once if most is None else once.orderBy("id").limit(most)


def searched(events: DataFrame, options: dict[str, str]) -> DataFrame:
    """What a search with such options gives, of events that are here: all keywords, any keyword, days, tags, order, place
    from which on (start, from 1, or offset) and count."""
    whole = F.lower(F.concat_ws(" ", "title", "catch", "description", "address"))

    def has(word: str) -> Column:
        return F.coalesce(F.contains(whole, F.lower(F.lit(word))), F.lit(False))

    for word in filter(None, options.get("keyword", "").split(",")):
        events = events.where(has(word))
    some = [has(w) for w in filter(None, options.get("keyword_or", "").split(","))]
    if some:
        events = events.where(F.greatest(*some, F.lit(False)))
    day = F.regexp_replace(F.substring("started_at", 1, 10), "-", "")
    if options.get("ymd"):
        events = events.where(day >= options["ymd"])
    if options.get("ymd_end"):
        events = events.where(day <= options["ymd_end"])
    if options.get("tag"):
        events = events.where(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, options["tag"].split(",")))), F.lit(False)))
    if options.get("nickname"):
        events = events.where(F.col("owner.nickname") == options["nickname"])
    if options.get("group_id"):
        events = events.where(F.col("group.id") == int(options["group_id"]))
    if options.get("event_id"):
        events = events.where(F.col("id").isin([int(x) for x in options["event_id"].split(",")]))
    if options.get("prefectures"):
        events = events.where(prefecture_code(F.coalesce("address", F.lit(""))).isin(options["prefectures"].split(",")))
    if options.get("order") or options.get("count") or options.get("offset") or options.get("start"):
        by = ORDERS[int(options.get("order", 1))]
        events = events.orderBy(F.desc(by) if by != "started_at" else F.col(by), "id").offset(int(options.get("offset", int(options.get("start", 1)) - 1)))
        events = events.limit(int(options["count"])) if options.get("count") else events
    return events


def upcoming(as_of: str, days: int = 30, count: int = 20, keyword: str | None = None) -> dict[str, str]:
    """Options of a search from a day on for so many days."""
    import datetime as dt

    low = dt.date.fromisoformat(as_of)
    return search_options([keyword] if keyword else [], start=str(low), end=str(low + dt.timedelta(days)), count=count, order=2)


def by_id(events: DataFrame, number: int, overfetch: int | None = None) -> DataFrame:
    """Asked for by its id, so old events are found as well. overfetch: as the catalogue does it, looked for among the first
    so many (100 there) that an unfiltered search gives, which misses events that aren't among them."""
    if overfetch is None:
        return searched(events, {"event_id": str(number)})
    return searched(events, search_options(count=overfetch)).where(F.col("id") == number)


def for_place(events: DataFrame, place: str | None, as_of: str, days: int = 14) -> DataFrame:
    """Events of the days to come that are online or in a user's prefecture."""
    spark = events.sparkSession
    stem = spark.range(1).select(prefecture_stem(F.lit(place or ""))).first()[0]
    options = upcoming(as_of, days, 100)
    return searched(events, options).where(reachable(F.col("place"), F.col("address"), stem))


ONLINE = ONLINE_ADDRESS
