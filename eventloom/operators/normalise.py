"""Normalisation of ingested records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.semantics import any_has, first_match, has, trimmed

# Type, words within the title, words that are tags; format and its words; words of online places.
TYPE_WORDS = [
    ("HACKATHON", ["ハッカソン"], ["hackathon", "ハッカソン"]),
    ("CONTEST", ["コンテスト"], ["contest", "コンテスト"]),
    ("LIGHTNING_TALK", ["lt", "ライトニングトーク"], ["lightning_talk", "lt", "ライトニングトーク"]),
]
FORMAT_WORDS = [("ONLINE", ["オンライン", "online", "zoom", "teams", "meet", "virtual"]), ("HYBRID", ["ハイブリッド", "hybrid"])]
ONLINE_WORDS = ["オンライン", "online", "zoom", "teams", "virtual"]
PREFECTURES = (
    "北海道 青森 岩手 宮城 秋田 山形 福島 茨城 栃木 群馬 埼玉 千葉 東京 神奈川 新潟 富山 石川 福井 山梨 長野 岐阜 静岡 愛知 三重 "
    "滋賀 京都 大阪 兵庫 奈良 和歌山 鳥取 島根 岡山 広島 山口 徳島 香川 愛媛 高知 福岡 佐賀 長崎 熊本 大分 宮崎 鹿児島 沖縄"
).split()
#: Formal names that aren't the stem and 県.
SPECIAL_NAMES = {"北海道": "北海道", "東京": "東京都", "京都": "京都府", "大阪": "大阪府"}


def formal_name(stem: str) -> str:
    return SPECIAL_NAMES.get(stem, stem + "県")


def event_type(title: Column, tags: Column | None = None, rules=TYPE_WORDS, default: str = "WORKSHOP") -> Column:
    """The first type one of whose title words the title contains, or one of whose tags is a tag; case doesn't matter."""
    out = F.lit(default)
    for label, words, names in reversed(rules):
        hit = any_has([title], words[0])
        for w in words[1:]:
            hit = hit | has(title, w)
        if tags is not None:
            hit = hit | F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, names))), F.lit(False))
        out = F.when(hit, label).otherwise(out)
    return out


def event_format(place: Column, rules=FORMAT_WORDS, default: str = "OFFLINE") -> Column:
    return first_match(place, rules, default)


def location(text: Column, places=PREFECTURES, online=ONLINE_WORDS, online_first: bool = False, unknown: str = "不明") -> Column:
    """The formal name of the first prefecture of the list whose stem the text contains, or オンライン; either order."""
    named = [(formal_name(p), [p]) for p in places]
    net = [("オンライン", online)]
    return first_match(text, net + named if online_first else named + net, unknown)


def prefecture_stem(place: Column, corrected: bool = False) -> Column:
    """What stands before the first 都, 道, 府 or 県. corrected: 京都府 and 北海道 keep their names."""
    cut = place
    for mark in "都道府県":
        cut = F.split(cut, mark)[0]
    if corrected:
        return F.when(place.startswith("京都"), F.lit("京都")).when(place.startswith("北海道"), F.lit("北海道")).otherwise(cut)
    return cut


def month_day(text: Column, year: int) -> Column:
    """M月D日 of the last part after a comma or tilde, in a stated year."""
    last = F.element_at(F.split(text, "[,~～]"), -1)
    m, d = (F.regexp_extract(last, r"(\d{1,2})月(\d{1,2})日", i) for i in (1, 2))
    return F.to_date(F.when(F.length(m) > 0, F.concat_ws("-", F.lit(str(year)), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))))


def time_range(text: Column) -> tuple[Column, Column]:
    """Start and end of YYYY/MM/DD(x)HH:MM～HH:MM; the end defaults to the start."""
    pattern = r"(\d{4}/\d{2}/\d{2})[^0-9]*(\d{2}:\d{2})(?:\s*[～~-]\s*(\d{2}:\d{2}))?"
    day, low, high = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    ok = F.length(day) > 0
    at = lambda t: F.when(ok, F.to_timestamp(F.concat_ws(" ", day, t), "yyyy/MM/dd HH:mm"))
    return at(low), at(F.when(F.length(high) > 0, high).otherwise(low))


def capacity(text: Column) -> tuple[Column, Column]:
    """Current and most of "n人 ／ 定員m人"; 0 by default."""
    parts = (F.regexp_extract(text, r"(\d+)人", 1), F.regexp_extract(text, r"定員\s*(\d+)人", 1))
    now, most = (F.coalesce(F.nullif(p, F.lit("")).try_cast("int"), F.lit(0)) for p in parts)
    return now, most


def tag_words(text: Column) -> Column:
    """Comma-separated words, trimmed, blank ones dropped, distinct in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,、]"), trimmed), lambda x: F.length(x) > 0))


def strip_html(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    out = F.regexp_replace(out, r"&[A-Za-z]+;", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_text(html: Column) -> Column:
    out = html
    for tag in ("script", "style", "nav", "header", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return strip_html(out)


# Codes of the prefectures, in the order in which they are tried.
CODES = [
    ("東京", "tokyo"), ("大阪", "osaka"), ("京都", "kyoto"), ("兵庫", "hyogo"), ("福岡", "fukuoka"), ("北海道", "hokkaido"), ("愛知", "aichi"),
    ("神奈川", "kanagawa"), ("埼玉", "saitama"), ("千葉", "chiba"), ("静岡", "shizuoka"), ("広島", "hiroshima"), ("宮城", "miyagi"), ("沖縄", "okinawa"),
    ("茨城", "ibaraki"), ("栃木", "tochigi"), ("群馬", "gunma"), ("新潟", "niigata"), ("富山", "toyama"), ("石川", "ishikawa"), ("福井", "fukui"),
    ("山梨", "yamanashi"), ("長野", "nagano"), ("岐阜", "gifu"), ("三重", "mie"), ("滋賀", "shiga"), ("奈良", "nara"), ("和歌山", "wakayama"),
    ("鳥取", "tottori"), ("島根", "shimane"), ("岡山", "okayama"), ("山口", "yamaguchi"), ("徳島", "tokushima"), ("香川", "kagawa"), ("愛媛", "ehime"),
    ("高知", "kochi"), ("佐賀", "saga"), ("長崎", "nagasaki"), ("熊本", "kumamoto"), ("大分", "oita"), ("宮崎", "miyazaki"), ("鹿児島", "kagoshima"),
    ("青森", "aomori"), ("岩手", "iwate"), ("秋田", "akita"), ("山形", "yamagata"), ("福島", "fukushima"),
]


def prefecture_code(place: Column, default: str = "online") -> Column:
    """The code of the first prefecture of the list that a place contains."""
    return first_match(place, [(code, [name]) for name, code in CODES], default)


def api_event(zone: str = "Asia/Tokyo", organisation: str | None = None, override: Column | None = None) -> list[Column]:
    """Columns of an event from an API record (id, title, catch, description, url, started_at, ended_at, place, address, tags).

    Times of day are those of a zone. override: a place that wins over the one found."""
    started, ended = (F.to_timestamp(F.col(c)) for c in ("started_at", "ended_at"))
    venue = F.coalesce(F.nullif(F.col("place"), F.lit("")), F.lit("未定"))
    where = location(F.concat_ws(" ", venue, F.coalesce("address", F.lit(""))))
    return [
        F.concat(F.lit("connpass_"), F.col("id").cast("string")).alias("id"), "title",
        F.coalesce(F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("catch"), F.lit("")), F.lit("")).alias("description"),
        started.alias("eventDate"), F.date_format(F.from_utc_timestamp(started, zone), "HH:mm").alias("startTime"), F.date_format(F.from_utc_timestamp(ended, zone), "HH:mm").alias("endTime"),
        venue.alias("venue"), F.nullif(F.col("address"), F.lit("")).alias("address"), (F.coalesce(F.nullif(override, F.lit("")), where) if override is not None else where).alias("location"),
        F.col("url").alias("detailUrl"), F.lit(organisation).cast("string").alias("organizationId"), event_format(F.coalesce("place", F.lit(""))).alias("format"),
        F.lit("FOR_EVERYONE").alias("difficulty"), F.lit(0).alias("price"), event_type(F.col("title"), F.col("tags")).alias("eventType"),
    ]


def level(points: Column) -> Column:
    """The level that old rows get: beginners have points to their credit."""
    return F.when(points > 0, "BEGINNER").otherwise("ADVANCED")
