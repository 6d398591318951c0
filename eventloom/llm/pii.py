"""Personal data: patterns, and information-theoretic sanitisation of the terms that give protected entities away.

All of it is DataFrame functions. Base spans (email, ip, card, phone) come from patterns. The values found are the
protected entities. For each word t near an entity e (within CONTEXT characters, whole words), the corpus tells how
strongly t reveals e. All counts are of different texts (copies of a text count once): n_te have t near e, n_e have e, n_t
have t anywhere; N is the sum of n_t. Every pair is scored, however rare: t is disclosing when n_te / (n_t + PRIOR) >=
SHARE and the smoothed pointwise mutual information log2(n_te N / ((n_t + PRIOR) n_e)) >= BITS. So a word that stands in
one text only, beside an entity, discloses it. Disclosing terms are spans of kind "term" wherever they stand, outside base
spans; sanitise() generalises every span to its kind's tag.

Counts are hash aggregates with map-side combination; the list of disclosing terms is broadcast when it has at most
BROADCAST_TERMS rows and BROADCAST_BYTES, and joined by shuffle beyond, behind a bitmap of bounded size. So is the list of
each text's disclosing terms, up to BROADCAST_BYTES; texts themselves then aren't shuffled. A word is a run of three letters
or more, however long.

Null and empty texts have no spans; null and repeated ids are carried, a row each. Ties have no influence. Empty tables
give no rows. Other columns are kept by sanitise() and ignored by spans().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
CONTEXT, PRIOR, SHARE, BITS = 60, 1, 0.5, 8.0
BROADCAST_TERMS, BROADCAST_BYTES = 50_000, 32 << 20

# The stated patterns, without backtracking into what can't match: the possessive forms and the guard on an email's first
# character change no match and keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]{13,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}{3,}+"


#: Matches of a text that are folded together; arrays that grow by one are copied within these only.
FOLD = 128


def folded(items: Column, zero: Column, kind: str, step) -> Column:
    """Folds an array into (at, out): step(at, item) gives the next at and an array of kind to add to out. In chunks, so the
    time is in proportion to the items and not to their square."""
    none, parts = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(acc, x):
        at, more = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def chunk(acc, i):
        own = F.aggregate(F.slice(items, i * FOLD + 1, FOLD), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        # within transform, own is worked out once
        return F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / FOLD).cast("int"))
    return F.aggregate(chunks, F.struct(zero.alias("at"), parts.alias("out")), chunk, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))


def once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("h"))

    def step(at, x):
        start = at + F.length(x["p"])
        end = start + F.length(x["h"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("value")))

    found = F.filter(both, lambda x: x["h"].isNotNull())
    return once(found, lambda items: folded(items, F.lit(0), "struct<start:int,end:int,value:string>", step)["out"])


#: Code points of the pieces that a text is cut into, so that a place in it is found without counting from its start.
PIECE = 4096


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(pieces_: Column, start: Column, length: Column) -> Column:
    """length code points from start (from 0) on of a text in pieces()."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + length) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces_, first + 1, last - first + 1), ""), start % PIECE + 1, length)


def outside(found: Column, base: Column) -> Column:
    """Those of found (spans that don't overlap, in order) that overlap no span of base: one pass over both, by start. A span
    of found waits until the next span of base, or of found, shows that none begins within it."""
    def tagged(spans, own):
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["value"].alias("value")))

    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    every = F.array_sort(F.concat(tagged(base, 0), tagged(found, 1)))
    state = F.struct(F.lit(0).alias("covered"), none.alias("waiting"))

    def step(at, x):
        is_base = x["own"] == 0
        hit = is_base & F.exists(at["waiting"], lambda w: x["start"] < w["end"])
        kept = F.when(hit, none).otherwise(at["waiting"])
        span = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
        covered = F.when(is_base, F.greatest(at["covered"], x["end"])).otherwise(at["covered"])
        # what waits is settled by a span of found; a span of base leaves it waiting, as the next may begin within it too
        waiting = F.when(is_base, kept).when(x["start"] < at["covered"], none).otherwise(span)
        return F.struct(covered.alias("covered"), waiting.alias("waiting")), F.when(is_base, none).otherwise(kept)

    return once(every, lambda items: once(folded(items, state, "struct<start:int,end:int,value:string>", step), lambda done: F.concat(done["out"], done["at"]["waiting"])))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def term(i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array<struct<start, end, value>> by the stated patterns and checks."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def only(gate, found):
        return F.coalesce(F.when(gate, found), none)

    def part_ok(p):
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))

    def count(v):
        return F.length(F.regexp_replace(v, "[^0-9]", ""))

    joined = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", "0")
    cards = once(pieces(text), lambda ps: F.transform(matches(joined, CARD), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), part(ps, x["start"], x["end"] - x["start"]).alias("value"))))

    def card_ok(x):
        digits = F.regexp_replace(x["value"], "[^0-9]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)

    return {
        "email": only(text.contains("@"), matches(text, EMAIL)),
        "ip": only(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), lambda x: F.forall(F.split(x["value"], r"\."), part_ok))),
        "card": only(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), F.filter(cards, card_ok)),
        "phone": only(text.contains("+"), F.filter(matches(text, PHONE), lambda x: count(x["value"]).between(9, 15))),
    }


def contexts(docs: DataFrame) -> DataFrame:
    """(text_key, entity, context): what stands around each base span of docs(text, the kinds' columns), without the spans themselves."""
    def kinded(k):
        return F.transform(F.col(k), lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    def around(ps, s):
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = part(ps, low, s["start"] - low)
        before = F.when(low > 0, F.regexp_replace(before, r"^\S*", "")).otherwise(before)
        after = F.regexp_replace(part(ps, s["end"], F.lit(CONTEXT)), r"\S*$", "")
        return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.lower(F.concat(before, F.lit(" "), after)).alias("context"))

    # contexts first, then a row for each: texts aren't copied by span
    every = once(pieces(F.col("text")), lambda ps: F.transform(F.concat(*[kinded(k) for k in KINDS]), lambda s: around(ps, s)))
    rows = docs.where(" or ".join(f"size({k}) > 0" for k in KINDS)).select(F.xxhash64("text").alias("text_key"), F.explode(every).alias("s"))
    return rows.select("text_key", "s.entity", "s.context")


def disclosing(docs: DataFrame, with_spans: DataFrame) -> DataFrame:
    """(term): see the module. with_spans: docs with the kinds' columns."""
    near = C.stored(contexts(with_spans).distinct())
    entities = C.stored(near.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_e")))
    pairs = near.select("text_key", "entity", F.explode(F.regexp_extract_all("context", F.lit(WORD), F.lit(0))).alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_te")).join(C.sized(entities), "entity")
    # entities with the same counts are scored alike: a common word is a few rows
    pairs = C.stored(pairs.select("term", "n_te", "n_e").distinct())
    corpus = C.stored(_distinct_texts(docs).groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_t")))
    total = corpus.agg(F.sum("n_t").alias("total"))
    scored = pairs.join(corpus, "term").crossJoin(F.broadcast(total))
    seen = F.col("n_t") + PRIOR
    bits = F.log2(F.col("n_te") * F.col("total") / (seen * F.col("n_e")))
    return scored.where((F.col("n_te") / seen >= SHARE) & (bits >= BITS)).select("term").distinct()


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """(term, share): each text's different words; the shares of a text's copies add up to 1."""
    key = F.xxhash64("text")
    copies = C.stored(docs.groupBy(key.alias("copy_key")).agg(F.count("*").alias("copies")).where("copies > 1"))
    rows = docs.join(C.sized(copies), key == F.col("copy_key"), "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    return rows.select("share", F.explode(_words()).alias("term"))


def _words() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))


def with_terms(docs: DataFrame, with_spans: DataFrame) -> DataFrame:
    """with_spans and the column term. docs: the corpus; with_spans: its rows with the kinds' columns."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    terms = C.stored(disclosing(docs, with_spans))
    count = terms.count()
    if not count:
        return with_spans.withColumn("term", none)
    key = F.md5(F.col("text").cast("binary"))
    words = docs.select(key.alias("text_key"), F.explode(_words()).alias("term"))
    few = count <= BROADCAST_TERMS and C.bytes_of(terms) <= BROADCAST_BYTES
    if not few:
        hashed = F.xxhash64("term")
        words = C.likely(words.withColumn("h", hashed), "h", terms.select(hashed.alias("h"))).drop("h")
    of = C.stored(words.join(F.broadcast(terms) if few else terms, "term").groupBy("text_key").agg(F.collect_set("term").alias("terms")))
    held = of.agg(F.sum(F.length("text_key") + F.length(F.array_join("terms", " ")) + 8 * F.size("terms"))).first()[0] or 0
    rows = with_spans.withColumn("text_key", key).join(F.broadcast(of) if held <= BROADCAST_BYTES else of, "text_key", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array("terms"), "|"), F.lit(r")(?!\p{L})"))
    free = outside(matches(F.col("text"), pattern), F.concat(*KINDS))
    return rows.withColumn("term", F.when(F.col("terms").isNotNull(), free).otherwise(none)).drop("text_key", "terms")


def joined(kinds) -> Column:
    def named(k):
        return F.transform(F.col(k), lambda x: F.concat_ws(":", F.lit(k), x["start"], x["end"]))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def _found(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("text", text)
    return docs.withColumns(base_spans(F.col("text")))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = with_terms(docs.withColumn("text", F.coalesce("text", F.lit(""))), _found(docs))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(KINDS).cast("binary"), 256).alias("base_sha256"), joined((*KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span of text generalised to [KIND]; same columns. Overlapping spans become the first one's tag."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("text").alias("text"))
    rows = with_terms(docs.select(F.coalesce("text", F.lit("")).alias("text")), _found(inner))
    kinds = (*KINDS, "term")

    def tagged(k):
        return F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag")))

    every = F.array_sort(F.concat(*[tagged(k) for k in kinds]))
    text = F.col("text")

    def cleaned(ps):
        def step(at, x):
            between = part(ps, at, x["start"] - at)
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(between, x["tag"])).otherwise(F.expr("cast(array() as array<string>)"))

        def joined_up(done):
            return F.concat(F.array_join(done["out"], ""), part(ps, done["at"], F.length(text)))

        return once(folded(F.col("__every"), F.lit(0), "string", step), joined_up)

    clean = once(pieces(text), cleaned)
    rows = rows.withColumn("__every", every).withColumn("__clean", F.when(F.size("__every") > 0, clean).otherwise(F.col("__row.text")))
    return rows.select(*[F.col("__clean").alias(c) if c == "text" else F.when(F.col("__row.text").isNull(), F.col("__row.n_chars")).otherwise(F.length("__clean")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col("__row").getField(c).alias(c) for c in names])
