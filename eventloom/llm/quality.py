"""Quality classifier: interpolated modified Kneser-Ney over character n-grams, trained on trusted text.

Trusted rows (quality 1, not toxic) give counts of ORDER-grams of characters, as they stand, for each language and half of
the trusted text: each task sums up its own texts, and hash aggregation over (lang, gram) shards the sums. Discounts, context
totals, continuation counts and the interpolated probabilities come from joins of these count tables on (lang, context) and
(lang, suffix). The tables grow with the trusted text and are never gathered in one place. A gram is its characters' 16-bit
codes in a long, the last one lowest (characters beyond 16 bits share the private codes).

Documents are scored by a sharded join too. Each task asks for the different grams of its own texts (once for each, however
often they stand there), the asked grams are joined with the model's table, and the answers meet the texts in their block:
a number of file splits of about BLOCK_BYTES of text together. Texts travel to their block once, compressed.

A document's perplexity is compared with its language's threshold: the quantile q of trusted text's perplexity there, each
trusted text scored by a model of the other half of trusted text (halves by a hash of the text), as a model is surer of its
own text than of any other. Where the other half has no text, the full model scores. A language has a model of its own when
both halves have text in it; every other row uses the model of all languages together, named "", whose threshold is the
highest of all where no trusted row uses it.

Nulls: a null or empty text has no perplexity and is rejected; a null or unknown language uses the model "". Repeated rows
and ids are scored each. Ties with the threshold are kept. Where counts are too few for a discount (all rows the same) it is
half its count. Without trusted text every document that has text is kept (there is no threshold). Empty tables give no
rows. Other columns, whatever their names, are kept by keep().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

ORDER, QUANTILE = 4, 0.97
BLOCK_BYTES = 32 << 20
#: Different grams that a task holds for a language before it gives them away.
HELD = 1 << 19
#: Stands before a text's first character.
PAD = 2
#: All trusted text; its half 1, which scores half 0; its half 0, which scores half 1.
MODELS = ("f", "0", "1")


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: 16-bit codes with ORDER - 1 pads before each text, where each character stands in them, and
    each text's number of characters."""
    cps = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = (data & 0xC0) != 0x80
    n = np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])
    at = np.arange(len(cps)) + np.repeat((np.arange(len(n)) + 1) * (ORDER - 1), n)
    out = np.full(len(cps) + len(n) * (ORDER - 1), PAD, C.U64)
    out[at] = np.where(cps == 0, 0xFFFD, np.where(cps > 0xFFFF, 0xE000 + cps % 0x1900, cps))
    return out, at, n


def grams(codes: np.ndarray, at: np.ndarray, k: int, behind: int = 0) -> np.ndarray:
    """The grams of k codes that end at (or behind places before) each place."""
    out = np.zeros(len(at), C.U64)
    for j in range(k):
        out |= codes[at - j - behind] << C.U64(16 * j)
    return out


def _merged(parts: list) -> list:
    """One part of several parts (grams, counts)."""
    u = np.unique(np.concatenate([p[0] for p in parts]))
    n = np.zeros(len(u), np.int64)
    for g, x in parts:
        n[np.searchsorted(u, g)] += x
    return [(u, n)]


def half() -> Column:
    """0 or 1 by text, so copies are in the same half."""
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")


def trusted_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    return C.stored(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast(kind).alias("doc_id")).distinct())


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, n0, n1) of trusted texts(lang_id, half, text): counts in each half; language 0 is all of them together."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def flush(name, part):
            cols = [np.full(len(part[0]), name[0], np.int32), part[0].view(np.int64), *(part[1] if name[1] == h else np.zeros(len(part[1]), np.int64) for h in (0, 1))]
            yield from C.batches_of(pa.table(dict(zip(["lang", "gram", "n0", "n1"], cols, strict=True))))

        for b in batches:
            lang, halves = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, data, offsets in C.text_blocks(b.column(2)):
                codes, at, n = padded(data, offsets)
                name = (lang[i : i + len(n)] * 2 + halves[i : i + len(n)]).astype(np.int64)
                owner = np.repeat(name, n)
                for x in np.unique(owner).tolist():
                    parts = held.setdefault((x // 2, x % 2), [])
                    parts.append(np.unique(grams(codes, at[owner == x], ORDER), return_counts=True))
                    if sum(len(p[0]) for p in parts) > HELD:
                        parts[:] = _merged(parts)
                        if len(parts[0][0]) > HELD // 2:
                            yield from flush((x // 2, x % 2), held.pop((x // 2, x % 2))[0])
        for name, parts in held.items():
            yield from flush(name, _merged(parts)[0])

    parts = texts.select("lang_id", "half", "text").mapInArrow(C.tidy(run), "lang int, gram long, n0 long, n1 long")
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    both = F.when(F.col("lang") == 0, F.array("lang")).otherwise(F.array(F.col("lang"), F.lit(0)))
    return parts.groupBy("lang", "gram").agg(*sums).select(F.explode(both).alias("lang"), "gram", "n0", "n1").groupBy("lang", "gram").agg(*sums)


def _low(c: Column, k: int) -> Column:
    """The last k characters of a gram."""
    return c.bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k else F.lit(0).cast("long")


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """For each order from 1, stored: (lang, gram, p_m for each model m, null where the model hasn't seen it, and g_m: as a
    context of the order below, what it leaves to shorter grams). counts: stored (lang, gram of ORDER characters, n0, n1).
    Order 1's context is gram 0, with an unknown character's p."""
    by_order = {ORDER: counts.select("lang", "gram", (F.col("n0") + F.col("n1")).alias("n_f"), F.col("n1").alias("n_0"), F.col("n0").alias("n_1"))}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = C.stored(by_order[k + 1].groupBy("lang", _low(F.col("gram"), k).alias("gram")).agg(*[F.count_if(F.col(f"n_{m}") > 0).alias(f"n_{m}") for m in MODELS]))
    out: list[DataFrame] = []
    done = [by_order[k] for k in range(1, ORDER)]
    for k in range(1, ORDER + 1):
        c = by_order[k].withColumn("ctx", F.shiftrightunsigned("gram", 16))
        of = c.groupBy("lang").agg(*[x for m in MODELS for x in (F.count_if(F.col(f"n_{m}") > 0).alias(f"kinds_{m}"), *(F.count_if(F.col(f"n_{m}") == i).cast("double").alias(f"{m}{i}") for i in range(1, 5)))])
        cuts = []
        for m in MODELS:
            y = F.try_divide(f"{m}1", F.col(f"{m}1") + 2 * F.col(f"{m}2"))
            cuts += [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(f"{m}{i + 1}", f"{m}{i}"), F.lit(0.5 * i)))).alias(f"d_{m}{i}") for i in (1, 2, 3)]
        of = C.stored(of.select("lang", *[f"kinds_{m}" for m in MODELS], *cuts))  # a row for each language
        done.append(of)
        c = c.join(C.sized(of), "lang")
        c = c.withColumns({f"d_{m}": F.when(F.col(f"n_{m}") == 0, 0.0).when(F.col(f"n_{m}") == 1, F.col(f"d_{m}1")).when(F.col(f"n_{m}") == 2, F.col(f"d_{m}2")).otherwise(F.col(f"d_{m}3")) for m in MODELS})
        ctx = c.groupBy("lang", "ctx").agg(*[x for m in MODELS for x in (F.sum(f"n_{m}").alias(f"total_{m}"), F.try_divide(F.sum(f"d_{m}"), F.sum(f"n_{m}")).alias(f"g_{m}"), F.max(f"kinds_{m}").alias(f"kinds_{m}"))])
        own = {m: (F.col(f"n_{m}") - F.col(f"d_{m}")) / F.col(f"total_{m}") for m in MODELS}
        c = c.drop(*[f"kinds_{m}" for m in MODELS]).join(ctx, ["lang", "ctx"])
        if k == 1:
            below = {m: F.lit(1.0) / (F.col(f"kinds_{m}") + 1) for m in MODELS}
        else:
            lower = out[-1].select("lang", F.col("gram").alias("suffix"), *[F.col(f"p_{m}").alias(f"q_{m}") for m in MODELS])
            c = c.withColumn("suffix", _low(F.col("gram"), k - 1)).join(lower, ["lang", "suffix"])
            below = {m: F.col(f"q_{m}") for m in MODELS}
        p = c.select("lang", "gram", *[F.when(F.col(f"n_{m}") > 0, own[m] + F.col(f"g_{m}") * below[m]).alias(f"p_{m}") for m in MODELS], *[F.lit(None).cast("double").alias(f"g_{m}") for m in MODELS])
        unknown = [(F.col(f"g_{m}") / (F.col(f"kinds_{m}") + 1) if k == 1 else F.lit(None).cast("double")).alias(f"p_{m}") for m in MODELS]
        out.append(C.stored(p.unionByName(ctx.select("lang", F.col("ctx").alias("gram"), *unknown, *[f"g_{m}" for m in MODELS]))))
    C.discard(*done)
    return out


def _table(orders: list[DataFrame]) -> DataFrame:
    """(lang, gram, logarithms of p_m and g_m), stored."""
    rows = orders[0]
    for x in orders[1:]:
        rows = rows.unionByName(x)
    cols = [f"{x}_{m}" for m in MODELS for x in "pg"]
    return C.stored(rows.groupBy("lang", "gram").agg(*[F.log(F.max(x)).cast("float").alias(x) for x in cols]))


class Model:
    """table: (lang, gram, ...); langs: names of those with models of their own, numbered from 1; trusted: ids."""

    def __init__(self, langs: list[str], table: DataFrame, trusted: DataFrame):
        self.langs, self.table, self.trusted = langs, table, trusted

    def discard(self) -> None:
        C.discard(self.table, self.trusted)


def _numbered(docs: DataFrame, langs: list[str]) -> DataFrame:
    """docs with model_lang and lang_id; the list is as long as there are languages."""
    own = docs.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(langs)], "lang string, __id int")
    rows = docs.join(F.broadcast(own), "lang", "left")
    return rows.withColumns({"model_lang": F.when(F.col("__id").isNotNull(), F.col("lang")).otherwise(F.lit("")), "lang_id": F.coalesce("__id", F.lit(0))}).drop("__id")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the trusted rows of docs(doc_id, lang, text) by labels(doc_id, quality, toxic); None without any."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    good = trusted_ids(docs, labels)
    trusted = C.having(docs.where("length(text) > 0"), good).withColumn("half", half())
    found = trusted.where("lang <> ''").groupBy("lang").agg(F.count_distinct("half").alias("halves")).where("halves = 2").select("lang").collect()
    langs = sorted(r[0] for r in found)
    counts = C.stored(count_grams(_numbered(trusted, langs)))
    if counts.isEmpty():
        C.discard(good, counts)
        return None
    orders = kneser_ney(counts)
    model = Model(langs, _table(orders), good)
    C.discard(counts, *orders)
    return model


def _placed(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, lang, text, ...) with model_lang, __half (of a trusted row), __split and __block."""
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = F.lit(1 + held // BLOCK_BYTES)
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    content = F.xxhash64("doc_id", "lang", "text")
    docs = docs.withColumn("__split", F.when(F.input_file_name() == "", F.lit(0)).otherwise(split)).withColumn("__block", F.pmod(F.when(F.col("__split") == 0, content).otherwise(F.col("__split")), blocks))
    mark = C.sized(model.trusted).withColumn("__trusted", F.lit(True))
    docs = docs.join(mark, "doc_id", "left").withColumn("__half", F.when(F.col("__trusted"), half())).drop("__trusted")
    return _numbered(docs, model.langs)


def _asks(placed: DataFrame) -> DataFrame:
    """(block, lang, gram): the grams, of every order, of each block's texts, once a task or more; and its file splits, as
    grams of language -1."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        marks: set[tuple[int, int]] = set()

        def table(block, lang, gram):
            yield from C.batches_of(pa.table({"block": np.full(len(gram), block), "lang": np.full(len(gram), lang, np.int32), "gram": gram}))

        def flush(name, u):
            for k in range(ORDER + 1):  # order 0: an unknown character's
                yield from table(*name, np.unique(u & C.U64((1 << (16 * k)) - 1)).view(np.int64))
            pads = np.array([sum(PAD << (16 * j) for j in range(k)) for k in range(1, ORDER)], np.int64)  # contexts that stand before a text
            yield from table(*name, pads)

        for b in batches:
            lang, split, block = (b.column(c).to_numpy() for c in range(3))
            for pair in set(zip(block.tolist(), split.tolist(), strict=True)) - marks:
                marks.add(pair)
                yield from table(pair[0], -1, np.array([pair[1]]))
            for i, data, offsets in C.text_blocks(b.column(3)):
                codes, at, n = padded(data, offsets)
                here, langs = np.repeat(block[i : i + len(n)], n), np.repeat(lang[i : i + len(n)], n)
                for name in set(zip(block[i : i + len(n)][n > 0].tolist(), lang[i : i + len(n)][n > 0].tolist(), strict=True)):
                    parts = held.setdefault(name, [])
                    parts.append(np.unique(grams(codes, at[(here == name[0]) & (langs == name[1])], ORDER)))
                    if sum(len(p) for p in parts) > HELD:
                        parts[:] = [np.unique(np.concatenate(parts))]
                        if len(parts[0]) > HELD // 2:
                            yield from flush(name, held.pop(name)[0])
        for name, parts in held.items():
            yield from flush(name, np.unique(np.concatenate(parts)))

    return placed.select("lang_id", "__split", "__block", "text").mapInArrow(C.tidy(run), "block long, lang int, gram long")


def _packed(placed: DataFrame) -> DataFrame:
    """(block, blob): rows as compressed Arrow streams of about C.BLOCK_BYTES of text."""

    def run(batches):
        for b in batches:
            block = b.column(b.schema.get_field_index("__block")).to_numpy()
            size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("text"))), 0)).astype(np.int64)
            for own in np.unique(block):
                rows = np.flatnonzero(block == own)
                for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // C.BLOCK_BYTES)) + 1):
                    part, sink = b.take(pa.array(some)), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([int(own)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "blob"])

    return placed.mapInArrow(C.tidy(run), "block long, blob binary")


class Answers:
    """What a block has been told: by language, its grams' log p and log g for each model."""

    def __init__(self, parts: list):
        """parts: lists of a batch's columns (language, gram, values), each column given up as it is joined; by language."""
        lang = np.concatenate([p.pop(0) for p in parts])
        order = None if (lang[1:] >= lang[:-1]).all() else np.argsort(lang, kind="stable")
        columns = []
        while parts and parts[0]:
            whole = np.concatenate([p.pop(0) for p in parts])
            columns.append(whole if order is None else whole[order])
        lang = lang if order is None else lang[order]
        gram, *self.values = columns
        names = np.unique(lang)
        cuts = np.searchsorted(lang, np.append(names, np.iinfo(lang.dtype).max)).tolist()
        self.place = {x: (a, pd.Index(gram[a:b])) for x, a, b in zip(names.tolist(), cuts[:-1], cuts[1:], strict=True)}

    def find(self, lang: int, gram: np.ndarray, column: int) -> np.ndarray:
        """The values of a column; nan where there is none."""
        first, index = self.place.get(lang, (0, pd.Index([], dtype=np.int64)))
        found, out = index.get_indexer(gram.view(np.int64)), np.full(len(gram), np.nan)
        out[found >= 0] = self.values[column][first + found[found >= 0]]
        return out

    def costs(self, codes: np.ndarray, at: np.ndarray, lang: int, model: int) -> np.ndarray:
        """log p of the character at each place; nan where the model has no text."""
        out, weight, left = np.full(len(at), np.nan), np.zeros(len(at)), np.arange(len(at))
        for k in range(ORDER, -1, -1):
            p = self.find(lang, grams(codes, at[left], k), 2 * model)
            seen = ~np.isnan(p)
            out[left[seen]] = weight[left[seen]] + p[seen]
            left = left[~seen]
            if not len(left):
                break
            if k > 1:  # order 1's unknown characters have their weight within
                weight[left] += np.nan_to_num(self.find(lang, grams(codes, at[left], k - 1, 1), 2 * model + 1))
        return out


def _scored(columns: list[str]):
    """Rows (block, lang, gram, values, blob) by block, answers before blobs: the blobs' rows with their perplexities."""

    def run(batches):
        now, parts, answers = None, [], None
        for b in batches:
            blocks, blobs = b.column(0).to_numpy(), b.column(b.num_columns - 1)
            told = np.asarray(blobs.is_null())
            cuts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (told[1:] != told[:-1]), [True]]))
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if blocks[a] != now:
                    now, parts, answers = blocks[a], [], None
                some = b.slice(a, e - a)
                if told[a]:
                    parts.append([some.column(1).to_numpy(), some.column(2).to_numpy(), *(some.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in range(3, b.num_columns - 1))])
                    continue
                if answers is None:
                    answers, parts = Answers(parts or [[np.zeros(0, np.int64)] * (b.num_columns - 2)]), []
                for blob in some.column(b.num_columns - 1):
                    yield from one(answers, pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks())

    def one(answers, table):
        lang, halves = table["lang_id"].to_numpy(), table["__half"].fill_null(-1).to_numpy()
        marks = answers.place.get(-1, (None, pd.Index([], dtype=np.int64)))[1]
        if (marks.get_indexer(np.unique(table["__split"].to_numpy())) < 0).any():
            raise RuntimeError("a file split was cut differently when it was read again")
        out = np.full((2, table.num_rows), np.nan)
        for i, data, offsets in C.text_blocks(table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]):
            codes, at, n = padded(data, offsets)
            own, half_ = lang[i : i + len(n)], halves[i : i + len(n)]
            for x in np.unique(own[n > 0]).tolist():
                for model, rows in ((0, own == x), (1, (own == x) & (half_ == 0)), (2, (own == x) & (half_ == 1))):
                    mine = rows & (n > 0)
                    if not mine.any():
                        continue
                    cost = answers.costs(codes, at[np.repeat(mine, n)], x, model)
                    size = n[mine]
                    out[int(model > 0), i + np.flatnonzero(mine)] = np.exp(-np.add.reduceat(cost, np.cumsum(size) - size) / size)
        found = table.select(columns).append_column("perplexity", pa.array(out[0], from_pandas=True)).append_column("held_out", pa.array(out[1], from_pandas=True))
        yield from found.to_batches()

    return run


def _perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, lang, text, ...) with model_lang, perplexity and held_out (a trusted row's, by the other half's model)."""
    placed = _placed(docs, model)
    none, cols = F.lit(None), [f"{x}_{m}" for m in MODELS for x in "pg"]
    asked = _asks(placed).distinct().join(model.table, ["lang", "gram"], "left").where("lang = -1 or " + " or ".join(f"{x} is not null" for x in cols))
    told = asked.select("block", "lang", "gram", *cols, none.cast("binary").alias("blob"))
    rows = told.unionByName(_packed(placed).select("block", none.cast("int").alias("lang"), none.cast("long").alias("gram"), *[none.cast("float").alias(x) for x in cols], "blob"))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("blob").isNotNull(), "lang")
    kinds = [f for f in placed.schema.fields if f.name != "lang_id" and not f.name.startswith("__")]
    schema = T.StructType([*kinds, T.StructField("perplexity", T.DoubleType()), T.StructField("held_out", T.DoubleType())])
    return rows.mapInArrow(C.tidy(_scored([f.name for f in kinds])), schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, lang, text) with model_lang and perplexity (null without text)."""
    return _perplexities(docs, model).drop("held_out")


def thresholds(rows: DataFrame, q: float = QUANTILE) -> dict[str, float]:
    """model_lang -> threshold, of trusted rows(model_lang, perplexity): a row for each language. The quantile itself (the
    smallest value that a share q of values doesn't exceed): counts by fine steps find its step, whose values are ranked."""
    rows = rows.where("perplexity is not null").withColumn("step", F.floor(F.log("perplexity") * 10_000))
    steps = rows.groupBy("model_lang", "step").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("model_lang").orderBy("step")
    steps = steps.withColumn("upto", F.sum("n").over(up_to)).withColumn("rank", F.greatest(F.lit(1), F.ceil(q * F.sum("n").over(Window.partitionBy("model_lang")) - 1e-9)))
    hit = steps.where("upto >= rank and upto - n < rank").select("model_lang", "step", (F.col("rank") - F.col("upto") + F.col("n")).alias("place"))
    order = Window.partitionBy("model_lang", "step").orderBy("perplexity")
    near = rows.join(hit, ["model_lang", "step"]).withColumn("r", F.row_number().over(order)).where("r = place")
    found = {r["model_lang"]: r["perplexity"] for r in near.select("model_lang", "perplexity").collect()}
    if "" not in found and found:
        found[""] = max(found.values())
    return found


def verdicts(docs: DataFrame, labels: DataFrame, columns: list[str], q: float = QUANTILE) -> DataFrame:
    """columns (of docs, computed from doc_id, lang and text), perplexity, threshold and keep for each row of docs."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    with C.small_batches(docs.sparkSession):
        model = fit(docs, labels)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("*", none.alias("perplexity"), none.alias("threshold"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("keep")).selectExpr(*columns, "perplexity", "threshold", "keep")
    # a trusted row is told by its text's having a held-out score, or no other half to have it from
    with C.small_batches(docs.sparkSession):
        rows = C.stored(_perplexities(docs, model).join(C.sized(model.trusted).withColumn("trusted", F.lit(True)), "doc_id", "left").selectExpr(*columns, "model_lang", "perplexity", "held_out", "trusted"))
    limits = thresholds(rows.where("trusted").select("model_lang", F.coalesce("held_out", "perplexity").alias("perplexity")), q)
    model.discard()
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("model_lang")) if limits else F.lit(None).cast("double")
    rows = rows.withColumn("threshold", limit)
    return rows.withColumn("keep", F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False))).drop("model_lang", "held_out", "trusted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for each row of docs(doc_id, lang, text)."""
    return verdicts(docs, labels, ["doc_id", "lang"]).select("doc_id", "lang", "perplexity", "threshold", "keep")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept; same columns. A verdict follows from language and text alone, so rejected ones are
    taken out by two hashes of these; the texts that stay aren't shuffled while the hashes are few enough to broadcast."""
    lang = "coalesce(lang, '')"
    bad = verdicts(docs, labels, [f"xxhash64({lang}, text) as h1", f"hash({lang}, text, 1) as h2"]).where("not keep").select("h1", "h2").distinct()
    bad = C.sized(C.stored(bad))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = inner.select("__row", F.expr(f"xxhash64({lang}, text)").alias("h1"), F.expr(f"hash({lang}, text, 1)").alias("h2"))
    return rows.join(bad, ["h1", "h2"], "left_anti").select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
