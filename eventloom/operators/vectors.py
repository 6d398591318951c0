"""Vector similarity, pooling, ranking and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import cosine

RRF_K, HYBRID_SHARE = 60, 0.5
#: Rows of a query set that are sent to every task at a time.
QUERY_ROWS = 10_000
CORPUS_PARTS = 64
#: Rows of queries and of the corpus that meet as one matrix product, and queries whose products are held at a time.
QUERY_BLOCK, CORPUS_BLOCK, QUERY_STEP = 8192, 65536, 64
#: Bytes of whole lists of similarities that a task holds, the fewest groups that queries are dealt into where lists are
#: ranked in full, and queries of a group where they are pooled.
LIST_BYTES, LIST_GROUPS, POOL_QUERIES = 512 << 20, 64, 1024


def against(queries: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Each row of a stated query set with each row of the corpus, for operators that need all of them. Up to QUERY_ROWS
    queries are broadcast; a larger set is met in blocks: the rows of a block of queries (key: a column of queries that
    tells its rows apart) with each of CORPUS_PARTS parts of the corpus, so that no task holds either side."""
    n = queries.count()
    if n <= QUERY_ROWS:
        return corpus.crossJoin(F.broadcast(queries))
    blocks, parts = -(-n // QUERY_ROWS), CORPUS_PARTS
    number = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    q = queries.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("__part", number(parts))
    rows = corpus.withColumn("__part", F.floor(F.rand(1) * parts)).withColumn("__block", number(blocks))
    return rows.join(q, ["__block", "__part"]).drop("__block", "__part")


def scored(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, id, ..., sim of queries(query_id, q, ...) against corpus(id, v, ...)."""
    both = against(queries, corpus, "query_id")
    return both.withColumn("sim", cosine(F.col("v"), F.col("q"))).drop("v", "q")


def _best_of_block(k: int, floor: float):
    """cogroup function: the k nearest corpus rows of a block to each query row of a block."""

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        carried = [f for f in corpus.schema if f.name not in ("a", "b", "v")]
        names = pa.schema([queries.schema.field("query_id"), *carried, pa.field("sim", pa.float64())])
        if not queries.num_rows or not corpus.num_rows:
            return names.empty_table()
        at = pa.compute.sort_indices(corpus["id"])  # ties go to the smaller id
        corpus = corpus.take(at)
        q, v = (_matrix(t[c]) for t, c in ((queries, "q"), (corpus, "v")))
        if q.shape[1] != v.shape[1]:
            raise ValueError("vectors of different dimensions")
        nq, nv = (np.sqrt((x * x).sum(1)) for x in (q, v))
        own, near, sims = [], [], []
        for low in range(0, len(q), QUERY_STEP):
            part = q[low : low + QUERY_STEP]
            with np.errstate(divide="ignore", invalid="ignore"):
                rough = (part @ v.T) / (nq[low : low + QUERY_STEP, None] * nv)
            rough = np.maximum(np.where(np.isfinite(rough), rough, 0.0), floor)
            for i, row in enumerate(rough):
                # those that may be among the k best when summed in one order, row by row
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                maybe = np.flatnonzero(row >= least - 1e-9)
                size = nq[low + i] * nv[maybe]
                sim = np.maximum(np.where(size == 0, 0.0, (v[maybe] * part[i]).sum(1) / np.where(size == 0, 1.0, size)), floor)
                best = np.argsort(-sim, kind="stable")[:k]
                own.append(np.full(len(best), low + i))
                near.append(maybe[best])
                sims.append(sim[best])
        near = pa.array(np.concatenate(near))
        return pa.Table.from_arrays([queries["query_id"].take(pa.array(np.concatenate(own))), *(corpus[f.name].take(near) for f in carried), pa.array(np.concatenate(sims))], schema=names)

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    sizes = whole.value_lengths().unique()
    if len(sizes) != 1 or whole.null_count:
        raise ValueError("vectors of different dimensions")
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, floor: float = -2.0) -> DataFrame:
    """query_id, id, ..., sim, rank: the k largest cosines (those under floor count as floor) of each row of
    queries(query_id, q) among corpus(id, v, ...), exact, ties to the smaller id. Null vectors take no part; rows of a repeated id count each.

    Both sides are dealt into blocks; a pair of blocks is one matrix product, of which each query keeps its k best, so what
    is shuffled is the corpus for each block of queries, the queries for each block of the corpus, and k rows of each query
    for each block of the corpus. No task holds more than a pair of blocks."""
    queries, corpus = queries.where("q is not null").select("query_id", "q"), corpus.where("v is not null")
    other = [c for c in corpus.columns if c != "v"]
    nq, nv = (max(1, -(-x.count() // size)) for x, size in ((queries, QUERY_BLOCK), (corpus, CORPUS_BLOCK)))
    nv = max(nv, min(8, nq * nv * 8))  # a small corpus is dealt too, so that more than one task works
    asks = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("b"), "query_id", "q")
    rows = corpus.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(nv)).alias("b"), *other, "v")
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for x, names in ((queries, ["query_id"]), (corpus, other)) for c in names)
    found = asks.groupBy("a", "b").cogroup(rows.groupBy("a", "b")).applyInArrow(_best_of_block(k, floor), f"{kinds}, sim double")
    return top(found, "query_id", "sim", "id", k)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(components x rows, rows that are whole): a null vector or one with a null component is zeros and not whole."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths(), column.flatten()
    whole = np.asarray(column.is_valid())
    wide = pa.compute.unique(sizes.drop_null())
    if len(wide) > 1:
        raise ValueError("vectors of different dimensions")
    wide = wide[0].as_py() if len(wide) else 0
    out = np.zeros((wide, len(column)))
    out[:, whole] = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide).T
    if flat.null_count:
        whole[whole] = np.asarray(flat.is_valid()).reshape(-1, wide).all(1)
    return out, whole


class _Asked:
    """The queries of a group, one kind of vector: similarities to a batch of rows, summed component by component, so that equal
    vectors have equal similarities wherever they stand. NaN where a vector is missing."""

    def __init__(self, column: pa.ChunkedArray):
        self.v, self.whole = _vectors(column)
        self.norm = np.sqrt(self._dot(self.v, self.v))

    @staticmethod
    def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, one = np.zeros(a.shape[1]), np.empty(a.shape[1])
        for x, y in zip(a, b, strict=True):
            out += np.multiply(x, y, out=one)
        return out

    def similar(self, column: pa.Array) -> np.ndarray:
        v, whole = _vectors(column)
        if whole.any() and self.whole.any() and len(v) != len(self.v):
            raise ValueError("vectors of different dimensions")
        norm, out = np.sqrt(self._dot(v, v)), np.full((len(self.norm), v.shape[1]), np.nan)
        for i in np.flatnonzero(self.whole):
            size = self.norm[i] * norm
            if len(v) == len(self.v):
                out[i] = np.where(size == 0, 0.0, self._dot(v, self.v[:, i]) / np.where(size == 0, 1.0, size))
        out[:, ~whole] = np.nan
        return out


def _streamed(queries: DataFrame, corpus: DataFrame, groups: int, blocks: int, begin: Callable, schema: str) -> DataFrame:
    """Rows of queries(query_id, q0, q1, ...), dealt into groups, against those of corpus(id, v0, ...), dealt into blocks. A pair
    of a group and a block is a partition, in which the queries come first and then the corpus's rows by id, batch after
    batch: no task holds its rows. begin(queries: a table) gives (add(batch): rows to give out, end(): the same)."""
    qs, vs = ([c for c in x.columns if c[0] == k and c[1:].isdigit()] for x, k in ((queries, "q"), (corpus, "v")))
    other = [c for c in corpus.columns if c not in vs]
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = lambda x, names: [F.lit(None).cast(x.schema[c].dataType).alias(c) for c in names]
    asks = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("a"), number(blocks).alias("b"), F.lit(0).alias("kind"), "query_id", *qs, *nothing(corpus, other + vs))
    rows = corpus.select(number(groups).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"), F.lit(1).alias("kind"), *nothing(queries, ["query_id", *qs]), *other, *vs)
    both = asks.unionByName(rows).repartitionById(groups * blocks, F.col("a") * blocks + F.col("b")).sortWithinPartitions("kind", "id").drop("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, work = [], None
        for b in batches:
            n = int(np.count_nonzero(b["kind"].to_numpy(zero_copy_only=False) == 0))
            if n:
                asked.append(b.slice(0, n).select(["query_id", *qs]))
            if n < b.num_rows and asked:
                work = work or begin(pa.Table.from_batches(asked))
                yield from work[0](b.slice(n).select([*other, *vs]))
        if work:
            yield from work[1]()

    return both.mapInArrow(run, schema)


def _order(sim: np.ndarray) -> np.ndarray:
    """Places by falling similarity, equal ones in their order; a missing one (NaN) is last."""
    return np.argsort(np.where(np.isnan(sim), np.inf, -sim), kind="stable")


def _groups(queries: DataFrame, corpus: DataFrame, lists: int) -> int:
    """Groups of queries whose lists take LIST_BYTES at most (one query's, if they take more)."""
    nq, n = queries.count(), corpus.count()
    return max(1, -(-nq // max(1, LIST_BYTES // (8 * lists * max(n, 1)))), min(nq, LIST_GROUPS))


def _rows(columns: dict[str, pa.Array], step: int = 10_000) -> Iterator[pa.RecordBatch]:
    for part in pa.table(columns).to_batches(step):
        yield part


def fused_nearest(queries: DataFrame, corpus: DataFrame, method: str = "rrf", k: int = RRF_K, share: float = HYBRID_SHARE) -> DataFrame:
    """id, score: fused() by id of the ranked lists of all queries(query_id, q0) over corpus(id, v0), ties to the smaller id.

    A task holds the similarities of its group's queries (LIST_BYTES), ranks list after list, and gives out one sum for each
    row of the corpus, so that pairs are neither shuffled nor rows of a join."""
    kind = corpus.schema["id"].dataType.simpleString()

    def begin(asked: pa.Table):
        lists, ids, sims = _Asked(asked["q0"]), [], []

        def add(b: pa.RecordBatch):
            ids.append(b["id"])
            sims.append(lists.similar(b["v0"]))
            return ()

        def end():
            score = np.zeros(sum(map(len, ids)))
            some = np.zeros(len(score), bool)
            place = k + np.arange(1, len(score) + 1)
            for i in range(asked.num_rows):
                sim = np.concatenate([x[i] for x in sims])
                order = _order(sim)
                sim = sim[order]
                more = {"weighted": sim / place, "hybrid": share * sim + (1 - share) / place}.get(method, 1 / place)
                there = ~np.isnan(more)
                score[order[there]] += more[there]
                some[order[there]] = True
            return _rows({"id": pa.chunked_array(ids).combine_chunks(), "score": pa.array(score, mask=~some)})

        return add, end

    parts = _streamed(queries, corpus, _groups(queries, corpus, 1), 1, begin, f"id {kind}, score double")
    return parts.groupBy("id").agg(F.sum("score").alias("score"))


def pooled_nearest(queries: DataFrame, corpus: DataFrame, key: str, how: str = "max") -> DataFrame:
    """query_id, key, sim: pooled() of the similarities of queries(query_id, q0) with corpus(id, key, v0). Blocks of both meet, and of
    each batch of the corpus only the largest, the sum and the number for each query and key go on."""
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {corpus.schema[key].dataType.simpleString()}, most double, total double, n long"
    groups = max(1, -(-queries.count() // POOL_QUERIES))
    blocks = max(1, -(-corpus.count() // CORPUS_BLOCK), -(-LIST_GROUPS // groups))

    def begin(asked: pa.Table):
        steps = [(asked["query_id"].slice(i, QUERY_STEP), _Asked(asked["q0"].slice(i, QUERY_STEP))) for i in range(0, asked.num_rows, QUERY_STEP)]

        def add(b: pa.RecordBatch):
            found = b[key].dictionary_encode(null_encoding="encode")
            code = found.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            for own, lists in steps:
                sim = lists.similar(b["v0"])[:, order]
                gone = np.isnan(sim)
                most = np.maximum.reduceat(np.where(gone, -np.inf, sim), first, axis=1).ravel()
                total, n = (np.add.reduceat(x, first, axis=1).ravel() for x in (np.where(gone, 0.0, sim), (~gone).astype(np.int64)))
                keys = found.dictionary.take(pa.array(np.tile(code[order][first], len(own))))
                yield from _rows({"query_id": own.combine_chunks().take(pa.array(np.repeat(np.arange(len(own)), len(first)))), key: keys, "most": pa.array(most, mask=n == 0), "total": pa.array(total, mask=n == 0), "n": pa.array(n)})

        return add, lambda: ()

    parts = _streamed(queries, corpus, groups, blocks, begin, kinds)
    best = F.max("most") if how == "max" else F.sum("total") / F.nullif(F.sum("n"), F.lit(0))
    return parts.groupBy("query_id", key).agg(F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0))).alias("sim"))


def ranked(rows: DataFrame, by: str | Sequence[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))


def top(rows: DataFrame, by: str | Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    return ranked(rows, by, score, tie).where(F.col("rank") <= k)


def pooled(rows: DataFrame, *keys: str, how: str = "max") -> DataFrame:
    """Max or mean of sim by key, floored at 0."""
    f = F.max if how == "max" else F.avg
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.coalesce(f("sim"), F.lit(0.0))).alias("sim"))


def share_of(method: str, sim: Column, rank: Column, k: int = RRF_K, share: float = HYBRID_SHARE) -> Column:
    """What a place in a ranked list adds to a row's fused score. rrf: 1 / (k + rank); weighted: sim over it; hybrid: a share
    of sim beside it. An unknown method is rrf."""
    place = k + rank
    return {"weighted": sim / place, "hybrid": share * sim + (1 - share) / place}.get(method, 1 / place)


def fused(lists: DataFrame, *keys: str, method: str = "rrf", k: int = RRF_K, share: float = HYBRID_SHARE) -> DataFrame:
    """Sum of share_of() over ranked lists(keys, sim, rank)."""
    return lists.groupBy(*keys).agg(F.sum(share_of(method, F.col("sim"), F.col("rank"), k, share)).alias("score"))


def mean_of_two(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(a + b) / 2 by keys, 0 where one is missing."""
    both = a.select(*keys, F.col("sim").alias("sa")).join(b.select(*keys, F.col("sim").alias("sb")), list(keys), "full_outer")
    return both.select(*keys, ((F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0))) / 2).alias("mean_sim"))


def recommend(phrases: DataFrame, sentences: DataFrame, tag: str, key: str, threshold: float = 0.35, n: int = 5, methods: Sequence[str] = ("weighted",), mode: str = "concat") -> DataFrame:
    """tag, key, label, score, mean_sim: for each tag (all tags in one job) its two similarity lists (tag, key, sim), floored
    at 0 and ranked, are fused by each method; mean similarity at least the threshold; the best n."""
    def listed(x):
        return ranked(x.select(tag, key, F.greatest(F.lit(0.0), F.col("sim")).alias("sim")), tag, "sim", key)

    both = listed(phrases).unionByName(listed(sentences))
    scores = [F.sum(share_of(m, F.col("sim"), F.col("rank"))).alias(f"score{i}") for i, m in enumerate(methods)]
    found = both.groupBy(tag, key).agg((F.sum("sim") / 2).alias("mean_sim"), *scores).where(F.col("mean_sim") >= threshold)
    return _labelled(top(_by_method(found, methods, tag, key, "mean_sim"), ["tag_method"], "score", key, n), tag, key, mode)


def _by_method(rows: DataFrame, methods: Sequence[str], tag: str, *columns: str) -> DataFrame:
    """A row for each method with its score, of rows with score0, score1, ...; tag_method tells a tag's methods apart."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"score{i}").alias("score")) for i, m in enumerate(methods)]))
    rows = rows.select(tag, *columns, each.alias("x")).select(tag, *columns, "x.method", "x.score")
    return rows.withColumn("tag_method", F.struct(F.col(tag), F.col("method")))


def _labelled(rows: DataFrame, tag: str, key: str, mode: str) -> DataFrame:
    return rows.select(tag, key, F.concat(F.lit(f"[mode:{mode}][fuse:"), "method", F.lit("]")).alias("label"), "score", "mean_sim")


def recommend_nearest(tags: DataFrame, events: DataFrame, threshold: float = 0.35, n: int = 5, methods: Sequence[str] = ("weighted",), mode: str = "concat", depth: int | None = None) -> DataFrame:
    """recommend() of tags(tag, qa, qb) and events(id, va, vb), whose lists are cosines of qa with va and of qb (with vb, or va
    where there is no vb). A task ranks both lists of each of its tags in full and gives out the n best of each method, so no
    pair leaves it. depth: lists aren't read to a depth any more; it has no effect. Null vectors take no part."""
    known = [x for x in ("va", "vb") if x in events.columns]
    kinds = f"tag {tags.schema['tag'].dataType.simpleString()}, id {events.schema['id'].dataType.simpleString()}, method string, score double, mean_sim double"

    def begin(asked: pa.Table):
        lists, ids, sims = [_Asked(asked[q]) for q in ("q0", "q1")], [], ([], [])

        def add(b: pa.RecordBatch):
            ids.append(b["id"])
            for x, own, v in zip(sims, lists, ("v0", f"v{len(known) - 1}"), strict=True):
                x.append(own.similar(b[v]))
            return ()

        def end():
            every, wide = pa.chunked_array(ids).combine_chunks(), sum(map(len, ids))
            for i in range(asked.num_rows):
                both, ranks = [], []
                for x in sims:
                    sim = np.concatenate([y[i] for y in x])
                    both.append(np.where(sim < 0, 0.0, sim))
                    ranks.append(np.empty(wide, np.int64))
                    ranks[-1][_order(both[-1])] = np.arange(1, wide + 1)
                mean = (both[0] + both[1]) / 2
                kept = np.flatnonzero(mean >= threshold)
                for m in methods:
                    score = np.zeros(len(kept))
                    for sim, rank in zip(both, ranks, strict=True):
                        sim, place = sim[kept], RRF_K + rank[kept]
                        score += {"weighted": sim / place, "hybrid": HYBRID_SHARE * sim + (1 - HYBRID_SHARE) / place}.get(m, 1 / place)
                    best = np.argsort(-score, kind="stable")[:n]
                    one = pa.array(np.full(len(best), i))
                    yield from _rows({"tag": asked["query_id"].combine_chunks().take(one), "id": every.take(pa.array(kept[best])), "method": pa.array([m] * len(best), pa.string()), "score": pa.array(score[best]), "mean_sim": pa.array(mean[kept[best]])})

        return add, end

    queries = tags.where("qa is not null and qb is not null").select(F.col("tag").alias("query_id"), F.col("qa").alias("q0"), F.col("qb").alias("q1"))
    corpus = events.select("id", *[F.col(x).alias(f"v{i}") for i, x in enumerate(known)])
    return _labelled(_streamed(queries, corpus, _groups(queries, corpus, 2), 1, begin, kinds), "tag", "id", mode)


def rerank(sentences: DataFrame, keywords: DataFrame, tag: str, key: str, k: int = RRF_K) -> DataFrame:
    """tag, key, score: reciprocal ranks of the best sentence similarity and of the mean keyword similarity of each event,
    summed; an event without sentences or keywords counts as 0 there. Rows: (tag, key, sim), sim null for none."""
    return rerank_pooled(pooled(sentences, tag, key), pooled(keywords, tag, key, how="mean"), tag, key, k)


def rerank_pooled(sentences: DataFrame, keywords: DataFrame, tag: str, key: str, k: int = RRF_K) -> DataFrame:
    """rerank() of similarities that are pooled already, one row for each (tag, key)."""
    return fused(ranked(sentences, tag, "sim", key).unionByName(ranked(keywords, tag, "sim", key)), tag, key, k=k)


def retrieve(rows: DataFrame, query: str, key: str, k: int = 50, least: float = 0.8, near: Column | None = None) -> DataFrame:
    """query, key, sim, rank: the k nearest of each query, then those of at least so much, then those near (a condition)."""
    return retrieved(top(rows, query, "sim", key, k), least, near)


def retrieved(nearest_rows: DataFrame, least: float = 0.8, near: Column | None = None) -> DataFrame:
    """Of a query's nearest (with sim), those of at least so much, then those near (a condition)."""
    found = nearest_rows.where(F.col("sim") >= least)
    return found if near is None else found.where(near)


def joined_keywords(words: Column) -> Column:
    """The text that an event's keywords are embedded as; null where it is blank."""
    text = F.trim(F.array_join(words, " "))
    return F.when(F.length(text) > 0, text)


def similarity_to(tag: Column, text: Column, embed: Callable[[Column], Column]) -> Column:
    """Cosine of two texts' embeddings, floored at 0; 0 where the text is blank."""
    sim = F.greatest(F.lit(0.0), cosine(embed(tag), embed(text)))
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, sim).otherwise(0.0)


def _embedded(words: str, embed: Callable[[Column], Column]) -> Column:
    whole = getattr(embed, "of_array", None)  # an embedding in Python can't stand within transform
    return whole(F.col(words)) if whole else F.transform(words, lambda w: embed(w))


def interest(events: DataFrame, key: str, words: str, tag: Column, embed: Callable[[Column], Column], mode: str = "concat", pool: str = "max") -> DataFrame:
    """key, sim of events(key, words: array): of the words as one text (concat; blank: 0), or pooled over the words
    (per_keyword; none: 0). legacy: as concat, but blank texts are embedded as well."""
    if mode == "legacy":
        return events.select(key, F.greatest(F.lit(0.0), cosine(embed(tag), embed(F.array_join(words, " ")))).alias("sim"))
    if mode == "concat":
        text = joined_keywords(F.col(words))
        return events.select(key, similarity_to(tag, text, embed).alias("sim"))
    events = events.select(key, embed(tag).alias("__t"), _embedded(words, embed).alias("__v"))
    sims = F.transform("__v", lambda v: cosine(F.col("__t"), v))
    best = F.array_max(sims) if pool == "max" else F.aggregate(sims, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(sims), F.lit(1))
    return events.select(key, F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0))).alias("sim"))


def interest_of_tags(tags: DataFrame, events: DataFrame, key: str, words: str, embed: Callable[[Column], Column], mode: str = "concat", pool: str = "max") -> DataFrame:
    """interest() for a set of tags at once: tag, key, sim. Every text is embedded once, before tags meet events."""
    asked = tags.select("tag").distinct().withColumn("__t", embed(F.col("tag")))
    if mode == "per_keyword":
        rows = events.select(key, _embedded(words, embed).alias("__v"))
    else:
        text = joined_keywords(F.col(words)) if mode == "concat" else F.array_join(words, " ")
        rows = events.select(key, F.when(text.isNotNull(), F.array(embed(text))).otherwise(F.array().cast("array<array<double>>")).alias("__v"))
    both = against(asked, rows, "tag")
    sims = F.transform("__v", lambda v: cosine(F.col("__t"), v))
    best = F.array_max(sims) if pool == "max" or mode != "per_keyword" else F.aggregate(sims, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(sims), F.lit(1))
    return both.select("tag", key, F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0))).alias("sim"))
