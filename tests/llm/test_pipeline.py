"""Each stage of the pipeline against brute force on its own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from eventloom.llm import common, pii

from .test_operators import brute_components, reference_spans, shingle_set, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, root string, keep int, similarity double, __found0 int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").where("false").write.parquet(f"{d}/labels.parquet")
    r = random.Random(1)
    spark.createDataFrame([(1, " ".join(words(r, 40))), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def rows(sf_dir):
    r = random.Random(7)
    item = words(random.Random(1), 40)
    base = [words(r, r.randint(6, 90)) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:8]:
        c = list(b)
        c[r.randrange(len(c))] = "changed"
        texts += [" ".join(c), " ".join(b)]
    texts += ["", None, " \n", " ".join([*words(r, 9), *item]), "mail jo@x.org or +1 234 567 8900 now"]
    ids = [*range(len(texts))]
    out = list(zip(ids, texts, strict=True))
    # one id with two texts, one of them a copy; null ids, one of them a copy; rows that repeat
    out += [(ids[-1] + 1, " ".join(words(r, 30))), (ids[-1] + 1, texts[3]), (None, texts[3]), (None, " ".join(words(r, 20))), (None, None), out[5], out[5], (None, "null id twice"), (None, "null id twice")]
    return [(i, t, "en", "s", None if t is None else len(t), "mine", 7, 0.25, 3) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_stages_keep_columns_and_take_empty_tables(spark, docs, sf_dir):
    for _, f in P.STAGES[:-1]:
        got = f(spark, docs, sf_dir)
        assert got.columns == docs.columns and [x.dataType for x in got.schema] == [x.dataType for x in docs.schema]
        assert got.agg(F.count_if(~((F.col("root") == "mine") & (F.col("keep") == 7) & (F.col("similarity") == 0.25) & (F.col("__found0") == 3)))).first()[0] == 0
        assert f(spark, docs.where("false"), sf_dir).count() == 0
    assert P.STAGES[-1][1](spark, docs.where("false"), sf_dir).count() == 0


def test_quality_stage_without_labels(spark, docs, rows, sf_dir):
    assert bag(P._quality(spark, docs, sf_dir).collect()) == bag(x for x in rows if x[1])


def test_distinct_stage(spark, docs, rows, sf_dir):
    texts = sorted({x[1] for x in rows if shingle_set(x[1], 5)})
    name = brute_components({i: shingle_set(t, 5) for i, t in enumerate(texts)}, 80)
    groups, want = collections.defaultdict(list), []
    for x in rows:
        if x[1] in texts:
            groups[name[texts.index(x[1])]].append(x)
        else:
            want.append(x)
    got = P._distinct(spark, docs, sf_dir).collect()
    kept = collections.defaultdict(list)
    for x in map(tuple, got):
        if x[1] in texts:
            kept[name[texts.index(x[1])]].append(x)
    assert bag(x for x in map(tuple, got) if x[1] not in texts) == bag(want)
    assert kept.keys() == groups.keys() and all(len(v) == 1 for v in kept.values())
    for g, own in groups.items():
        ids = [x[0] for x in own if x[0] is not None]
        assert kept[g][0][0] == (min(ids) if ids else None) and kept[g][0] in own


def test_distinct_stage_shuffles_no_text_that_is_alone(spark, docs, rows, sf_dir, monkeypatch):
    monkeypatch.setattr(P.common, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = P._distinct(spark, docs, sf_dir)
        plan = got._jdf.queryExecution().sparkPlan().toString().split("SortMergeJoin")
        assert len(plan) > 1 and all("__bits" in x for x in plan[1:])
        assert bag(map(tuple, got.collect())) == bag(map(tuple, P._distinct(spark, docs, sf_dir).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_likely_and_unlikely_share_out_the_rows(spark):
    df = spark.range(1000).selectExpr("id", "xxhash64(id) as h")
    wanted = df.where("id % 7 = 0")
    maybe, sure = (f(df, "h", wanted) for f in (P.common.likely, P.common.unlikely))
    assert sorted(r.id for r in maybe.unionByName(sure).collect()) == list(range(1000))
    assert not [r for r in sure.collect() if r.id % 7 == 0] and maybe.count() < 200


def test_decontamination_stage(spark, docs, rows, sf_dir):
    item = " ".join(words(random.Random(1), 40))
    assert bag(P._decontaminated(spark, docs, sf_dir).collect()) == bag(x for x in rows if not (x[1] and item in x[1]))


def test_pii_stage(spark, docs, rows, sf_dir):
    got = P._private(spark, docs, sf_dir).collect()
    assert len(got) == len(rows) and bag((x[0],) for x in got) == bag((x[0],) for x in rows)
    terms = {x["doc_id"]: x["spans"] for x in pii.spans(docs.where("doc_id is not null")).collect()}
    by = {x[0]: x for x in got if x[0] is not None}
    for x in rows:
        if x[0] is None or x[1] is None:
            continue
        if not reference_spans(x[1]) and "term" not in terms[x[0]]:
            assert any(y[0] == x[0] and y[1] == x[1] and y[4] == len(x[1]) for y in got)
    mail = next(x[0] for x in rows if x[1] and "jo@x.org" in x[1])
    assert "jo@x.org" not in by[mail][1] and "[EMAIL]" in by[mail][1] and "[PHONE]" in by[mail][1] and by[mail][4] == len(by[mail][1])


def test_packing_stage(spark, docs, rows, sf_dir):
    got = P._packed(spark, docs, sf_dir).toPandas()
    assert int(got[got.start == 0].shape[0]) == len(rows)
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    for _, g in got.groupby("sequence_id"):
        assert (g.offset + g.length).max() == g.length.sum()


def test_run_is_its_stages(spark, docs, rows, sf_dir, monkeypatch):
    docs.drop("root", "keep", "similarity", "__found0").write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
    whole = P.run(spark, sf_dir)
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in P.STAGES:
        now = common.stored(f(spark, now, sf_dir))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, whole.select(cols).collect())) == sorted(map(str, now.select(cols).collect()))
