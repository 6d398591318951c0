"""Questions are asked of every conversation."""

import duckdb

from eventloom.plans import ORACLE_SQL, QUERIES


def test_every_conversation_asks(spark, tmp_path):
    d = str(tmp_path)
    turns = [(c, t, "where is the python meetup" if t == 0 else " " if t == 1 else "rust meetup") for c in (1, 7, 19, 20, 40, 41) for t in range(3)] + [(3, 0, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{d}/conversations.parquet")
    texts = [(i, f"a {('python', 'rust', 'go')[i % 3]} meetup" if i else None) for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    got = [tuple(r) for r in QUERIES["recommend_by_question"](spark, d).select("user", "id", "score", "relevance", "matched").collect()]
    duck = duckdb.connect()
    for name in ("conversations", "documents"):
        duck.execute(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    assert sorted(got) == sorted(duck.sql(ORACLE_SQL["recommend_by_question"]).fetchall())
    assert {r[0] for r in got} == {f"{c}/{t}" for c in (1, 7, 19, 20, 40, 41) for t in (0, 2)}
