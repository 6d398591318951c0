import numpy as np
from pyspark.sql import functions as F

from eventloom.functions import semantics as S
from eventloom.operators import classify, text


def test_page_rank_isolated_and_fixed_point():
    w = np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0]], float)
    s = text.page_rank(w)
    assert abs(s[2] - 0.15) < 1e-9 and abs(s[0] - s[1]) < 1e-9 and abs(s[0] - 1) < 1e-3


def test_keep_first_is_greedy(spark):
    df = spark.createDataFrame([(["abcdefghij", "abcdefghix", "zzzzzzzzzz", "abcdefghij"],), ([],)], "a array<string>")
    got = [r[0] for r in df.select(text.keep_first(F.col("a"), text.alike_by_edits(0.8))).collect()]
    assert got == [["abcdefghij", "zzzzzzzzzz"], []]


def test_semantics(spark):
    df = spark.createDataFrame([("　a b ", ""), (None, "x")], "a string, b string")
    rows = df.select(S.trimmed(F.col("a")), S.falsy_or(F.col("b"), F.lit("d")), S.has(F.col("a"), "A")).collect()
    assert [tuple(r) for r in rows] == [("a b", "d", True), (None, "x", False)]
    assert spark.range(1).select(S.half_up(F.lit(-2.5))).first()[0] == -2


def test_words_are_not_shuffled_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (1, "b")], "id int, t string")
    words = F.split("t", " ")
    for rows in (text.word_runs(docs, "id", words, 2), text.word_positions(docs, "id", words), text.forward_pairs(docs, "id", words)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan
    assert sorted(tuple(r) for r in text.word_runs(docs, "id", words, 1).collect()) == [(1, 1, "a", 0, 2), (1, 1, "b", 0, 2), (2, 1, "c", 0, 1)]


def test_words_of_a_rule_share_their_beginnings(spark):
    lists = [words for rules in (classify.PHRASE_RULES, classify.SENTENCE_RULES, classify.KEYWORD_RULES) for _, words in rules]
    lists += [["c++", "c#", "a.b", "[x", "-]", "^q", "a b", "\\d", "|"], ["é", "日本", "日"], ["x"]]
    every = sorted({w for words in lists for w in words})
    texts = [*every, *(w[1:] for w in every), *(w[:-1] for w in every), *(f"za {w}z" for w in every), "", "java", "日 本", "1行ず", "\n"]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string").coalesce(1)
    got = df.select("t", *[classify.matches_any(F.col("t"), words).alias(f"c{i}") for i, words in enumerate(lists)]).collect()
    for r in got:
        assert list(r[1:]) == [any(w in r["t"] for w in words) for words in lists], r["t"]
    assert classify.any_of(["java", "javascript", "jam"]) == r"(?=[\x{6a}-\x{6a}])ja(?:m|va)"


def test_white_space_before_a_line_separator_stays(spark):
    rows = ["\u3000 a b\u00a0 \x0b\ufeff\n", "a \u2028", "  ", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "a string").coalesce(1).select(S.trimmed(F.col("a"))).collect()]
    assert got == ["a b", "a \u2028", "", "", None]


def test_sentences_of_ten_characters_without_marks(spark):
    rows = ["a b-c, d e f g h i. abcdefghij! 「あいうえお」か きくけ。", "1234567890.123456789?  　abcde　fghi😀 . ", None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "a string").coalesce(1).select(text.sentences(F.col("a"))).collect()]
    assert got == [["abcdefghij!"], ["1234567890.", "abcde　fghi😀 ."], None, []]


def test_marks_are_those_of_the_regular_expression(spark):
    every = "".join(chr(c) for c in [*range(1, 0x300), *range(0x2000, 0x2070), *range(0x3000, 0x3020), *range(0xFF00, 0xFF60), 0x1F600])
    df = spark.createDataFrame([(every,)], "t string").coalesce(1)
    x = F.col("t")
    r = df.select(text.spaced(x), F.regexp_replace(x, r"[\p{Punct}。、！？「」『』（）]", " "), F.translate(x, text.MARKS + text.SPACES, ""), F.regexp_replace(x, r"[\p{Punct}\s。、！？「」『』（）]", "")).first()
    assert r[0] == r[1] != every and r[2] == r[3] != every
    plan = df.select(text.sentences(x).alias("s"), text.tokens(x).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1  # where sentences end
