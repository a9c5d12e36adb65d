"""Text functions: word count, sentiment, refusal detection, sentences, claims, formatting."""

from pyspark.sql import functions as F

from ternlens.functions import text as TX


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr).first()[0]


def test_word_count(spark):
    assert _one(spark, TX.word_count("x"), "one two three four five") == 5
    assert _one(spark, TX.word_count("x"), "") == 0
    assert _one(spark, TX.word_count("x"), "  \t\n ") == 0
    assert _one(spark, TX.word_count("x"), "a b\x1cc") == 3


def test_denial(spark):
    for text in ["I cannot provide medical advice.", "As an AI language model, I can't do that.",
                 "I'm unable to access the internet.", "Unfortunately, I can't help.",
                 "I do not have enough information to answer."]:
        assert _one(spark, TX.is_denial("x"), text) is True, text
    for text in ["Python was created by Guido van Rossum in 1991.", "", "Icannot parse this"]:
        assert _one(spark, TX.is_denial("x"), text) is False, text


def test_sentiment(spark):
    assert _one(spark, TX.lexicon_sentiment("x"), "") == 0.5
    assert _one(spark, TX.lexicon_sentiment("x"), "nothing here") == 0.5
    assert _one(spark, TX.lexicon_sentiment("x"), "Great great answer, very helpful") == 1.0
    assert _one(spark, TX.lexicon_sentiment("x"), "good but wrong and broken") == 0.5 + 0.5 * (1 - 2) / 3


def test_sentences(spark):
    got = _one(spark, TX.sentences("x", 15), "Short. This sentence is long enough!  And so is this one?? x")
    assert got == ["This sentence is long enough", "And so is this one"]


def test_flagged_claims(spark):
    df = spark.createDataFrame([("Guido van Rossum created Python in 1991 at CWI in Amsterdam. It is fine.",
                                 "Python is a programming language.")], "r string, c string")
    got = df.select(TX.flagged_claims("r", "c")).first()[0]
    assert got == ["Guido van Rossum created Python in 1991 at CWI in Amsterdam"]
    df2 = spark.createDataFrame([("Python was released in 1991 by Guido.", None)], "r string, c string")
    assert df2.select(TX.flagged_claims("r", "c")).first()[0] == []


def test_fixed_formatting_matches_python(spark):
    vals = [0.0625, 0.0025, 0.0015, 0.00125, 0.5, 0.123456, 1.0, 0.3000000000000000444]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got3 = [r[0] for r in df.select(TX.fixed("v", 3)).collect()]
    got4 = [r[0] for r in df.select(TX.fixed("v", 4)).collect()]
    assert got3 == [f"{v:.3f}" for v in vals]
    assert got4 == [f"{v:.4f}" for v in vals]


def test_judge_answer_parse(spark):
    df = spark.createDataFrame([(" 0.7 ",), ("1.5",), ("-2",), ("garbage",), (None,)], "x string")
    got = [r[0] for r in df.select(TX.parse_judge_answer("x")).collect()]
    assert got == [0.7, 1.0, 0.0, None, None]


def test_sanitize_app_name(spark):
    df = spark.createDataFrame([("my-app!!v2",), ("___",), ("a" * 100,)], "x string")
    got = [r[0] for r in df.select(TX.sanitize_app_name("x")).collect()]
    assert got == ["drift_my_app_v2", "drift_default", ("drift_" + "a" * 100)[:63]]
