"""Keyword retrieval and distributed numbering against plain Python."""

import random

from pyspark.sql import functions as F

from ternlens.operators.retrieval import key_occurrences, keyword_retrieve
from ternlens.operators.sequence import numbered


def test_occurrences_equal_substring_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n?é😀") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", None, "a" * 300]
    keys = sorted({"".join(rng.choice("ab?é😀\n") for _ in range(rng.randrange(1, 9))) for _ in range(80)} | {"", "a" * 130})
    t = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    k = spark.createDataFrame([(x, i) for i, x in enumerate(keys)] + [(None, 999)], "key string, key_pos int")
    got = sorted({(r.id, r.key) for r in key_occurrences(t, "id", "t", k).collect()})
    assert got == sorted((i, x) for i, text in enumerate(texts) if text is not None for x in keys if x in text)


def test_first_key_wins_and_misses_get_the_default(spark):
    ev = spark.createDataFrame([("1", "Which TERN nests here?"), ("2", "nothing"), ("3", None)], "id string, query string")
    kb = spark.createDataFrame([("nests", 2, "B"), ("tern", 1, "A"), ("terns", 0, "C")], "key string, key_pos int, document string")
    got = {r.id: (r.retrieved, r.key_pos) for r in keyword_retrieve(ev, kb, "none").collect()}
    assert got == {"1": ("A", 1), "2": ("none", None), "3": ("none", None)}
    empty = keyword_retrieve(ev, kb.limit(0), "none").collect()
    assert [(r.retrieved, r.key_pos) for r in empty] == [("none", None)] * 3


def test_numbered_is_the_rank_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, n int").repartition(7)
    got = {r.id: r.place for r in numbered(df, [F.desc("n"), F.asc("id")], "place").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, 1)}
    assert numbered(df.limit(0), [F.asc("id")], "place").count() == 0
