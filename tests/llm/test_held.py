"""What a worker holds for one operator: few rows, few strings, no other operator's tables; one pass over a text."""

import numpy as np
import pyarrow as pa

from ternlens.llm import common, langid, suffix_dedup
from ternlens.llm.token_counts import PrefixCounter


def test_strings_are_checked_some_at_a_time(monkeypatch):
    region = bytes(np.random.default_rng(1).integers(97, 123, 1000, dtype=np.uint8))
    want = suffix_dedup.Shard([region, region]).flag.tolist()
    most, strings = [], suffix_dedup.strings
    monkeypatch.setattr(suffix_dedup, "CHECKED", 64, raising=False)
    monkeypatch.setattr(suffix_dedup, "strings", lambda b, at: most.append(len(at)) or strings(b, at))
    assert suffix_dedup.Shard([region, region]).flag.tolist() == want and sum(want) == 2 * 801
    assert max(most) <= 64


def test_batches_are_taken_a_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    parts = list(common.sliced(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [1000, 1000, 500] and parts[2].column(0)[0].as_py() == 2000


def test_tables_of_other_operators_are_let_go():
    made = []

    @common.kept(maxsize=2)
    def table(path):
        made.append(path)
        return {}
    try:
        assert table("a") is table("a")
        common.let_go()
        table("a")
        assert made == ["a", "a"]
    finally:
        common._KEPT.pop()


def test_count_and_cut_come_from_one_pass():
    counter = object.__new__(PrefixCounter)
    passes = []

    class Words:
        def values(self, text):
            passes.append(text)
            return [tuple(range(1, len(w) + 1)) for w in text.split(" ")]
    counter.sp = Words()
    assert counter.measured("abc de f", 4) == (6, 4) and counter.measured("abc", 4) == (3, 3) and counter.measured("", 4) == (0, 0)
    assert passes == ["abc de f", "abc"]


def test_language_tasks_let_go_of_other_operators_tables_and_take_some_rows_at_a_time(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(langid, "let_go", lambda: calls.append("let go"))
    monkeypatch.setattr(langid, "HELD_CHARS", 40)
    monkeypatch.setattr(langid, "symbols", lambda texts, f=langid.symbols: calls.append(sum(map(len, texts))) or f(texts))
    runs = []
    monkeypatch.setattr(langid, "own", lambda docs, *cols: type("Rows", (), {"mapInArrow": lambda self, run, schema: runs.append(run) or docs})())
    monkeypatch.setattr(langid, "sliced", lambda batches, f=langid.sliced: f(batches, 2))
    docs = spark.createDataFrame([], "lang string, gram long, n long")
    langid.gram_counts(docs, "lang", "gram")
    texts = ["some text of words"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 20), pa.array(texts)], names=["lang", "text"])
    counts = sum(sum(b.column(2).to_pylist()) for b in runs[0](iter([batch])))
    assert calls[0] == "let go" and max(calls[1:]) < 100 and counts == sum(map(len, texts))
