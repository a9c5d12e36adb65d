import hashlib
import re
from collections import defaultdict

from ternlens.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, g in groups.items():
        best = min((x for x in g), key=lambda x: (-len(x[1]), x[0] if x[0] is not None else float("inf")))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, best, len(g), i is not None and i == best, sha) for i, _ in g]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in exact_dedup.exact_copies(df).collect()), key=repr)


def test_whole_table(small_docs):
    assert rows_of(small_docs) == brute([(r.doc_id, r.text) for r in small_docs.collect()])


def test_odd_rows(odd_docs):
    assert rows_of(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_hot_text_over_many_partitions(spark):
    rows = [(i, "a b" if i % 3 else f"text {i % 11}") for i in range(600)] + [(700, " a b "), (701, " a b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(df) == brute(rows)


def test_empty_table_and_pipeline_form(no_docs, odd_docs):
    assert rows_of(no_docs) == []
    kept = exact_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # texts 1 to 3 are equal without white space: the longest stays
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 8, 8, 9, 10, 11]


def test_no_python_in_the_plan(small_docs):
    plan = exact_dedup.exact_copies(small_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_runs_come_from_neighbours_compared_in_full(spark):
    """Different texts in one place of the range partitioning (as if their hashes were equal) are told apart by content."""
    rows = [(k, len(t), t, 0) for k, t in enumerate(["b", "a", "b", "ab", "a", "b", "aa"] * 3)]
    df = spark.createDataFrame(rows, "id long, n int, norm string, place int").repartition(4)
    out = exact_dedup._runs(df.repartitionByRange("place"), ["place"], "run").collect()
    runs = defaultdict(set)
    for r in out:
        runs[r.run].add(r.norm)
    assert sorted(map(sorted, runs.values())) == [["a"], ["aa"], ["ab"], ["b"]]
    assert sorted(r.id for r in out if r.new) == [0, 1, 3, 6]  # the head of each run: longest, smallest identifier


def test_salted_runs_are_joined(spark):
    rows = [(k, "x y" if k % 2 else "xy") for k in range(200)] + [(-2**63, "x  y "), (2**63 - 1, "x  y ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = exact_dedup.content_sort(df)
    heads = found.filter("new").collect()
    assert len(heads) == len({r.salt for r in heads}) > 20 and all(r.norm == "xy" for r in heads)
    assert rows_of(df) == brute(rows)
    ids = spark.createDataFrame([("b", "t"), ("a", "t")], "doc_id string, text string")
    assert {r.keep_id for r in exact_dedup.exact_copies(ids).collect()} == {"a"}
