import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import brute_classes, brute_removed
from ternlens.llm import components, near_dedup, queries, suffix_dedup

SMALL = "/root/testdata/sf0.001"


# ---- near copies

def classes(df):
    return {r.doc_id: r.class_id for r in near_dedup.near_copies(df).collect()}


def test_op2_classes(spark, small_docs):
    got = {r.doc_id: r.class_id for r in queries.op2_dart_minhash(spark, SMALL).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in small_docs.collect()])


def test_groups_of_near_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    passage = [word() for _ in range(60)]
    for g in range(4):
        base = [word() for _ in range(100 + 40 * g)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    # many texts with a common passage, too little to be near copies
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(40)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert classes(df) == want


def test_pairs_among_texts_of_one_template(spark, monkeypatch):
    for n, small in ((1200, {}), (300, {"BLOCK": 16, "COLUMNS": 64})):
        for k, v in small.items():
            monkeypatch.setattr(near_dedup, k, v)
        rng = random.Random(12)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
        template, rows = [word() for _ in range(173)], []
        for k in range(n):
            w = template + [word() for _ in range(25)]  # any two of these are at 0.77
            rows += [(k, " ".join(w))]
            if k % 4 == 0:  # at 0.82 with the one before, with the others below 0.77
                rows += [(5000 - k, " ".join(w[:-19] + [word() for _ in range(19)]))]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert classes(df) == {i: 5000 - i if i > n else i for i, _ in rows}


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = near_dedup.near_copies(odd_docs).collect()
    assert len(got) == len(rows)
    want = brute_classes([r for r in rows if r[0] is not None])
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert near_dedup.near_copies(no_docs).count() == 0
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for shared in (50, 80, 95):
        a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        n = 4000 * shared // 100
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 4000 - n, dtype=np.uint64)])
        s = near_dedup.signatures([np.sort(a), np.sort(b)])
        assert abs((s[0] == s[1]).mean() - n / (8000 - n)) < 0.11
    assert (near_dedup.signatures([np.zeros(0, np.uint64)]) == 0).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(60, 50), (50, 60)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 130)} | {50: 50, 60: 50}
    assert got == want
    more = components.merged(spark.createDataFrame(list(got.items()), "node long, label long"),
                             spark.createDataFrame([(129, 60), (7, 8), (200, 201)], "a long, b long"))
    assert {r.node: r.label for r in more.collect()} == want | {k: 50 for k in range(100, 130)} | {200: 200, 201: 200}


# ---- repeated strings

def check_removed(df, rows):
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, gone in zip(rows, texts, brute_removed(texts)):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.repeated_spans(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op7_rows(spark, small_docs):
    check_removed(small_docs, [(r.doc_id, r.text) for r in small_docs.collect()])


def planted():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    passage = text(420)
    rows = [(i, text(rng.randrange(500)) + (passage[rng.randrange(100):300 + rng.randrange(120)] if i % 2 else "") + text(rng.randrange(500))) for i in range(40)]
    rows += [(50, "ab" * 300), (51, "ab" * 99), (52, passage), (53, rows[4][1]), (54, rows[4][1] + "z"), (55, passage[:200]), (56, passage[:199])]
    return rows


@pytest.mark.parametrize("change", [{}, {"REGIONS": 2}, {"PIECE": 128}, {"SHARD": 1500}])
def test_planted_passages(spark, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_removed(df, rows)


def test_shards_merge_by_binary_search(monkeypatch):
    rng = np.random.default_rng(2)
    regions = [bytes(rng.integers(97, 100, 260, dtype=np.uint8)) for _ in range(30)]
    regions += [regions[k][10:250] + bytes(rng.integers(97, 100, 30, dtype=np.uint8)) for k in range(0, 30, 3)]
    whole = suffix_dedup.repeated([regions])[0]
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    assert suffix_dedup.repeated([regions])[0] == whole
    assert any(whole)


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    for b in (rng.integers(97, 99, 700, dtype=np.uint8), np.full(300, 97, np.uint8), rng.integers(0, 255, 50, dtype=np.uint8)):
        raw = b.tobytes()
        sa = suffix_dedup.suffix_array(b, suffix_dedup.words(b))
        want = sorted(range(len(raw)), key=lambda k: raw[k:])
        assert sa.tolist() == want


def test_odd_texts(odd_docs, no_docs):
    check_removed(odd_docs.filter("doc_id IS NULL OR doc_id <> 10"),
                  [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 10])
    long = suffix_dedup.repeated_spans(odd_docs).filter("doc_id = 10").first()
    assert (long.n_bytes, long.n_removed, long.n_spans) == (70_004, 70_000, 1)
    assert suffix_dedup.repeated_spans(no_docs).count() == 0
    out = suffix_dedup.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert {r.text for r in out.collect() if r.doc_id == 10} == {" end"}


def test_one_anchor_over_many_shards(spark, monkeypatch):
    """Shards of two regions: what repeats is found by merging shards in pairs."""
    monkeypatch.setattr(suffix_dedup, "REGIONS", 2)
    rng = random.Random(2)
    common = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(90)) + common + "".join(rng.choice("abcdefgh ") for _ in range(90))) for k in range(23)]
    rows += [(100, common[30:] + "x" * 300), (101, "y" * 150 + common[:205])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute_removed([t.encode() for _, t in rows])
    assert got == {i: (int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum())) for (i, _), g in zip(rows, gone)}


def test_clashing_names_in_the_pipeline_form(spark):
    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(400))
    names = ("k1", "k2", "kept", "row", "__k1", "__k2", "__kept", "__1", "__2", "marks", "starts")
    df = spark.createDataFrame([(1, text, 400), (2, text + "z", 401), (3, "short", 5)], "doc_id long, text string, n_chars long")
    df = df.withColumns({c: F.lit(c) for c in names})
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars, r["__k1"], r.kept) for r in out.collect()) == [
        (1, "", 0, "__k1", "kept"), (2, "z", 1, "__k1", "kept"), (3, "short", 5, "__k1", "kept")]
