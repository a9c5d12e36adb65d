import re

from brute import brute_classes, brute_removed

import corpus_pipeline
from ternlens.llm.common import staged

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, library):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    columns, frame = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = staged(stage(spark, frame, SMALL), name)
        assert frame.columns == columns
        got = sorted((r.doc_id, r.text) for r in frame.collect())
        if name == "language_id":
            assert got == sorted(rows)  # all of these are in a learned language
        elif name == "exact_dedup":
            best = {}
            for i, t in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
                best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
            rows = [r for r in rows if r[0] in best.values()]
            assert got == sorted(rows)
        elif name == "near_dedup":
            group = brute_classes(rows)
            rows = [r for r in rows if group[r[0]] == r[0]]
            assert got == sorted(rows)
        else:
            raw = [t.encode() for _, t in rows]
            rows = [(i, bytes(x for x, g in zip(t, gone) if not g).decode("utf-8", "ignore")) for (i, _), t, gone in zip(rows, raw, brute_removed(raw))]
            assert got == sorted(rows)
            assert all(r.n_chars == len(r.text) for r in frame.collect())
    out = corpus_pipeline.run(spark, SMALL).collect()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == want
