import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ternlens.llm import segment_join as sj
from ternlens.llm.bpe_automaton import _Table
from ternlens.llm.queries import op12_segment_join

SMALL = "/root/testdata/sf0.001"


def word_sets(rows):
    out = []
    for _, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[k:k + 4]) for k in range(max(len(w) - 3, 1))} if w else set())
    return out


def brute(rows, num=85, den=100):
    """(identifier, size, component) of every row, over all pairs that share a shingle."""
    sets, by_shingle = word_sets(rows), defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(k)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in {p for v in by_shingle.values() for p in combinations(v, 2)}:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def found(frame):
    return sorted((tuple(r)[:3] for r in frame.collect()), key=repr)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = sorted(brute(rows), key=repr)
    assert found(op12_segment_join(spark, SMALL)) == want
    assert len({c for _, _, c in want}) < len(rows)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words) + 1)
        words[k:k + rng.choice([0, 1])] = rng.choice([[], [f"new{rng.randrange(999)}"]])
    return words


def families(rng, sizes, copies, edits):
    rows = []
    for n in sizes:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(copies):
            rows.append((len(rows) + 1, " ".join(edited(rng, base, rng.randrange(edits + 1)))))
    return rows


@pytest.mark.parametrize("similarity", [(85, 100), (1, 2), (1, 1)])
def test_edited_families_against_brute_force(spark, similarity):
    rng = random.Random(3)
    rows = families(rng, [1, 2, 3, 4, 5, 6, 8, 9, 12, 15, 20, 30, 50, 80, 150, 300], 9, 3)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(sj.linked_components(docs, similarity)) == sorted(brute(rows, *similarity), key=repr)


def flagged(segments, x, cost):
    """Flags by key of the set ``x``."""
    keys, tags = segments.all_keys(x)
    keys = keys.view(np.int64).tolist()
    flags = segments.allocated(len(x), tags, np.array([cost(k) for k in keys]))
    out = {}
    for k, f in zip(keys, flags.tolist()):
        out[k] = out.get(k, 0) | f
    return out


def test_pairs_at_the_border_are_always_candidates():
    """Every similar pair meets as index and probe, whatever the costs say."""
    rng, segments = np.random.default_rng(5), sj.Segments()
    costs = random.Random(5)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = base
        h = segments.apart(len(base), len(base))
        gone = int(rng.integers(0, h + 1))
        other = np.unique(np.concatenate([np.delete(base, rng.choice(len(base), min(gone, len(base) - 1), replace=False)),
                                          rng.integers(0, 2**63, int(rng.integers(0, h - gone + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both < 85 * (len(base) + len(other) - both):
            continue
        small, large = sorted((base, other), key=len)
        r, s = (flagged(segments, x, lambda key: costs.choice([0, 1, 5, 1000])) for x in (small, large))
        probing = sj.PROBE | sj.PROBE_NEAR | sj.PROBE_DELETED
        meets = any((r[k] & sj.INDEX and s[k] & probing) or (r[k] & sj.INDEX_DELETED and s[k] & sj.PROBE_NEAR) for k in r.keys() & s.keys())
        if len(small) == len(large):  # of equal sizes either may be taken as the smaller
            meets &= any((s[k] & sj.INDEX and r[k] & probing) or (s[k] & sj.INDEX_DELETED and r[k] & sj.PROBE_NEAR) for k in r.keys() & s.keys())
        assert meets
        assert sj.sketch_distance(sj.sketch(small).tobytes(), sj.sketch(large).tobytes()) <= len(np.setxor1d(small, large))


def test_costs_decide_what_is_left_out():
    segments = sj.Segments()
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64))
    whole, deleted = segments.keys(s, sj._mix(s + sj._GOLD), segments.bands(len(s))[0])
    keys = whole.view(np.int64).tolist()
    spare = len(keys) - segments.apart(len(s), len(s)) - 1
    cost = dict.fromkeys(keys, 1) | dict.fromkeys(keys[-(spare + 1):], 10_000)
    flags = flagged(segments, s, lambda k: cost.get(k, 0))
    assert all(not flags[k] & sj.PROBE for k in keys[-(spare + 1):])  # one more than there is to spare ...
    assert flags[keys[0]] & sj.PROBE_NEAR  # ... paid for by a deletion neighbourhood


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Template mates below the threshold that hold similar pairs; blocks of three rows, all keys heavy."""
    for name, value in (("BLOCK", 3), ("SAMPLE", 1), ("HEAVY", 2), ("HEAVY_SHARE", 0.0)):
        monkeypatch.setattr(sj, name, value)
    rng = random.Random(11)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for _ in range(25):
        tail = [f"x{rng.randrange(10**6)}" for _ in range(18)]
        for _ in range(2):
            rows.append((len(rows) + 1, " ".join(template + edited(rng, tail, 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 20 <= len({c for _, _, c in want}) < 50
    assert found(sj.linked_components(docs)) == sorted(want, key=repr)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(sj.linked_components(odd_docs)) == sorted(brute(rows), key=repr)
    assert sj.linked_components(no_docs).count() == 0
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "A b\tc d  e"), (7, "other words than these are here"), (None, "alone in the world"), (9, "é É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(sj.linked_components(docs))
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 3, 7), (None, 1, None), (9, 1, 9)], key=repr)


def test_shingles_of_short_texts_differ_by_length():
    h = _Table(xxhash.xxh64_intdigest)
    assert len(sj.shingles("a b c", h)) == len(sj.shingles("a b c d", h)) == 1
    assert sj.shingles("a b c", h) != sj.shingles("a b c d", h)
    assert sj.shingles("A B", h) == sj.shingles("a b", h)


def test_words_of_many_texts_are_hashed_together(small_docs):
    h = _Table(xxhash.xxh64_intdigest)
    texts = [None, "", " \n", "a", "A b", " a\tB\x0bC ", "x\x1cy z\xa0w É é one two", *(f"{'w' * k} {'é' * k} a b" for k in range(1, 40)),
             *(r.text for r in small_docs.collect())]
    for some in (texts, texts[:7], texts[:1], []):
        sets = sj.shingle_sets(some)
        assert len(sets) == len(some)
        assert all(np.array_equal(s, sj.shingles(t, h)) for s, t in zip(sets, some))


def test_block_pairs_of_many_groups():
    """Of groups of all sizes, in any parts, the pairs that a look at each pair finds."""
    rng, segments = np.random.default_rng(3), sj.Segments()
    rows, want = [], set()
    for key in range(60):
        blocks = [(0, 0)] if key % 3 else [(0, 0), (0, 1), (1, 1)]
        base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        members = []
        for k in range(int(rng.integers(2, 12))):
            s = np.unique(np.concatenate([base[:int(rng.integers(36, 41))], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
            flags = int(rng.choice([sj.INDEX, sj.INDEX | sj.PROBE, sj.PROBE, sj.INDEX_DELETED, sj.PROBE_NEAR | sj.INDEX, sj.PROBE_DELETED]))
            members.append((int(rng.integers(-1 << 60, 1 << 60)), s, int(rng.integers(0, 5)), flags, k % 2 if len(blocks) > 1 else 0))
        tried = {m[0]: [o[0] for o in members if o[0] > m[0] and rng.random() < .2] or None for m in members}
        for x, y in blocks:
            rows += [{"key": key, "x": x, "y": y, "left": block == x, "node": node, "n": len(s), "label": label, "flags": flags,
                      "bits": sj.sketch(s).tobytes(), "tried": tried[node]} for node, s, label, flags, block in members if block in (x, y)]
        for (a, s, la, fa, _), (b, t, lb, fb, _) in combinations(sorted(members, key=lambda m: m[0]), 2):
            small, large = (fb, fa) if (len(s), a) > (len(t), b) else (fa, fb)
            meets = (small & sj.INDEX and large & (sj.PROBE | sj.PROBE_NEAR | sj.PROBE_DELETED)) or (small & sj.INDEX_DELETED and large & sj.PROBE_NEAR)
            if (la != lb and meets and min(len(s), len(t)) * 100 >= max(len(s), len(t)) * 85 and b not in (tried[a] or ())
                    and sj.sketch_distance(sj.sketch(s).tobytes(), sj.sketch(t).tobytes()) <= segments.apart(len(s), len(t))):
                want.add((a, b, la, lb, key))
    t = pa.Table.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("left", pa.bool_()),
                                                     ("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("flags", pa.int32()),
                                                     ("bits", pa.binary()), ("tried", pa.list_(pa.int64()))]))
    parts, rest = sj._ended(t, True)
    assert rest == len(t)
    got = {(r["a"], r["b"]) for e in parts for r in sj._block_pairs(t, e, segments, False).to_pylist()}
    assert got == {w[:2] for w in want} and len(got) > 50
    joins = {(r["a"], r["b"]) for e in parts for r in sj._block_pairs(t, e, segments, True).to_pylist()}
    assert joins < got
    parent = {}

    def top(x):
        while x in parent:
            x = parent[x]
        return x
    for a, b, la, lb, key in want:  # within a group, what all pairs would join is joined
        if (a, b) in joins and top((key, la)) != top((key, lb)):
            parent[top((key, la))] = top((key, lb))
    assert all(top((key, la)) == top((key, lb)) for _, _, la, lb, key in want if key % 3)
