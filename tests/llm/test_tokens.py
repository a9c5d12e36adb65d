import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ternlens.llm import bpe_automaton, packing, queries, token_counts

PARTS = st.lists(st.sampled_from(["a", "the", "in", "ing", "er", " ", "  ", "\n", "\t", "　", "\x1c", "'re", "'l", "'ll", "é", "ß", "日", "1", "²",
                                  "!!", "...", "<|endoftext|>", "<|end", "x̂", "😀", "_", "Ġ", "aaaa"]), max_size=14).map("".join)
FEW = settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@FEW
@given(text=PARTS | st.text(alphabet="aeiosthrnl ", max_size=40))
def test_automaton_reads_what_the_library_reads(vocabulary, library, text):
    auto = bpe_automaton.automaton(vocabulary)
    sp = bpe_automaton.Splitter(auto.special, lambda w, s: [auto.special[w]] if s else auto.encode(w.encode()), lambda vs: sum(vs, []))
    ids = sum(sp.values(text), [])
    assert ids == ids_of(library, text)
    assert auto.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=PARTS)
def test_counts_of_every_prefix(vocabulary, library, text):
    counter = token_counts.PrefixCounter(bpe_automaton.automaton(vocabulary))
    want = [len(ids_of(library, text[:k])) for k in range(1, len(text) + 1)]
    assert counter.table(text) == want
    assert counter.count(text) == (want[-1] if want else 0)


def test_cut_keeps_the_first_tokens(vocabulary, library):
    counter = token_counts.PrefixCounter(bpe_automaton.automaton(vocabulary))
    text = "therein another thing, was not; it isn't ending"
    for budget in range(1, 12):
        at = counter.cut(text, budget)
        assert len(ids_of(library, text[:at])) <= budget + 1
        assert at == len(text) or counter.table(text)[at] > budget


def test_tables_are_emptied_in_generations(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "CACHE", 3)
    t = bpe_automaton._Table(str.upper)
    assert [t[c] for c in "abcdabcd" * 3] == list("ABCDABCD" * 3)
    assert len(t) <= 3 and len(t.old) <= 3


def test_op6_rows(spark, library, odd_docs, no_docs, vocabulary):
    for rows, out in (
            (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), queries.op6_bpe_automaton(spark, "/root/testdata/sf0.001")),
            (odd_docs, bpe_automaton.encoding_digests(odd_docs, vocabulary))):
        want = []
        for r in rows.collect():
            ids = ids_of(library, r.text)
            text = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert bpe_automaton.encoding_digests(no_docs, vocabulary).count() == 0
    full = {r.doc_id: r for r in bpe_automaton.encoded(odd_docs, vocabulary).collect()}
    assert full[11].ids == ids_of(library, full[11].decoded) and full[1].ids == []


def test_op5_rows(spark, library, odd_docs, no_docs, vocabulary):
    for rows, out in (
            (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), queries.op5_token_counts(spark, "/root/testdata/sf0.001")),
            (odd_docs, token_counts.token_counts(odd_docs, vocabulary))):
        want = [(r.doc_id, len((r.text or "").encode()), (n := len(ids_of(library, r.text))), n > 512) for r in rows.collect()]
        got = out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(no_docs, vocabulary).count() == 0


@FEW
@given(texts=st.lists(st.lists(PARTS, max_size=6).map(" ".join).filter(bool), max_size=6))
def test_texts_together_have_the_library_s_ids(vocabulary, library, texts):
    sp = packing.id_splitter(vocabulary)
    for some in (texts, texts[::-1] + texts):
        assert sp.blobs(some) == [np.array(ids_of(library, t), "<u4").tobytes() for t in some]


def test_forgotten_chunks_and_equal_hashes(vocabulary, library, small_docs, monkeypatch):
    texts = [r.text for r in small_docs.collect() if r.text][:300] + ["x" * 40 + " " + "y" * 31 + " " + "é" * 20, "a", " a", "a ", "one  two", "\u00a0 x"]
    want = [np.array(ids_of(library, t), "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "ROWS", 500)
    sp = packing.IdSplitter(vocabulary)
    for k in range(0, len(texts), 20):
        assert sp.blobs(texts[k:k + 20]) == want[k:k + 20]
    assert sp.blobs(texts) == want
    hashes = packing.word_hashes
    monkeypatch.setattr(packing, "word_hashes", lambda *a: hashes(*a) % np.uint64(97))
    sp = packing.IdSplitter(vocabulary)
    assert all(sp.blobs([t]) == [w] for t, w in zip(texts, want)) and sp.blobs(texts) == want


def check_packing(rows, out, library, capacity=1024):
    ids = defaultdict(list)
    for r in rows:
        ids[r.doc_id].append(ids_of(library, r.text) + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        want = Counter()
        for doc in ids[i]:
            first = len(doc) % capacity or capacity
            for k, (a, z) in enumerate([(0, first)] + [(x, x + capacity) for x in range(first, len(doc), capacity)]):
                want[k, a, z - a, zlib.crc32(np.array(doc[a:z], "<u4").tobytes())] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in parts) == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in out) / capacity


def test_op4_rows(spark, library, odd_docs, no_docs, vocabulary):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    n, least = check_packing(rows, queries.op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), library)
    assert n <= 1.1 * least + 1
    check_packing(odd_docs.collect(), packing.pack(odd_docs, vocabulary).collect(), library)
    assert packing.pack(no_docs, vocabulary).count() == 0


def test_sequences_carry_the_ids(library, odd_docs, vocabulary):
    out = packing.pack(odd_docs, vocabulary, with_ids=True)
    text = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    assert sorted(x for s in text.values() for x in s) == sorted(x for r in odd_docs.collect() for x in ids_of(library, r.text) + [2])


@FEW
@given(counts=st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(counts):
    used = Counter()
    for lengths, times in packing.plan(counts, 64):
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)


def test_exact_complements_fill_sequences():
    patterns = packing.plan({40: 5, 24: 5, 30: 4, 20: 4, 14: 4, 10: 3, 18: 9}, 64)
    assert sum(t for p, t in patterns if sum(p) == 64) == sum(t for _, t in patterns)
