import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ternlens.llm import periodic_runs as runs
from ternlens.llm.fill_middle import FillMiddle, fill_digests, fill_middle, restored
from ternlens.llm.queries import op11_periodic_runs, op13_fill_middle

SMALL = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_runs(x):
    """Every period's stretches of equal words, the smallest period of a stretch first."""
    n, seen = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            lo = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i - lo + q >= max(24, 3 * q):
                seen.setdefault((lo, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in seen.items()), key=lambda t: (t[0], t[2]))


def brute_row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = brute_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    s, m, q = best or (None, None, None)
    return (i, len(found), s, m, q, 1000 * m // q if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_random_words_against_brute_force():
    rng = random.Random(7)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            n, letters = rng.choice([0, 1, 23, 24, 25, 48, 60, 130, 333]), rng.choice([1, 2, 3, 50])
            x = [rng.randrange(letters) for _ in range(n)]
            if n > 3 and rng.random() < .7:
                a = rng.randrange(n)
                p, e = 1 + rng.randrange(max(1, (n - a) // 2 + 1)), rng.randrange(a, n + 1)
                x[a:e] = [x[a + (i - a) % p] for i in range(a, e)]
            texts.append(np.array(x, np.int64))
        assert runs.text_runs(texts) == [brute_runs(list(t)) for t in texts]


@pytest.mark.parametrize("size", [2, 16, 64, 1 << 12])
def test_transform_is_exact(size):
    t, rng = runs.Transform(size), np.random.default_rng(1)
    x = rng.integers(0, t.p, (size, 3)).astype(np.uint64)
    again = t.run(t.run(x), back=True)
    assert (again == x * np.uint64(size) % np.uint64(t.p)).all()
    half = np.vstack([x[:size // 2], np.zeros((size // 2, 3), np.uint64)])
    assert (t.run(x[:size // 2], half=True) == t.run(half)).all()


def test_large_prime_serves_long_texts(monkeypatch):
    monkeypatch.setattr(runs, "PRIMES", (runs.PRIMES[1],))
    monkeypatch.setattr(runs, "_TRANSFORMS", {})
    x = np.array(list(range(40)) * 4 + [1, 2], np.int64)
    assert runs.text_runs([x]) == [[(0, 160, 40)]] == [brute_runs(list(x))]


def test_one_word_repeated_many_times():
    assert runs.text_runs([np.zeros(50_000, np.int64)]) == [[(0, 50_000, 1)]]


def test_periodic_runs_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {tuple(r) for r in op11_periodic_runs(spark, SMALL).collect()}
    texts = [(r.doc_id, r.text) for r in docs if len(r.text or "") < 9000]  # brute force is quadratic
    assert len(texts) > 150 and all(brute_row(i, t) in got for i, t in texts) and len(got) == len(docs)


def test_periodic_runs_of_odd_rows(spark, odd_docs, no_docs):
    frame = runs.run_digests(runs.periodic_runs(odd_docs, runs.planted))
    want = [brute_row(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))
    text = " ".join(["again and"] * 40)
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    (a, b) = runs.periodic_runs(docs).collect()
    assert a == b and [tuple(r) for r in a.runs] == [(0, 80, 2)] and a.collapsed == "again and"
    assert runs.run_digests(runs.periodic_runs(no_docs, runs.planted)).count() == 0


def brute_middle(i, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return i, len(lines), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 50 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return i, len(lines), form, len(pre), len(mid), sha(out), sha(text)


def test_fill_middle_against_brute_force(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op13_fill_middle(spark, SMALL).collect())
    assert got == sorted(brute_middle(r.doc_id, r.text) for r in docs)
    assert {r[2] for r in got} >= {"psm", "spm"}
    odd = sorted(map(repr, map(tuple, fill_digests(fill_middle(odd_docs)).collect())))
    assert odd == sorted(repr(brute_middle(r.doc_id, r.text)) for r in odd_docs.select("doc_id", "text").collect())
    assert fill_digests(fill_middle(no_docs)).count() == 0


def test_marks_and_awkward_ends_come_back(spark):
    texts = ["a\n<P>b", "<S", "\n\n\n", "<\n<S\n<M\n>P>\n", "S>\nP>\nM>\n<", "no end", "é\n😀\r\n日本\n"]
    rows = [(k, t) for k in range(40) for t in texts]
    out = fill_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    docs = {(r.doc_id, r.back): r.form for r in out.withColumn("back", restored(out["output"], out["form"])).collect()}
    assert set(docs) == set(rows)
    assert all((f == "plain") == (t == "a\n<P>b") for (_, t), f in docs.items())


def test_other_units_rates_and_marks(spark):
    words = FillMiddle(seed=1, rate=100, spm=0, unit=r"\S++\s*+|\s++", marks=("[p]", "[s]", "[m]"))
    n, form, a, m, out = words(5, "one two three")
    assert (n, form) == (3, "psm") and out.startswith("[p]") and len(out) == 9 + 13
    assert FillMiddle(rate=0)(5, "x")[1] == "plain"
    with pytest.raises(ValueError):
        FillMiddle(unit="a")(1, "b")
