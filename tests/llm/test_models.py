import math
import zlib

import numpy as np
import pandas as pd
import pytest

from ternlens.llm import langid, quality, queries, toxicity

MEDIUM = "/root/testdata/sf0.01"


# ---- languages

def brute_models(texts, order=langid.ORDER):
    """Interpolated Kneser-Ney probabilities by the textbook's formulas, with dictionaries."""
    from collections import Counter, defaultdict
    top = Counter()
    for t in texts:
        s = clean(t)
        for k in range(order - 1, len(s)):
            top[s[k - order + 1:k + 1]] += 1
    levels = {order: top}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    totals, types, discount = {}, {}, {}
    for m, c in levels.items():
        totals[m], types[m] = defaultdict(int), defaultdict(int)
        for g, n in c.items():
            totals[m][g[:-1]] += n
            types[m][g[:-1]] += 1
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        discount[m] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        m, ctx = len(g), g[:-1]
        if not totals[m].get(ctx):
            return p(g[1:])
        d, n = discount[m], totals[m][ctx]
        return max(levels[m].get(g, 0) - d, 0) / n + d * types[m][ctx] / n * p(g[1:])
    return p


def all_levels(counts):
    """Rows of all orders and the discounts, from counts (lang, gram, n) of the highest."""
    rows, discounts = [counts.assign(order=langid.ORDER)], {}
    for order in range(langid.ORDER - 1, 0, -1):
        short = rows[-1].assign(gram=(rows[-1]["gram"].to_numpy(np.int64).view(np.uint64) & np.uint64((1 << 16 * order) - 1)).view(np.int64))
        rows.append(short.groupby(["lang", "gram"]).size().reset_index(name="n").assign(order=order))
    table = pd.concat(rows)
    for (lang, order), g in table.groupby(["lang", "order"]):
        discounts[lang, order] = langid.discount((g["n"] == 1).sum(), (g["n"] == 2).sum())
    return table, discounts


def clean(text):
    out = "\x01" * (langid.ORDER - 1)
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out += c
    return out


def test_cross_entropies_are_the_textbooks():
    train = {"a": ["the cat sat on the mat", "a cat and the rat"], "b": ["der hund und die katze", "das dach der stadt"]}
    rows = []
    for lang, texts in train.items():
        flat, _ = langid.symbols(texts)
        keys, n = np.unique(langid.packed(flat, langid.ORDER)[flat != langid.START], return_counts=True)
        rows.append(pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n}))
    models = langid.CharacterModels(*all_levels(pd.concat(rows)))
    texts = ["the hat", "die stadt", "xyz ÿ", "th", "cat  mat!"]
    h, n = models.entropies(texts)
    for k, lang in enumerate(models.langs):
        p = brute_models(train[lang])
        for i, t in enumerate(texts):
            s = clean(t)
            logs = [math.log(p(s[j - langid.ORDER + 1:j + 1])) for j in range(langid.ORDER - 1, len(s))]
            assert n[i] == len(logs)
            assert h[i, k] == pytest.approx(-sum(logs) / len(logs), rel=1e-5)


def test_training_keeps_every_gram(spark, small_docs):
    """Counts of all orders and discounts of ``train`` against plain counts of the training texts."""
    from collections import Counter
    rows = [(r.lang, r.text) for r in small_docs.limit(60).collect()]
    trained = langid.train(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    top = Counter()
    for lang, t in rows:
        s = clean(t)
        top.update((lang, s[k - langid.ORDER + 1:k + 1]) for k in range(langid.ORDER - 1, len(s)))
    got = {}
    for r in trained.grams.collect():
        g = "".join(chr((r.gram & (1 << 64) - 1) >> 16 * k & 0xFFFF) for k in range(r.order - 1, -1, -1))
        got.setdefault(r.order, {})[r.lang, g] = r.n
    for order in range(langid.ORDER, 0, -1):
        assert got[order] == top
        ones, twos = Counter(), Counter()
        for (lang, _), n in top.items():
            ones[lang] += n == 1
            twos[lang] += n == 2
        assert all(trained.discounts[lang, order] == langid.discount(ones[lang], twos[lang]) for lang in trained.langs)
        top = Counter((lang, g[1:]) for lang, g in top)
    assert any(n == 1 for n in got[langid.ORDER].values()) and trained.shards == 1


def test_shards_of_the_model_give_the_same_rows(spark, small_docs, monkeypatch):
    whole = sorted(map(tuple, langid.languages(small_docs).collect()))
    monkeypatch.setattr(langid, "SHARD_GRAMS", 9_000)
    sharded = sorted(map(tuple, langid.languages(small_docs).collect()))
    assert [r[:3] + r[5:] for r in sharded] == [r[:3] + r[5:] for r in whole]
    assert np.allclose([r[4] for r in sharded], [r[4] for r in whole], rtol=1e-6)


def test_slices_do_not_change_the_result(monkeypatch):
    texts = ["the cat sat on the mat " * 9, "", "a", "rat and cat " * 7]
    flat, _ = langid.symbols(texts)
    keys, n = np.unique(langid.packed(flat, langid.ORDER)[flat != langid.START], return_counts=True)
    models = langid.CharacterModels(*all_levels(pd.DataFrame({"lang": "a", "gram": keys.view(np.int64), "n": n})))
    whole = models.entropies(texts)
    monkeypatch.setattr(langid, "SLICE", 13)
    part = models.entropies(texts)
    assert np.allclose(whole[0], part[0]) and (whole[1] == part[1]).all()


def test_op3_held_out(spark):
    got = queries.op3_language_models(spark, MEDIUM).toPandas()
    lang = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").toPandas()
    got = got.merge(lang, on="doc_id")
    assert len(got) == len(lang)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() >= 0.98
    assert got.score.between(0, 1).all() and got.accepted.mean() >= 0.99


def test_languages_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in langid.languages(odd_docs).collect()}
    for i in (1, 2, 3, 4):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[10].lang_pred in ("en", "de") and 0 <= got[10].score <= 1
    assert langid.languages(no_docs).count() == 0
    assert langid.keep_identified(odd_docs).columns == odd_docs.columns


def test_foreign_text_is_rejected(spark):
    docs = [(i, ("the cat and the rat sat on the mat near the barn " * 3)[i % 7:], "en") for i in range(60)]
    docs += [(100, "жшщ " * 40, None), (101, "the rat sat near the cat " * 4, None)]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not got[100].accepted and got[101].accepted and got[101].lang_pred == "en"


# ---- toxicity

def state_after(words):
    s, matches = 0, []
    for c in words:
        s, m = toxicity.TABLE[s][c]
        matches.append(m)
    return matches


def test_composed_grammar():
    t = toxicity
    assert state_after([t.INSULT]) == [0]
    assert state_after([t.TARGET, t.OTHER, t.INSULT])[-1] == 4
    assert state_after([t.NEGATOR, t.INSULT])[-1] == 2
    assert state_after([t.NEGATOR] + [t.OTHER] * t.SCOPE + [t.INSULT])[-1] == 0
    assert state_after([t.REPORTER] + [t.OTHER] * 9 + [t.INSULT])[-1] == 1
    assert state_after([t.REPORTER, t.TARGET, t.NEGATOR, t.THREAT])[-1] == 15
    assert t.matches("You fool. He said: fool! not a fool", {"fool": 2.0})[4] == 2.0


def accuracy(got, labels, col):
    m = got.merge(labels, on="doc_id")
    h = m[m.held_out]
    return (h.predicted == h[col]).mean(), len(h)


@pytest.mark.parametrize("query,col,folds,out,least", [
    (queries.op8_toxicity_grammar, "toxic", 5, 0, 0.93), (queries.op10_quality_discriminant, "quality", 3, 1, 0.93)])
def test_held_out(spark, query, col, folds, out, least):
    got = query(spark, MEDIUM).toPandas()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == out for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    right, n = accuracy(got, labels, col)
    assert n > 50 and right >= least


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_of_odd_rows(spark, score, odd_docs, no_docs):
    kind = "doc_id long, quality int, toxic int"
    for rows in ([], [(5, 1, 0), (6, 1, 0), (None, 1, 1), (7, None, None)], [(i, i % 2, i % 2) for i in range(1, 12)] * 2):
        got = score(odd_docs, spark.createDataFrame(rows, kind)).collect()
        assert len(got) == odd_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # null counts as empty
    assert score(no_docs, spark.createDataFrame([], kind)).count() == 0


# ---- quality

def test_discriminant_is_the_difference_of_gaussians():
    rng = np.random.default_rng(3)
    parts = {y: rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4)) + y for y in (0, 1)}
    model = quality.Discriminant({y: (len(x), x.sum(axis=0), x.T @ x) for y, x in parts.items()})
    cov = {y: np.cov(x.T, bias=True) for y, x in parts.items()}
    pooled = sum(0.5 * c for c in cov.values())
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(4)
    for y, x in parts.items():
        c = 0.9 * cov[y] + 0.1 * pooled + 1e-3 * np.eye(4)
        z = x[:5] - x.mean(axis=0)
        want = -0.5 * (np.einsum("nd,de,ne->n", z, np.linalg.inv(c), z) + np.log(np.linalg.det(c))) + np.log(0.5)
        assert np.allclose(model.log_density(x[:5], y), want)
