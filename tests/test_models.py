"""Learned text scorers (T4, T5) against plain Python, and in scored records."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.operators import models as M
from ternlens.plans import catalog

TRAIN = [("the cat and the dog are here", "en"), ("the house of the river", "en"), ("le chat et le chien sont ici", "fr"),
         ("la maison de la rivière", "fr"), ("der Hund und die Katze sind hier", "de"), ("", "de"), (None, "en")]
TEXTS = ["the dog of the house", "le chien de la maison", "die Katze und der Hund", "the dog of the house", "short", "", None,
         "1234567890 12", "😀 the river 😀 and the cat", "ab " * 5000]


def _norm(t):
    return " " + re.sub(r"[^\W\d_]+", lambda m: m.group(), re.sub(r"[\W\d_]+", " ", t)).lower() + " "


def _grams(t):
    n = _norm(t)
    return Counter(n[i:i + 3] for i in range(len(n) - 2))


def _train(spark):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(TRAIN)], "doc_id long, text string, lang string")


def _expected():
    counts = defaultdict(Counter)
    for t, lang in TRAIN:
        if t is not None:
            counts[lang] += _grams(t)
    v = len({g for c in counts.values() for g in c})
    prior = Counter(lang for _, lang in TRAIN)
    out = []
    for t in TEXTS:
        if len((t or "").strip()) < K.MIN_LANGUAGE_TEXT_CHARS:
            out.append("en")
            continue
        seen = _grams(t)
        score = {lang: math.log(prior[lang] / len(TRAIN)) + sum(
            k * (math.log(c[g] + 1) - math.log(sum(c.values()) + v)) for g, k in seen.items()) for lang, c in counts.items()}
        out.append(max(score, key=lambda x: (score[x], x)))
    return out


def test_language_held_and_joined_equal_python(spark):
    rows = spark.createDataFrame([(i % 3, t, "x") for i, t in enumerate(TEXTS)], "id long, text string, lang string")
    want = sorted(zip([i % 3 for i in range(len(TEXTS))], [str(t) for t in TEXTS], _expected()))
    for held in (M.PROFILE_ROWS_HELD, 0):
        got = M.with_language(rows, M.train_language_profile(_train(spark)), rows_held=held).collect()
        assert sorted((r.id, str(r.text), r.language_pred) for r in got) == want
        assert M.with_language(rows.limit(0), M.train_language_profile(_train(spark)), rows_held=held).count() == 0
    untrained = M.with_language(rows, M.train_language_profile(_train(spark).limit(0))).collect()
    assert {r.language_pred for r in untrained} == {None, "en"}


def test_gram_counts_equal_python(spark):
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(TEXTS)], "k long, text string")
    for per_row in (True, False):
        got = Counter()
        for r in M.gram_counts(df, "k", per_row=per_row).collect():
            got[r.key, r.gram] += r.n
        want = Counter()
        for i, t in enumerate(TEXTS):
            for g, n in (_grams(t) if t is not None else {}).items():
                want[i % 2, g] += n
        assert got == want


def test_toxic_words_equal_python(spark):
    texts = ["you awful fool", "awful day", "a fine day", "a day of Rain", "Fool! fool", "", None] * 9
    toxic = [1, 0, 0, 0, 1, 0, 0] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")

    def buckets(t):
        return {int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % M.WORD_BUCKETS for w in re.findall(r"[^\W_]+", (t or "").lower())}
    p = sum(toxic) / len(toxic)
    n, bad = Counter(), Counter()
    for t, y in zip(texts, toxic):
        for b in buckets(t):
            n[b] += 1
            bad[b] += y
    share = {b: (bad[b] + M.WORD_PRIOR_DOCS * p) / (n[b] + M.WORD_PRIOR_DOCS) for b in n}
    weight = {b: max(0.0, (s - M.WORD_ERRORS * math.sqrt(s * (1 - s) / (n[b] + M.WORD_PRIOR_DOCS)) - p) / (1 - p))
              for b, s in share.items()}
    assert max(weight.values()) > 0
    test = [*texts, "unseen words", "what a FOOL", "awful awful"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(test)], "id long, text string")
    got = {r.id: r.toxicity_pred for r in M.with_toxicity(rows, M.train_toxic_words(docs, labels)).collect()}
    assert got == {i: round(max((weight.get(b, 0.0) for b in buckets(t)), default=0.0), 4) for i, t in enumerate(test)}
    for none in (docs.limit(0), docs.where(F.col("doc_id") % 7 == 0)):   # no documents; toxic ones only
        got = M.with_toxicity(rows, M.train_toxic_words(none, labels)).agg(F.max("toxicity_pred")).first()[0]
        assert got == 0.0


def test_scored_records_show_languages_and_toxicity(spark):
    rec = catalog.queries()["chat_records_scored"](spark, "/root/testdata/sf0.01")
    r = rec.agg(F.countDistinct("language_detected").alias("languages"), F.count_if(F.col("toxicity_score") > 0).alias("toxic"),
                F.count_if(F.col("toxicity_score") == 0).alias("clean")).first()
    assert r.languages > 1 and 0 < r.toxic < r.clean, r


def test_profile_counts_the_texts_once_and_normalises_them_in_the_task(spark):
    texts = [None, "", " . ", "1Ünder_score a²ⅷ", "İstanbul ΣΑΣ", "日本 x̂ 😀a\tb", "aa AA"]
    docs = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    want = [r[0] for r in docs.select(M.normalized_for_grams("text")).collect()]
    assert [None if t is None else M._normalized(t) for t in texts] == want
    assert "MapInArrow" not in M.train_language_profile(docs)._jdf.queryExecution().executedPlan().toString()
