"""Learned text scorers trained and applied as Spark jobs.

T5 language: character-trigram naive Bayes. The profile is a partial/final
      aggregate of (language, trigram) counts over labelled documents; it is held by the
      tasks that score the texts, or joined with their trigrams if it is too large for that.
T4 toxicity: the strongest word of a text by the toxic share of the labelled documents that
      have it (words in hash buckets); or spark.ml ``RegexTokenizer → HashingTF →
      LogisticRegression``, whose score is the positive-class probability.
T3 weighted sentiment: token valences from a map literal, summed,
      normalised with s/√(s²+15) and mapped to [0, 1] as (x+1)/2; no hit → 0.5.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions.vectors import slices
from ternlens.session import stage


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ T5 language
def normalized_for_grams(text) -> Column:
    """lower-case, every run of non-letters → one space, padded with spaces."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(_c(text), r"[^\p{L}]+", " ")), F.lit(" "))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _normalized(text: str) -> str:
    """``normalized_for_grams`` of a text inside a task."""
    c = _code_points(text)
    letter = _letters()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    return " " + np.where(letter, c, np.uint32(32))[keep].tobytes().decode("utf-32-le", "surrogatepass").lower() + " "


def _gram_codes(text: str) -> np.ndarray:
    """Every trigram of a text as one integer: three code points of 21 bits."""
    c = _code_points(text).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:] if len(c) > 2 else c[:0]


def _gram_text(codes: np.ndarray) -> list[str]:
    mask = (1 << 21) - 1
    return [chr(c >> 42) + chr((c >> 21) & mask) + chr(c & mask) for c in codes.tolist()]


def gram_counts(df: DataFrame, key: str, text: str = "text", per_row: bool = True) -> DataFrame:
    """(key, gram, n): how often each trigram occurs in the normalised text, by row or, with
    ``per_row=False``, by key in parts (partial counts, to be summed).

    Counted where the text is read, so only distinct trigrams leave the task.
    """
    kind = df.schema[key].dataType.simpleString()
    held_codes = 1 << 20   # trigrams that a part holds before it is counted

    def run(batches):
        def counted(key_type, parts):
            keys, grams, n = [], [], []
            for k, codes in parts:
                seen, times = np.unique(codes, return_counts=True)
                keys += [k] * len(seen)
                grams += _gram_text(seen)
                n.append(times)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(grams, pa.string()),
                                               pa.array(np.concatenate(n) if n else [], pa.int64())],
                                              names=["key", "gram", "n"])

        for b in batches:
            held, size = {}, 0
            rows = (x for part in slices(*b.columns) for x in zip(*part))
            for row, (k, t) in enumerate(rows):
                codes = _gram_codes("" if t is None else _normalized(t))
                held.setdefault((row, k) if per_row else k, []).append(codes)
                size += len(codes)
                if size >= held_codes:
                    yield counted(b.column(0).type, [(k[1] if per_row else k, np.concatenate(c)) for k, c in held.items()])
                    held, size = {}, 0
            yield counted(b.column(0).type, [(k[1] if per_row else k, np.concatenate(c)) for k, c in held.items()])

    return (df.select(F.col(key), _c(text))
            .mapInArrow(run, f"key {kind}, gram string, n long"))


def train_language_profile(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """Profile rows (lang, gram, log_count = ln(n+1)) with the language's ``unseen``
    = −ln(total + vocabulary) and ``log_prior``. Add-one smoothing, so
    log P(gram | lang) = log_count + unseen.  The counts are staged once (an eager job): three steps read them."""
    counts = stage(gram_counts(docs, label, text, per_row=False).withColumnRenamed("key", "lang")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    vocab = counts.select("gram").distinct().agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    prior = (docs.groupBy(F.col(label).alias("lang")).agg(F.count(F.lit(1)).alias("docs"))
             .withColumn("_one", F.lit(1)))
    all_docs = docs.agg(F.count(F.lit(1)).alias("all_docs")).withColumn("_one", F.lit(1))
    lang_info = (totals.join(prior, "lang").join(all_docs, "_one")
                 .join(vocab.withColumn("_one", F.lit(1)), "_one")
                 .select("lang", F.log(F.col("docs") / F.col("all_docs")).alias("log_prior"),
                         (-F.log(F.col("total") + F.col("v"))).alias("unseen")))
    return (counts.join(lang_info, "lang")
            .select("lang", "gram", F.log(F.col("n") + 1).alias("log_count"), "unseen", "log_prior"))


def detect_language(df: DataFrame, profile: DataFrame, text: str = "text", id_col: str = "id",
                    out: str = "language_pred", keep: list[str] | None = None) -> DataFrame:
    """T5 scoring: argmax over languages of prior + Σ log P(gram | lang); blank texts and
    texts of fewer than ``MIN_LANGUAGE_TEXT_CHARS`` characters are ``DEFAULT_LANGUAGE``.

    score(lang) = log_prior + n·unseen + Σ_{grams seen for lang} ln(count+1).
    A text's trigrams are counted first, so only its distinct ones are joined with the
    profile, one row per trigram with its languages in an array; sums are combined before
    the shuffle by text.  Nothing is collected, and the join's strategy is the planner's
    (the profile's common trigrams are skewed keys only on the side AQE can split).
    """
    keep = list(keep or [])
    prof = profile.groupBy("gram").agg(F.collect_list(F.struct("lang", "log_count")).alias("_p"))  # a row per language
    info = profile.groupBy("lang").agg(F.first("unseen").alias("unseen"), F.first("log_prior").alias("log_prior"))
    trimmed = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    short = F.length(trimmed) < K.MIN_LANGUAGE_TEXT_CHARS
    counted = gram_counts(df.where(~short), id_col, text).withColumnRenamed("key", "_id")
    sums = (counted.join(prof, "gram").select("_id", "n", F.explode("_p").alias("_p"))
            .groupBy("_id", F.col("_p.lang").alias("lang")).agg(F.sum(F.col("n") * F.col("_p.log_count")).alias("_s")))
    seen = sums.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "_s"))).alias("_seen"))
    langs = info.agg(F.array_sort(F.collect_list(F.struct("lang", "unseen", "log_prior"))).alias("_langs"))  # the label set
    n = F.greatest(F.length(normalized_for_grams(F.coalesce(_c(text), F.lit("")))) - 2, F.lit(0))
    scored = (df.select(id_col, *keep, short.alias("_short"), n.alias("_n"))
              .join(seen, F.col(id_col) == F.col("_id"), "left").join(F.broadcast(langs)))
    score = F.transform("_langs", lambda l: F.struct(
        (l["log_prior"] + F.col("_n") * l["unseen"] + F.coalesce(F.col("_seen")[l["lang"]], F.lit(0.0))).alias("s"),
        l["lang"].alias("l")))
    return scored.select(id_col, *keep, F.when(F.col("_short"), F.lit(K.DEFAULT_LANGUAGE))
                         .otherwise(F.array_max(score)["l"]).alias(out))


#: A profile of up to this many rows (about 100 MB) is held by every task; a larger one is joined.
PROFILE_ROWS_HELD = 2_000_000


def _language_udf(profile: pa.Table):
    """Narrow scorer: text → language, from the whole profile as sorted trigram codes and a weight per language."""
    p = profile.to_pandas()
    langs = sorted(p["lang"].unique(), reverse=True)     # ties: the greatest name
    firsts = p.drop_duplicates("lang").set_index("lang")
    base = np.array([firsts.loc[x, "log_prior"] for x in langs])
    unseen = np.array([firsts.loc[x, "unseen"] for x in langs])
    codes = np.array([_gram_codes(g)[0] for g in p["gram"]], np.int64)
    keys = np.unique(codes)
    weights = np.zeros((len(keys), len(langs)))
    weights[np.searchsorted(keys, codes), p["lang"].map({x: i for i, x in enumerate(langs)})] = p["log_count"]

    def language(t: str | None) -> str | None:
        if t is None or not langs:
            return None
        c = _gram_codes(_normalized(t))
        at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
        score = base + len(c) * unseen + weights[at[keys[at] == c]].sum(axis=0)
        return langs[int(np.argmax(score))]

    @F.arrow_udf("string")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for (texts,) in slices(b):
                yield pa.array(map(language, texts), pa.string())

    return predict


def with_language(df: DataFrame, profile: DataFrame, text: str = "text", out: str = "language_pred",
                  rows_held: int = PROFILE_ROWS_HELD) -> DataFrame:
    """T5 for any table: every input row once, with its language in ``out`` (``detect_language`` has the rule).

    At most ``rows_held`` + 1 rows of the profile are fetched (an eager job).  A profile of up to ``rows_held`` rows is held by
    each task, which scores the texts where they are read, without a shuffle.  Beyond, the texts' trigrams are joined
    with it, by a number given to each row of the staged input.
    """
    short = F.length(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)^\s+|\s+$", "")) < K.MIN_LANGUAGE_TEXT_CHARS
    held = profile.limit(rows_held + 1).toArrow()
    if held.num_rows <= rows_held:
        predict = _language_udf(held)
        return df.withColumn(out, F.when(short, F.lit(K.DEFAULT_LANGUAGE)).otherwise(predict(_c(text))))
    profile = stage(profile, "language-profile")
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "language-input")
    found = detect_language(rows, profile, text, "_row", out)
    return rows.drop(out).join(found, "_row").drop("_row")


# ------------------------------------------------------------------ T4 toxicity
def train_toxicity_model(docs: DataFrame, labels: DataFrame, text: str = "text", num_features: int = 1 << 16):
    """Fit tokenizer → hashed TF → logistic regression on labelled documents."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    train = docs.join(labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern="[^a-z0-9]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        LogisticRegression(featuresCol="_tf", labelCol="label", maxIter=20, regParam=0.01),
    ])
    return pipe.fit(train)


def toxicity_scores(model, df: DataFrame, text: str = "text", out: str = "toxicity_pred") -> DataFrame:
    """T4 scoring: positive-class probability; blank text → 0.0."""
    from pyspark.ml.functions import vector_to_array

    pred = model.transform(df.withColumn(text, F.coalesce(_c(text), F.lit(""))))
    p = vector_to_array("probability")[1]
    blank = F.regexp_replace(F.col(text), r"(?U)\s+", "") == ""
    return pred.withColumn(out, F.when(blank, F.lit(0.0)).otherwise(p)).drop("_tok", "_tf", "rawPrediction",
                                                                            "probability", "prediction")


#: Words are counted by hash bucket, which bounds the word model at any size of the corpus.
WORD_BUCKETS = 1 << 20
#: A word's toxic share counts together with so many documents of the overall share.
WORD_PRIOR_DOCS = 4
#: and is taken so many standard errors below its estimate, so that words of chance stay at 0.
WORD_ERRORS = 2.0
_WORDS = re.compile(r"[^\W_]+").findall


def train_toxic_words(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(bucket, weight): how far the toxic share of the labelled documents that have a word of the bucket lies above the
    overall share p, from 0 (p or below; such buckets are left out) to 1.  The share is shrunk towards p by
    ``WORD_PRIOR_DOCS`` and lowered by ``WORD_ERRORS`` of its standard errors.

    Documents meet their labels as sets of buckets (four bytes a different word), not as texts, in a sort-merge join at
    any size; the counts are combined before the shuffle by bucket.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    bucket = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % WORD_BUCKETS).cast("int")
    marks = labels.select(key, F.col("toxic").cast("double").alias("toxic"))
    train = docs.select(key, F.array_distinct(F.transform(words, bucket)).alias("_buckets")).join(marks.hint("merge"), key)
    by_word = (train.select("toxic", F.explode("_buckets").alias("bucket"))
               .groupBy(F.col("bucket").cast("long").alias("bucket"))
               .agg(F.sum("toxic").alias("_t"), F.count(F.lit(1)).alias("_n")))
    share = docs.select(key).join(marks, key).agg(F.avg("toxic").alias("_p"))        # one row
    p = F.col("_p")
    n, s = F.col("_n") + WORD_PRIOR_DOCS, F.col("_share")
    weight = (s - WORD_ERRORS * F.sqrt(s * (1 - s) / n) - p) / (1 - p)
    return (by_word.join(F.broadcast(share)).where(p < 1)
            .withColumn("_share", (F.col("_t") + WORD_PRIOR_DOCS * p) / n)
            .select("bucket", weight.alias("weight")).where(F.col("weight") > 0))


def with_toxicity(df: DataFrame, words: DataFrame, text: str = "text", out: str = "toxicity_pred") -> DataFrame:
    """T4: the greatest weight of a text's words (4 decimals), 0.0 if it has none: one strong word marks a text, however long.

    The model has at most ``WORD_BUCKETS`` rows, which each task holds (training it is an eager job); the input isn't shuffled.
    """
    model = words.toArrow().to_pandas().sort_values("bucket")
    buckets, weights = model["bucket"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = np.zeros(WORD_BUCKETS)
        held[buckets] = weights
        cache: dict = {}

        def weight(word: str) -> float:
            w = cache.get(word)
            if w is None:
                w = float(held[int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % WORD_BUCKETS])
                if len(cache) < 200_000:
                    cache[word] = w
            return w

        for b in batches:
            for (texts,) in slices(b):
                yield pa.array([max(map(weight, set(_WORDS(t))), default=0.0) if t else 0.0 for t in texts], pa.float64())

    return df.withColumn(out, F.bround(score(F.lower(F.coalesce(_c(text), F.lit("")))), K.SCORE_DECIMALS))


# ------------------------------------------------------------------ T3 weighted sentiment
VADER_ALPHA = 15.0


def default_valence() -> dict[str, float]:
    """Valence of each word of the fixed positive/negative lists (±2.0)."""
    return dict.fromkeys(K.POSITIVE_WORDS, 2.0) | dict.fromkeys(K.NEGATIVE_WORDS, -2.0)


def weighted_sentiment(df: DataFrame, valence: dict[str, float], text: str = "text",
                       out: str = "sentiment_weighted") -> DataFrame:
    """Σ valence of tokens (with repeats) → s/√(s²+α) → (x+1)/2; no hit or blank → 0.5.

    The lexicon is a map literal looked up inside generated code: no join, no shuffle.
    """
    lex = F.create_map(*[x for w, v in valence.items() for x in (F.lit(w), F.lit(float(v)))])
    tokens = F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9']+"),
                      lambda t: t.isin(*valence))
    s = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + lex[t])
    return df.withColumn("_s", s).withColumn(
        out, F.when(F.col("_s") == 0, F.lit(0.5)).otherwise(
            (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(VADER_ALPHA)) + F.lit(1.0)) / F.lit(2.0))).drop("_s")
