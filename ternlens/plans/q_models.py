"""Queries for the learned scorers: T5 language, T4 toxicity (word model; spark.ml model rows-only), T3 sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternlens.operators import models as M
from ternlens.plans.catalog import r9, register
from ternlens.session import stage
from ternlens.sources.tables import table

def _grams_sql(src: str, cols: str, text: str) -> str:
    return f"""(SELECT {cols}, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram
  FROM (SELECT {cols}, ' ' || lower(regexp_replace({text}, '[^\\pL]+', ' ', 'g')) || ' ' AS t FROM {src}))"""


def _buckets_sql(text: str) -> str:
    return (f"list_distinct(list_transform(regexp_extract_all(lower({text}), '[\\pL\\pN]+'), "
            f"lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {M.WORD_BUCKETS}))")


_PROFILE = f"""cnt AS (SELECT lang, gram, count(*) AS n FROM {_grams_sql('documents', 'lang', 'text')} GROUP BY 1, 2),
voc AS (SELECT count(DISTINCT gram) AS v FROM cnt),
tot AS (SELECT lang, sum(n) AS total FROM cnt GROUP BY 1),
pri AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1),
info AS (SELECT t.lang, ln(p.docs / (SELECT count(*) FROM documents)) AS log_prior,
                -ln(t.total + voc.v) AS unseen FROM tot t JOIN pri p USING (lang), voc)"""

_TOXIC_WORDS = f"""toxdocs AS (SELECT text, toxic FROM documents JOIN labels USING (doc_id)),
toxshare AS (SELECT avg(toxic) AS p FROM toxdocs),
toxwords AS (
  SELECT b, (s - {M.WORD_ERRORS}::DOUBLE * sqrt(s * (1 - s) / n) - p) / (1 - p) AS w
  FROM (SELECT b, p, count(*) + {M.WORD_PRIOR_DOCS} AS n,
               (sum(toxic) + {M.WORD_PRIOR_DOCS} * p) / (count(*) + {M.WORD_PRIOR_DOCS}) AS s
        FROM (SELECT toxic, unnest({_buckets_sql('text')}) AS b FROM toxdocs), toxshare GROUP BY b, p))"""


def text_models_sql(src: str, ident: str, text: str) -> str:
    """CTEs ending in ``langs`` (id, lang) and ``tox`` (id, toxicity): T5 and T4 trained on documents, applied to a relation."""
    return f"""{_PROFILE},
lg AS {_grams_sql(f'(SELECT {ident} AS mid, {text} AS mtext FROM {src})', 'mid', 'mtext')},
lgn AS (SELECT mid, count(*) AS n FROM lg GROUP BY mid),
lgs AS (SELECT lg.mid, c.lang, sum(ln(c.n + 1)) AS s FROM lg JOIN cnt c USING (gram) GROUP BY 1, 2),
langs AS (SELECT mid, first(lang ORDER BY score DESC, lang DESC) AS lang
          FROM (SELECT t.mid, i.lang, i.log_prior + t.n * i.unseen + coalesce(s.s, 0.0) AS score
                FROM lgn t, info i LEFT JOIN lgs s ON s.mid = t.mid AND s.lang = i.lang) GROUP BY mid),
{_TOXIC_WORDS},
tox AS (SELECT mid, round_even(max(greatest(w, 0.0)), 4) AS toxicity
        FROM (SELECT {ident} AS mid, unnest({_buckets_sql(text)}) AS b FROM {src}) JOIN toxwords USING (b) GROUP BY mid)"""


def text_models(spark, sf):
    """Trains T5 and T4 on ``documents`` once (staged tables) and returns a function that adds their columns to a table."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    profile = stage(M.train_language_profile(docs), "language-profile")
    words = stage(M.train_toxic_words(docs, table(spark, sf, "labels")), "toxic-words")
    return lambda df, text="response": M.with_toxicity(M.with_language(df, profile, text, "_language"), words, text, "_toxicity")


def with_text_models(spark, sf, df, text: str = "response"):
    """``df`` with ``_language`` (T5) and ``_toxicity`` (T4) of a text column, both trained on ``documents``."""
    return text_models(spark, sf)(df, text)


def text_model_columns() -> dict:
    """The options by which ``evaluate`` takes the columns of ``with_text_models``."""
    return {"toxicity": F.col("_toxicity"), "language": F.col("_language")}


@register("language_detection", ops="T5 (trigram naive Bayes trained on every labelled document, applied to all)", sql=f"""
WITH {text_models_sql('documents', 'doc_id', 'text')}
SELECT d.doc_id, d.lang,
       CASE WHEN length(regexp_replace(coalesce(d.text, ''), '^\\s+|\\s+$', '', 'g')) < 10 THEN 'en' ELSE p.lang END AS language_pred
FROM documents d JOIN langs p ON p.mid = d.doc_id""")
def language_detection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return M.with_language(docs, M.train_language_profile(docs)).select("doc_id", "lang", "language_pred")


@register("toxic_word_scores", ops="T4 (strongest word of every document, shares learned from labels)", sql=f"""
WITH {text_models_sql('documents', 'doc_id', 'text')}
SELECT d.doc_id, coalesce(t.toxicity, 0.0) AS toxicity_score FROM documents d LEFT JOIN tox t ON t.mid = d.doc_id""")
def toxic_word_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    words = M.train_toxic_words(docs, table(spark, sf, "labels"))
    return M.with_toxicity(docs, words, out="toxicity_score").select("doc_id", "toxicity_score")


@register("toxicity_model_scores", ops="T4 (spark.ml logistic regression on labels)")
def toxicity_model_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels")
    model = M.train_toxicity_model(docs, labels)
    return M.toxicity_scores(model, docs).select("doc_id", r9("toxicity_pred").alias("toxicity_score"))


_POS = ", ".join(f"('{w}', 2.0)" for w in M.K.POSITIVE_WORDS)
_NEG = ", ".join(f"('{w}', -2.0)" for w in M.K.NEGATIVE_WORDS)


@register("weighted_sentiment", ops="T3 (valence lexicon, normalised sum)", sql=f"""
WITH lex AS (SELECT * FROM (VALUES {_POS}, {_NEG}) v(token, valence)),
toks AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9'']+')) AS token
         FROM conversations),
s AS (SELECT conv_id, turn, sum(valence) AS s FROM toks JOIN lex USING (token) GROUP BY 1, 2)
SELECT c.conv_id, c.turn, round(CASE WHEN s.s IS NULL OR s.s = 0 THEN 0.5
              ELSE (s.s / sqrt(s.s * s.s + 15.0) + 1.0) / 2.0 END, 9) AS sentiment_weighted
FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn""")
def weighted_sentiment(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    keyed = conv.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    out = M.weighted_sentiment(keyed, M.default_valence())
    return out.select("conv_id", "turn", r9("sentiment_weighted").alias("sentiment_weighted"))
