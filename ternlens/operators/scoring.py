"""Scoring chain: event normalisation, per-call scorers, drift, health — ``evaluate``.

``evaluate`` is a chain of ``DataFrame -> DataFrame`` transforms. All per-row
scorers fuse into one stage after a single Arrow stage that embeds every text a
row needs (response, context, query, their 10 000-character cuts and up to ten
response sentences) in one pass, so no text is embedded twice and nothing is
shuffled until drift, which repartitions by app only.

Scorers (in the order they are applied): quality (T1, T2/T3, T4, T5, T6),
hallucination (M1, M2, T8), RAG (M3–M5), drift (W1); then clamp (P4), health (M8).
Score columns are disjoint, so running drift last (it is the only step that moves
rows) gives the same record as the original module order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternlens import constants as K
from ternlens.functions import scores as S
from ternlens.functions import text as TX
from ternlens.functions import vectors as V

_VEC = T.ArrayType(T.DoubleType())
EMB_STRUCT = T.StructType([
    T.StructField("v_r", _VEC), T.StructField("v_c", _VEC), T.StructField("v_q", _VEC),
    T.StructField("rag_q", _VEC), T.StructField("rag_c", _VEC), T.StructField("rag_r", _VEC),
    T.StructField("sent", T.ArrayType(_VEC)),
    T.StructField("errors", T.IntegerType()),
])


# ------------------------------------------------------------------ P1 / P2 / P3 / P4
def normalize_events(events: DataFrame, keep: list[str] | None = None,
                     max_chars: int | None = None, max_tags: int | None = None,
                     max_tag_chars: int | None = None) -> DataFrame:
    """Defaults; texts and tags are whole unless cut to ``max_chars`` and ``max_tags`` × ``max_tag_chars``.

    A missing id becomes md5 of (app, timestamp, query, response) so retries and
    re-runs produce the same key.
    """
    from ternlens.schemas import EVENT_SCHEMA
    missing = {f.name: F.lit(None).cast(f.dataType) for f in EVENT_SCHEMA.fields if f.name not in events.columns}
    if missing:
        events = events.withColumns(missing)
    def cut(text: Column, chars: int | None) -> Column:
        return text if chars is None else F.substring(text, 1, chars)
    tags = F.coalesce(F.col("tags").cast("array<string>"), F.array().cast("array<string>"))
    tags = tags if max_tags is None else F.slice(tags, 1, max_tags)
    ident = F.coalesce(F.col("id"), F.md5(F.concat_ws("\u0001", F.col("app_name"),
                                                       F.col("timestamp").cast("string"),
                                                       F.col("query"), F.col("response"))))
    return events.select(
        ident.alias("id"),
        F.coalesce(F.col("app_name"), F.lit(K.DEFAULT_APP)).alias("app_name"),
        F.coalesce(F.col("timestamp"), F.current_timestamp()).alias("timestamp"),
        cut(F.coalesce(F.col("query"), F.lit("")), max_chars).alias("query"),
        cut(F.col("context"), max_chars).alias("context"),
        cut(F.coalesce(F.col("response"), F.lit("")), max_chars).alias("response"),
        F.coalesce(F.col("model_name"), F.lit(K.DEFAULT_MODEL)).alias("model_name"),
        F.coalesce(F.col("latency_ms"), F.lit(0)).cast("int").alias("latency_ms"),
        (tags if max_tag_chars is None else F.transform(tags, lambda t: cut(t, max_tag_chars))).alias("tags"),
        *(keep or []),
    )


def event_to_record(events: DataFrame) -> DataFrame:
    """Event columns plus default scores; response_length = whitespace word count."""
    return events.select(
        "*",
        F.lit(0.0).alias("hallucination_score"), F.lit("none").alias("hallucination_method"),
        F.array().cast("array<string>").alias("flagged_claims"),
        F.array().cast("array<double>").alias("embedding_vector"),
        F.lit(None).cast("double").alias("drift_score"),
        F.lit(None).cast("double").alias("faithfulness_score"),
        F.lit(None).cast("double").alias("context_relevance"),
        F.lit(None).cast("double").alias("answer_relevancy"),
        F.lit(None).cast("double").alias("groundedness_score"),
        F.lit(0.5).alias("sentiment_score"), F.lit(0.0).alias("toxicity_score"),
        F.when(F.col("response").isNull() | (F.col("response") == ""), F.lit(0))
         .otherwise(F.size(TX.whitespace_tokens("response"))).cast("int").alias("response_length"),
        F.lit(K.DEFAULT_LANGUAGE).alias("language_detected"), F.lit(False).alias("is_denial"),
        F.lit(0).alias("health_score"),
    )


SCORE_COLUMNS = ["hallucination_score", "drift_score", "faithfulness_score", "context_relevance",
                 "answer_relevancy", "groundedness_score", "sentiment_score", "toxicity_score"]


def clamp_scores(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Clamp every score column to [0, 1] (null stays null)."""
    cols = columns or [c for c in SCORE_COLUMNS if c in records.columns]
    return records.select(*[S.clamp01(c).alias(c) if c in cols else F.col(c) for c in records.columns])


def validate_records(records: DataFrame) -> DataFrame:
    """``violations`` lists every broken field rule; empty means valid.

    Split with ``where(size(violations) = 0)`` (valid) and ``> 0`` (quarantine).
    Vectors and claims are truncated rather than rejected.
    """
    def out_of_unit(c):
        return F.when(F.col(c).isNotNull() & ((F.col(c) < 0) | (F.col(c) > 1)), F.lit(c + " out of [0, 1]"))
    checks = [
        F.when(F.length("app_name") > K.MAX_NAME_CHARS, F.lit("app_name longer than 256")),
        F.when(F.length("model_name") > K.MAX_NAME_CHARS, F.lit("model_name longer than 256")),
        F.when(F.col("latency_ms") < 0, F.lit("latency_ms negative")),
        F.when(F.col("response_length") < 0, F.lit("response_length negative")),
        *[out_of_unit(c) for c in SCORE_COLUMNS],
        F.when((F.col("health_score") < 0) | (F.col("health_score") > 100), F.lit("health_score out of [0, 100]")),
        F.when(F.length("language_detected") > K.MAX_LANGUAGE_CHARS, F.lit("language_detected longer than 10")),
    ]
    return records.withColumns({
        "violations": F.filter(F.array(*checks), lambda x: x.isNotNull()),
        "embedding_vector": F.slice("embedding_vector", 1, K.MAX_VECTOR_DIMS),
        "flagged_claims": F.transform(F.slice("flagged_claims", 1, K.MAX_CLAIMS),
                                      lambda c: F.substring(c, 1, K.MAX_CLAIM_CHARS)),
    })


# ------------------------------------------------------------------ shared embedding stage
#: Vectors of rows that the embedding stage holds before it hands them on.
HELD_VECTORS = 2048


def _embed_struct(dim: int, embedder=None, cut: int | None = None):
    """``embedder`` (U3): optional ``factory() -> fn(text) -> vector``; the factory runs
    once per task (load a model there), the function once per text."""
    from ternlens.functions.vectors import embed_text as _default

    @F.arrow_udf(EMB_STRUCT)
    def emb(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache: dict = {}
        if embedder is None:
            def embed_text(t):
                return _default(t, dim, cache)
        else:
            fn = embedder()

            def embed_text(t):
                v = fn(t or "")
                return None if v is None else np.asarray(v, np.float64)
        names = [f.name for f in EMB_STRUCT.fields]
        kinds = [V.VECTOR] * 6 + [V.VECTORS, pa.int32()]

        def one(qi, ci, ri, ragi, si):
            vr = embed_text(ri)
            vc = embed_text(ci) if ci else None
            vq = embed_text(qi) if qi else None
            if not ragi:
                return (vr, vc, vq, None, None, None, None, 0)
            qc, cc, rc = (qi or "")[:cut], (ci or "")[:cut], (ri or "")[:cut]
            return (vr, vc, vq, embed_text(qc),
                    embed_text(cc) if len(cc) < len(ci or "") or vc is None else vc,
                    embed_text(rc) if len(rc) < len(ri or "") else vr,
                    [embed_text(x) for x in (si if si is not None else [])], 0)

        def out(rows):
            return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        # a few rows at a time are Python objects and vectors, fewer if they have many sentences
        for b in batches:
            rows, held = [], 0
            for part in V.slices(*b):
                for args in zip(*part):
                    try:
                        row = one(*args)
                    except Exception:  # noqa: BLE001 - P6: a failing embedder leaves the defaults
                        row = (None, None, None, None, None, None, None, 1)
                    rows.append(row)
                    held += 6 + len(row[6] or ())
                    if held >= HELD_VECTORS:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    return emb


def with_embeddings(events: DataFrame, dim: int = V.DEFAULT_DIM, embedder=None,
                    limits: K.TextLimits = K.WHOLE_TEXTS) -> DataFrame:
    """One Arrow stage: every vector the scorers need, as struct column ``_emb``."""
    cut = limits.rag_chars
    r_cut, q_cut = F.coalesce("response", F.lit("")), F.coalesce("query", F.lit(""))
    if cut is not None:
        r_cut, q_cut = F.substring(r_cut, 1, cut), F.substring(q_cut, 1, cut)
    rag_ok = ~TX.is_blank("context") & ~TX.is_blank(q_cut) & ~TX.is_blank(r_cut)
    sents = TX.sentences(r_cut, K.RAG_MIN_SENTENCE_CHARS)
    if limits.rag_sentences is not None:
        sents = F.slice(sents, 1, limits.rag_sentences)
    return events.withColumn("_emb", _embed_struct(dim, embedder, cut)(F.col("query"), F.col("context"),
                                                                  F.col("response"), rag_ok, sents))


# ------------------------------------------------------------------ scorers
def quality_scores(df: DataFrame, toxicity: Column | None = None, language: Column | None = None,
                   sentiment: Column | None = None) -> DataFrame:
    """M6: sentiment (T2, or a supplied T3 column), toxicity (T4 column or 0.0),
    response_length (T1), language (T5 column or 'en'), denial (T6)."""
    resp = F.coalesce(F.col("response"), F.lit(""))
    blank = TX.is_blank(resp)
    lang = language if language is not None else F.lit(K.DEFAULT_LANGUAGE)
    short = F.length(TX.strip(resp)) < F.lit(K.MIN_LANGUAGE_TEXT_CHARS)
    return df.withColumns({
        "sentiment_score": F.when(blank, F.lit(0.5)).otherwise(sentiment if sentiment is not None
                                                                else TX.lexicon_sentiment(resp)),
        "toxicity_score": F.when(blank, F.lit(0.0)).otherwise(F.coalesce(toxicity, F.lit(0.0))
                                                             if toxicity is not None else F.lit(0.0)),
        "response_length": TX.word_count(resp),
        "language_detected": F.when(blank | short, F.lit(K.DEFAULT_LANGUAGE))
                              .otherwise(F.coalesce(lang, F.lit(K.DEFAULT_LANGUAGE))),
        "is_denial": TX.is_denial(resp),
    })


def hallucination_scores(df: DataFrame, judge: Column | None = None,
                         limits: K.TextLimits = K.WHOLE_TEXTS) -> DataFrame:
    """M1 + M2 + T8: embedding consistency against context (when non-empty) or query,
    optionally blended 0.6/0.4 with a judge score; blank response → 0.0 / none / []."""
    e = F.col("_emb")
    ctx_truthy = F.col("context").isNotNull() & (F.col("context") != "")
    q_truthy = F.col("query").isNotNull() & (F.col("query") != "")
    other = F.when(ctx_truthy, e["v_c"]).when(q_truthy, e["v_q"])
    emb = F.when(other.isNotNull(), S.clamp01((F.lit(1.0) - V.dot(e["v_r"], other)) / F.lit(2.0)))
    j = judge if judge is not None else F.lit(None).cast("double")
    score = (F.when(emb.isNotNull() & j.isNotNull(),
                    F.lit(K.HALLUCINATION_EMBEDDING_WEIGHT) * emb + F.lit(K.HALLUCINATION_JUDGE_WEIGHT) * j)
             .when(j.isNotNull(), j).when(emb.isNotNull(), emb).otherwise(F.lit(0.0)))
    method = (F.when(emb.isNotNull() & j.isNotNull(), F.lit("both")).when(j.isNotNull(), F.lit("llm_judge"))
              .when(emb.isNotNull(), F.lit("embedding")).otherwise(F.lit("none")))
    blank = TX.is_blank(F.coalesce(F.col("response"), F.lit("")))
    return df.withColumns({
        "hallucination_score": F.when(blank, F.lit(0.0)).otherwise(S.round4(score)),
        "hallucination_method": F.when(blank, F.lit("none")).otherwise(method),
        "flagged_claims": F.when(blank, F.array().cast("array<string>"))
                           .otherwise(TX.flagged_claims(F.col("response"), F.col("context"), limits)),
    })


def rag_scores(df: DataFrame) -> DataFrame:
    """M3 + M4 + M5 on the texts that ``with_embeddings`` took; null when context, query or response is blank."""
    e = F.col("_emb")
    ok = e["rag_q"].isNotNull()
    cr = S.clamp01(V.dot(e["rag_q"], e["rag_c"]))
    f_doc = S.clamp01(V.dot(e["rag_r"], e["rag_c"]))
    ar = S.clamp01(V.dot(e["rag_q"], e["rag_r"]))
    sims = F.transform(e["sent"], lambda s: S.clamp01(V.dot(s, e["rag_c"])))
    n = F.size(sims)
    sent_mean = F.when(n > 0, F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / n.cast("double"))
    f = F.when(sent_mean.isNotNull(), F.lit(K.RAG_DOC_WEIGHT) * f_doc + F.lit(K.RAG_SENTENCE_WEIGHT) * sent_mean) \
         .otherwise(f_doc)
    wf, wc, wa = K.GROUNDEDNESS_WEIGHTS
    g = f * F.lit(wf) + cr * F.lit(wc) + ar * F.lit(wa)
    null = F.lit(None).cast("double")
    return df.withColumns({
        "faithfulness_score": F.when(ok, S.round4(f)).otherwise(null),
        "context_relevance": F.when(ok, S.round4(cr)).otherwise(null),
        "answer_relevancy": F.when(ok, S.round4(ar)).otherwise(null),
        "groundedness_score": F.when(ok, S.round4(g)).otherwise(null),
    })


def drift_scores(df: DataFrame, cap: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """W1 on response vectors per app in (timestamp, id) order; blank response → null.

    The rows are staged once, so the Arrow embedding stage and the fused scorers run once; only
    row numbers and vectors move, and the scores are joined back by row number.  ``start``: the
    drift state of earlier records (streams).
    """
    from ternlens.operators.drift import online_drift

    blank = TX.is_blank(F.coalesce(F.col("response"), F.lit("")))
    vec = F.when(blank, F.lit(None).cast("array<double>")).otherwise(F.col("_emb")["v_r"])
    keyed = df.drop("drift_score", "embedding_vector").withColumn("_v", vec).drop("_emb")
    out = online_drift(keyed, vector="_v", cap=cap, keep_vector="embedding_vector", start=start)
    return out.withColumn("embedding_vector", F.coalesce("embedding_vector", F.array().cast("array<double>")))


def evaluate(events: DataFrame, flags: K.ModuleFlags = K.ModuleFlags(), dim: int = V.DEFAULT_DIM,
             judge: Column | None = None, toxicity: Column | None = None, language: Column | None = None,
             sentiment: Column | None = None, plugins: tuple = (), embedder=None,
             limits: K.TextLimits = K.WHOLE_TEXTS, drift_start: DataFrame | None = None) -> DataFrame:
    """P5: events → scored records with the modules quality, drift, hallucination and
    RAG (drift executes last — score columns are disjoint, so the record is the same as
    in the original order), then extra plug-in scorers (U1), clamp (P4) and health (M8).
    With drift on, the pre-drift records are staged once (an eager job); ``drift_start`` is the
    drift state of earlier records.  Repeated events are records as often as they are given.

    ``judge``/``toxicity``/``language``/``sentiment`` are optional columns already on
    ``events`` (for example joined from a judge table, J3, or produced by a spark.ml
    model, T4/T5) that replace the built-in defaults.
    """
    extra = {}
    for name, col in (("_judge", judge), ("_tox", toxicity), ("_lang", language), ("_sent", sentiment)):
        if col is not None:
            extra[name] = col
    src = events.withColumns(extra) if extra else events
    rec = event_to_record(normalize_events(src, list(extra), limits.event_chars, limits.tags, limits.tag_chars))
    rec = with_embeddings(rec, dim, embedder, limits)
    # Rows whose embedding failed keep module defaults; the count is kept per row.
    rec = rec.withColumn("score_errors", F.col("_emb")["errors"])
    if flags.quality:
        rec = quality_scores(rec, toxicity=F.col("_tox") if "_tox" in extra else None,
                             language=F.col("_lang") if "_lang" in extra else None,
                             sentiment=F.col("_sent") if "_sent" in extra else None)
    if flags.hallucination:
        rec = hallucination_scores(rec, judge=F.col("_judge") if "_judge" in extra else None, limits=limits)
    if flags.rag:
        rec = rag_scores(rec)
    # Drift last: it is the only step that moves rows, and it no longer needs the text vectors.
    if flags.drift:
        rec = drift_scores(rec, start=drift_start)
    else:
        rec = rec.drop("_emb")
    for plugin in plugins:
        rec = plugin.apply(rec)
        if "plugin_errors" in rec.columns:  # P6: rows on which it failed keep its defaults
            rec = rec.withColumn("score_errors", F.col("score_errors") + F.col("plugin_errors")).drop("plugin_errors")
    rec = clamp_scores(rec.drop(*extra.keys()))
    return rec.withColumn("health_score", S.health_score())
