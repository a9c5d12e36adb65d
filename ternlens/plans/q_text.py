"""Queries for text functions (T1–T12) over documents, conversations and chat events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternlens import constants as K
from ternlens.functions import text as TX
from ternlens.plans.catalog import register
from ternlens.plans.sqlviews import V_EVT, with_views
from ternlens.sources import bridge
from ternlens.sources.tables import table

# RE2 spellings of Python's Unicode classes for the oracle side.
WS = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NW = r"[^\pL\pN_]"


def blank_sql(x: str) -> str:
    return f"({x} IS NULL OR regexp_replace({x}, '{WS}+', '', 'g') = '')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def sentences_sql(x: str, k: int) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[.!?]+'), "
            f"lambda s: {strip_sql('s')}), lambda s: length(s) > {k})")


def re2_of(py_pattern: str) -> str:
    """Python word-bounded pattern → RE2 (Unicode boundaries as explicit classes)."""
    out = py_pattern.replace(r"\s", WS)
    if out.startswith(r"\b"):
        out = f"(^|{NW})" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + f"($|{NW})"
    return out


def denial_sql(x: str) -> str:
    alts = "|".join(f"(?:{re2_of(p)})" for p in K.DENIAL_PATTERNS).replace("'", "''")
    return f"(CASE WHEN {blank_sql(x)} THEN false ELSE regexp_matches({x}, '{alts}', 'i') END)"


def sentiment_sql(x: str) -> str:
    toks = f"list_distinct({tokens_sql(f'lower({x})')})"
    pos = "[" + ", ".join(f"'{w}'" for w in K.POSITIVE_WORDS) + "]"
    neg = "[" + ", ".join(f"'{w}'" for w in K.NEGATIVE_WORDS) + "]"
    p = f"len(list_intersect({toks}, {pos}))"
    n = f"len(list_intersect({toks}, {neg}))"
    return (f"(CASE WHEN {blank_sql(x)} OR {p} + {n} = 0 THEN 0.5::DOUBLE "
            f"ELSE 0.5::DOUBLE + 0.5::DOUBLE * CAST({p} - {n} AS DOUBLE) / CAST({p} + {n} AS DOUBLE) END)")


def word_count_sql(x: str) -> str:
    return f"CAST(CASE WHEN {blank_sql(x)} THEN 0 ELSE len({tokens_sql(x)}) END AS INTEGER)"


def claims_sql(resp: str, ctx: str, limits: K.TextLimits = K.WHOLE_TEXTS) -> str:
    terms = (f"list_filter(regexp_extract_all(s, '[\\pL\\pN_]+'), "
             f"lambda w: regexp_full_match(w, '[A-Z][a-z]+') OR regexp_full_match(w, '\\p{{Nd}}+'))")
    marker = (f"(regexp_matches(s, '(^|{NW})\\p{{Nd}}{{2,}}($|{NW})') OR contains(s, '\"') OR contains(s, '''') "
              f"OR regexp_matches(s, '(^|{NW})[A-Z][a-z]+ [A-Z][a-z]+($|{NW})'))")
    hits = f"len(list_filter({terms}, lambda t: contains(lower({ctx}), lower(t))))"
    flagged = (f"list_filter({sentences_sql(resp, K.CLAIM_MIN_SENTENCE_CHARS)}, "
               f"lambda s: {marker} AND len({terms}) > 0 AND CAST({hits} AS DOUBLE) < len({terms}) / 2.0::DOUBLE)")
    out = flagged
    if limits.claim_chars is not None:
        out = f"list_transform({out}, lambda s: substring(s, 1, {limits.claim_chars}))"
    if limits.claims is not None:
        out = f"{out}[1:{limits.claims}]"
    return (f"(CASE WHEN {ctx} IS NULL OR {ctx} = '' OR {resp} IS NULL OR {resp} = '' "
            f"THEN CAST([] AS VARCHAR[]) ELSE {out} END)")


W_EVT = with_views(V_EVT)


@register("document_word_counts", ops="T1", sql=f"""
SELECT doc_id, {word_count_sql('text')} AS response_length FROM documents""")
def document_word_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.word_count("text").alias("response_length"))


@register("conversation_sentiment", ops="T2", sql=f"""
SELECT conv_id, turn, role, {sentiment_sql('text')} AS sentiment_score FROM conversations""")
def conversation_sentiment(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", TX.lexicon_sentiment("text").alias("sentiment_score"))


@register("response_denials", ops="T6", sql=W_EVT + f"""
SELECT id, {denial_sql('response')} AS is_denial FROM v_evt""")
def response_denials(spark, sf):
    e = bridge.chat_events(spark, sf)
    return e.select("id", TX.is_denial("response").alias("is_denial"))


@register("document_denials", ops="T6 (whole documents)", sql=f"""
SELECT doc_id, {denial_sql('text')} AS is_denial FROM documents""")
def document_denials(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.is_denial("text").alias("is_denial"))


@register("document_sentences", ops="T7", sql=f"""
SELECT doc_id, {sentences_sql('text', K.RAG_MIN_SENTENCE_CHARS)} AS sentences,
       CAST(len({sentences_sql('text', K.CLAIM_MIN_SENTENCE_CHARS)}) AS INTEGER) AS claim_sentences FROM documents""")
def document_sentences(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.sentences("text", K.RAG_MIN_SENTENCE_CHARS).alias("sentences"),
                    F.size(TX.sentences("text", K.CLAIM_MIN_SENTENCE_CHARS)).alias("claim_sentences"))


@register("response_flagged_claims", ops="T8", sql=W_EVT + f"""
SELECT id, {claims_sql('response', 'context')} AS flagged_claims FROM v_evt""")
def response_flagged_claims(spark, sf):
    e = bridge.chat_events(spark, sf)
    return e.select("id", TX.flagged_claims("response", "context").alias("flagged_claims"))


@register("response_flagged_claims_parity", ops="T8 (first 5 claims of 200 characters)", sql=W_EVT + f"""
SELECT id, {claims_sql('response', 'context', K.PARITY_LIMITS)} AS flagged_claims FROM v_evt""")
def response_flagged_claims_parity(spark, sf):
    e = bridge.chat_events(spark, sf)
    return e.select("id", TX.flagged_claims("response", "context", K.PARITY_LIMITS).alias("flagged_claims"))


@register("document_claims_vs_benchmark", ops="T8 (every document against the benchmark passage of its id modulo their number)", sql=f"""
SELECT d.doc_id, {claims_sql('d.text', 'b.text')} AS flagged_claims
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def document_claims_vs_benchmark(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("ctx"))
    items = b.agg(F.count(F.lit(1)).alias("items"))
    j = d.join(F.broadcast(items)).join(b, F.try_mod(F.col("doc_id"), F.col("items")) == F.col("item_id"), "left")
    return j.select("doc_id", TX.flagged_claims("text", "ctx").alias("flagged_claims"))


@register("app_collection_names", ops="T9", sql="""
SELECT p_partkey, CASE WHEN s = '' THEN 'drift_default' ELSE substring('drift_' || s, 1, 63) END AS collection
FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9_]', '_', 'g'),
                                                      '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)""")
def app_collection_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", TX.sanitize_app_name("p_name").alias("collection"))


@register("judge_requests", ops="T10", sql=W_EVT + """
SELECT id, CASE WHEN context IS NOT NULL AND context <> '' THEN
    '<query>' || chr(10) || query || chr(10) || '</query>' || chr(10) || chr(10) || '<context>' || chr(10) || context
    || chr(10) || '</context>' || chr(10) || chr(10) || '<response>' || chr(10) || response || chr(10) || '</response>'
  ELSE '<query>' || chr(10) || query || chr(10) || '</query>' || chr(10) || chr(10) || '<response>' || chr(10)
    || response || chr(10) || '</response>' END AS prompt
FROM v_evt""")
def judge_requests(spark, sf):
    e = bridge.chat_events(spark, sf)
    return e.select("id", TX.judge_prompt("query", "context", "response").alias("prompt"))


def _answers(spark, sf):
    """Judge answers derived from events: numbers, padded numbers, out-of-range and junk."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_id")
    ans = (F.when(e % 4 == 0, F.concat(F.lit("  0."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" \n")))
           .when(e % 4 == 1, k.cast("string"))
           .when(e % 4 == 2, F.col("event_type"))
           .otherwise(F.concat(F.lit("-0."), (k % 10).cast("string"))))
    return ev.select(e.cast("string").alias("id"), ans.alias("answer"))


@register("judge_answer_scores", ops="T11", sql=f"""
SELECT id, answer, CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN 1.0::DOUBLE
                        ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, v)) END AS judge_score
FROM (SELECT id, answer, TRY_CAST({strip_sql('answer')} AS DOUBLE) AS v
      FROM (SELECT CAST(event_id AS VARCHAR) AS id,
                   CASE event_id % 4
                     WHEN 0 THEN '  0.' || lpad(CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 100 AS VARCHAR), 2, '0') || ' ' || chr(10)
                     WHEN 1 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR)
                     WHEN 2 THEN event_type
                     ELSE '-0.' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS VARCHAR) END AS answer
            FROM events))""")
def judge_answer_scores(spark, sf):
    a = _answers(spark, sf)
    return a.select("id", "answer", TX.parse_judge_answer("answer").alias("judge_score"))
