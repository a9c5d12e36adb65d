"""Text scalar functions as Column expressions (regex and higher-order functions).

Everything here is JVM-side Catalyst: split / filter / transform / rlike run inside
whole-stage code generation next to the scan, with no Python in the row path.
Python's ``\\s``, ``\\b`` and ``\\w`` are Unicode-aware, so the Java patterns carry
``(?U)`` to match them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternlens import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside ``body`` (a lambda).

    Catalyst re-evaluates an outer expression each time a higher-order-function
    lambda mentions it; binding it as the lambda argument of a one-element
    ``transform`` computes it once per row instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _arr(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


# Python's str.isspace() set: Unicode White_Space plus the four separators \x1c-\x1f.
WS = r"[\s\x1C-\x1F]"


def is_blank(x) -> Column:
    """True for null, empty or whitespace-only text."""
    x = _c(x)
    return x.isNull() | (F.regexp_replace(x, f"(?U){WS}+", "") == F.lit(""))


def strip(x) -> Column:
    """Unicode-whitespace strip (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(x), f"(?U)^{WS}+|{WS}+$", "")


def whitespace_tokens(x) -> Column:
    """Whitespace split with empty pieces removed (``str.split()``)."""
    return F.filter(F.split(_c(x), f"(?U){WS}+"), lambda t: t != F.lit(""))


def word_count(x) -> Column:
    """Whitespace word count; blank → 0."""
    return F.when(is_blank(x), F.lit(0)).otherwise(F.size(whitespace_tokens(x))).cast("int")


def lexicon_sentiment(x) -> Column:
    """0.5 + 0.5·(p−n)/(p+n) over distinct lower-cased whitespace tokens; no hit → 0.5."""
    toks = F.array_distinct(whitespace_tokens(F.lower(_c(x))))
    p = F.size(F.array_intersect(toks, _arr(K.POSITIVE_WORDS)))
    n = F.size(F.array_intersect(toks, _arr(K.NEGATIVE_WORDS)))
    score = F.lit(0.5) + F.lit(0.5) * (p - n).cast("double") / (p + n).cast("double")
    return F.when(is_blank(x) | ((p + n) == 0), F.lit(0.5)).otherwise(score)


DENIAL_REGEX = "(?iU)" + "|".join(p.replace(r"\s", WS) for p in K.DENIAL_PATTERNS)


def is_denial(x) -> Column:
    """Any refusal phrase (case-insensitive, word-bounded); blank → false."""
    return F.when(is_blank(x), F.lit(False)).otherwise(_c(x).rlike(DENIAL_REGEX))


def sentences(x, min_chars: int) -> Column:
    """Split on runs of . ! ?, strip, keep pieces longer than ``min_chars``."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[.!?]+"), lambda s: strip(s))
    return F.filter(parts, lambda s: F.length(s) > F.lit(min_chars))


_WORD_RUN = r"(?U)\w+"
_CAP_WORD = r"^[A-Z][a-z]+$"
_DIGITS = r"(?U)^\d+$"
_NUMBER2 = r"(?U)\b\d{2,}\b"
_NAME_PAIR = r"(?U)\b[A-Z][a-z]+ [A-Z][a-z]+\b"


def key_terms(sentence: Column) -> Column:
    """Capitalised words and numbers that stand as whole words, with repeats."""
    words = F.regexp_extract_all(sentence, F.lit(_WORD_RUN), 0)
    return F.filter(words, lambda w: w.rlike(_CAP_WORD) | w.rlike(_DIGITS))


def flagged_claims(response, context, limits: K.TextLimits = K.WHOLE_TEXTS) -> Column:
    """Sentences (T7, >20 chars) with a factual marker whose key terms are mostly
    absent from the context (with ``limits``: the first few, each cut). No context/response → [].

    The lower-cased context and each sentence's key terms are bound once (``let``), so
    the work per row is linear in sentences × terms, not in repeated context copies.
    """
    r, c = _c(response), _c(context)

    def per_sentence(ctx: Column, s: Column) -> Column:
        def check(terms: Column) -> Column:
            hits = F.size(F.filter(terms, lambda t: F.contains(ctx, F.lower(t))))
            n = F.size(terms)
            marker = (s.rlike(_NUMBER2) | F.contains(s, F.lit('"')) | F.contains(s, F.lit("'"))
                      | s.rlike(_NAME_PAIR))
            return marker & (n > 0) & (hits.cast("double") < n.cast("double") / F.lit(2.0))
        return let(key_terms(s), check)

    flagged = let(F.lower(c), lambda ctx: F.filter(sentences(r, K.CLAIM_MIN_SENTENCE_CHARS),
                                                   lambda s: per_sentence(ctx, s)))
    out = flagged
    if limits.claim_chars is not None:
        out = F.transform(out, lambda s: F.substring(s, 1, limits.claim_chars))
    if limits.claims is not None:
        out = F.slice(out, 1, limits.claims)
    empty = F.array().cast("array<string>")
    return F.when(c.isNull() | (c == F.lit("")) | r.isNull() | (r == F.lit("")), empty).otherwise(out)


def sanitize_app_name(x) -> Column:
    """``drift_`` + name with non-word characters as single underscores, ≤ 63 chars."""
    safe = F.regexp_replace(F.regexp_replace(_c(x), "[^a-zA-Z0-9_]", "_"), "_+", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    named = F.when(safe == F.lit(""), F.lit("drift_default")).otherwise(F.concat(F.lit("drift_"), safe))
    return F.substring(named, 1, 63)


def judge_prompt(query, context, response) -> Column:
    """The delimited judge request (context block only when context is non-empty)."""
    q, c, r = _c(query), _c(context), _c(response)
    with_ctx = F.concat(F.lit("<query>\n"), q, F.lit("\n</query>\n\n<context>\n"), c,
                        F.lit("\n</context>\n\n<response>\n"), r, F.lit("\n</response>"))
    without = F.concat(F.lit("<query>\n"), q, F.lit("\n</query>\n\n<response>\n"), r, F.lit("\n</response>"))
    return F.when(c.isNotNull() & (c != F.lit("")), with_ctx).otherwise(without)


def parse_judge_answer(x) -> Column:
    """Strip → number → clamp to [0, 1]; unparsable → null (NaN clamps to 1.0)."""
    num = strip(_c(x)).try_cast("double")
    return (F.when(num.isNull(), F.lit(None).cast("double"))
            .when(F.isnan(num), F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num))))


# ------------------------------------------------------------------ number formatting
def _round_exact(v: Column, decimals: int) -> Column:
    """Round a double half-even on its exact binary value (Python ``format`` semantics).

    ``p = v·10^d`` may itself be rounded; when it lands exactly on .5 the sign of the
    multiplication error (Dekker's split, exact for 10^d < 2^26) says which side the
    true value was on.
    """
    s = float(10 ** decimals)
    p = v * F.lit(s)
    c = v * F.lit(134217729.0)
    hi = c - (c - v)
    lo = v - hi
    err = (hi * F.lit(s) - p) + lo * F.lit(s)
    fl = F.floor(p).cast("double")
    half = (p - fl) == F.lit(0.5)
    even_pick = F.when((fl % F.lit(2.0)) == F.lit(0.0), fl).otherwise(fl + F.lit(1.0))
    tie = F.when(err > 0, fl + F.lit(1.0)).when(err < 0, fl).otherwise(even_pick)
    r = F.when(half, tie).otherwise(F.bround(p, 0))
    return r / F.lit(s)


def fixed(v, decimals: int) -> Column:
    """``f"{v:.{d}f}"`` for doubles: exact-value half-even rounding, then fixed notation."""
    v = _c(v).cast("double")
    return F.format_string(f"%.{decimals}f", _round_exact(v, decimals))


def iso_utc(ts) -> Column:
    """``datetime.isoformat()`` of a UTC timestamp: fraction only when non-zero, ``+00:00``."""
    ts = _c(ts)
    frac = F.when(F.unix_micros(ts) % F.lit(1_000_000) != 0,
                  F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))
