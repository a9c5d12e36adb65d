"""Score arithmetic as Column expressions: clamps, quality sub-score, health, bands.

All of it is plain Catalyst arithmetic, so it fuses into whatever stage reads the
record columns (no extra pass, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternlens import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp01(x) -> Column:
    """Clamp into [0, 1], null stays null."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))


def round4(x) -> Column:
    """Half-even rounding to the score precision (4 decimals)."""
    return F.bround(_c(x), K.SCORE_DECIMALS)


def quality_subscore(toxicity="toxicity_score", sentiment="sentiment_score", denial="is_denial") -> Column:
    """M7: 0.5·(1−toxicity) + 0.4·sentiment + 0.1·(1 − denial penalty), clamped."""
    penalty = F.when(_c(denial), F.lit(K.DENIAL_PENALTY)).otherwise(F.lit(0.0))
    q = ((F.lit(1.0) - _c(toxicity)) * F.lit(K.QUALITY_TOXICITY_WEIGHT)
         + _c(sentiment) * F.lit(K.QUALITY_SENTIMENT_WEIGHT)
         + (F.lit(1.0) - penalty) * F.lit(K.QUALITY_DENIAL_WEIGHT))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))


def health_score(hallucination="hallucination_score", drift="drift_score",
                 groundedness="groundedness_score", faithfulness="faithfulness_score",
                 toxicity="toxicity_score", sentiment="sentiment_score", denial="is_denial",
                 regression=None) -> Column:
    """M8: weighted health 0–100 with the weight of absent components redistributed.

    Components, in order: hallucination (1−h), drift (1−d), RAG (groundedness,
    else faithfulness), quality (M7), regression pass rate (absent unless given).
    Score = Σ x_k·(w_k / W) over present k, ×100, half-even rounded, clamped.
    """
    W = K.HEALTH_WEIGHTS
    rag = F.coalesce(_c(groundedness), _c(faithfulness))
    comps = [
        (F.lit(1.0) - _c(hallucination), W["hallucination"]),
        (F.lit(1.0) - _c(drift), W["drift"]),
        (rag, W["rag"]),
        (quality_subscore(toxicity, sentiment, denial), W["quality"]),
    ]
    if regression is not None:
        comps.append((_c(regression), W["regression"]))
    total_w = None
    for x, w in comps:
        term = F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        total_w = term if total_w is None else total_w + term
    acc = None
    for x, w in comps:
        term = F.coalesce(x * (F.lit(w) / total_w), F.lit(0.0))
        acc = term if acc is None else acc + term
    raw = F.bround(acc * F.lit(100.0), 0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).cast("int")
    return F.when(total_w > 0, score).otherwise(F.lit(K.NEUTRAL_HEALTH))


def health_band(h="health_score") -> Column:
    """M9: HEALTHY / MONITORING / DEGRADING / CRITICAL."""
    expr = None
    for floor_, name in K.HEALTH_BANDS:
        cond = _c(h) >= F.lit(floor_)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(K.HEALTH_BAND_LOWEST))


def drift_kpi_status(avg_drift="avg_drift") -> Column:
    """M10 (KPI form): null → BUILDING BASELINE, < 0.15 → STABLE, else DRIFTING."""
    d = _c(avg_drift)
    return (F.when(d.isNull(), F.lit("BUILDING BASELINE"))
            .when(d < F.lit(K.DRIFT_KPI_STABLE_BELOW), F.lit("STABLE"))
            .otherwise(F.lit("DRIFTING")))


def drift_tab_status(avg_drift="avg_drift") -> Column:
    """M10 (tab form): < 0.1 Stable, < 0.2 Minor drift, else Significant drift!"""
    d = _c(avg_drift)
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(d < F.lit(K.DRIFT_TAB_STABLE_BELOW), F.lit("Stable"))
            .when(d < F.lit(K.DRIFT_TAB_MINOR_BELOW), F.lit("Minor drift"))
            .otherwise(F.lit("Significant drift!")))


def model_bar_band(avg_h="avg_hallucination") -> Column:
    """Model bar colour band (flag when mean hallucination > 0.3)."""
    return _c(avg_h) > F.lit(K.MODEL_HALLUCINATION_FLAG)
