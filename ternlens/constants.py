"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES — thresholds, weights, limits, word lists and patterns. They are
behavioural facts (what a score means), kept together here in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- FIXED VALUES: field limits -------------------------------------------------
MAX_TEXT_CHARS = 200_000        # query / response / context truncation
MAX_TAGS = 50                   # tags kept
MAX_TAG_CHARS = 100             # characters per tag
MAX_NAME_CHARS = 256            # app_name / model_name
MAX_VECTOR_DIMS = 2048          # embedding_vector truncation
MAX_CLAIMS = 20                 # flagged_claims kept on a record
MAX_CLAIM_CHARS = 500           # characters per stored claim
MAX_LANGUAGE_CHARS = 10         # language code
DEFAULT_APP = "default"
DEFAULT_MODEL = "unknown"

# ---- FIXED VALUES: health score ---------------------------------------------------
HEALTH_WEIGHTS = {
    "hallucination": 0.35,
    "drift": 0.25,
    "rag": 0.20,
    "quality": 0.15,
    "regression": 0.05,
}
QUALITY_TOXICITY_WEIGHT = 0.5
QUALITY_SENTIMENT_WEIGHT = 0.4
QUALITY_DENIAL_WEIGHT = 0.1
DENIAL_PENALTY = 0.1
NEUTRAL_HEALTH = 50

# ---- FIXED VALUES: health bands -----------------------------------------------------
HEALTH_BANDS = [(90, "HEALTHY"), (75, "MONITORING"), (60, "DEGRADING")]
HEALTH_BAND_LOWEST = "CRITICAL"

# ---- FIXED VALUES: drift ----------------------------------------------------------------
MIN_DRIFT_BASELINE = 10
DRIFT_BASELINE_CAP = 10_000
DRIFT_KPI_STABLE_BELOW = 0.15
DRIFT_TAB_STABLE_BELOW = 0.1
DRIFT_TAB_MINOR_BELOW = 0.2

# ---- FIXED VALUES: alert thresholds and cooldown ------------------------------------------
@dataclass(frozen=True)
class Thresholds:
    hallucination: float = 0.3
    drift: float = 0.15
    rag_groundedness_min: float = 0.65
    toxicity: float = 0.05
    regression_fail_rate: float = 0.10


DEFAULT_COOLDOWN_SECONDS = 300
CRITICAL_EXCESS = 0.2

# ---- FIXED VALUES: hallucination / RAG ------------------------------------------------------
HALLUCINATION_EMBEDDING_WEIGHT = 0.6
HALLUCINATION_JUDGE_WEIGHT = 0.4
CLAIM_MIN_SENTENCE_CHARS = 20
CLAIM_MAX_CHARS = 200
CLAIMS_PER_RESPONSE = 5
# Cuts of the bounded original; the default reads whole texts, these are for parity (``TextLimits``).
RAG_MAX_TEXT_CHARS = 10_000
RAG_MIN_SENTENCE_CHARS = 15
RAG_MAX_SENTENCES = 10
RAG_DOC_WEIGHT = 0.6
RAG_SENTENCE_WEIGHT = 0.4
GROUNDEDNESS_WEIGHTS = (0.40, 0.30, 0.30)   # faithfulness, context relevance, answer relevancy
SCORE_DECIMALS = 4

# ---- FIXED VALUES: language detection -----------------------------------------------------------
MIN_LANGUAGE_TEXT_CHARS = 10
DEFAULT_LANGUAGE = "en"

# ---- FIXED VALUES: regression suite -------------------------------------------------------------
GOLDEN_MAX_HALLUCINATION = 0.3
GOLDEN_MAX_TOXICITY = 0.1
REGRESSION_RESPONSE_CHARS = 500
REGRESSION_GATE = 0.9

# ---- FIXED VALUES: dashboards ---------------------------------------------------------------------
DASHBOARD_WINDOW = 500
LIVE_STATS_WINDOW = 50
ALERT_FEED_SIZE = 20
TOP_HALLUCINATIONS = 10
MODEL_HALLUCINATION_FLAG = 0.3
CSV_EXPORT_ROWS = 1000

# ---- FIXED VALUES: sentiment lexicon (fallback scorer) ----------------------------------------------
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "helpful", "useful", "clear",
    "accurate", "correct", "perfect", "happy", "love", "best", "beautiful", "brilliant", "outstanding",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "wrong", "error", "fail", "poor", "worst", "ugly", "hate",
    "stupid", "useless", "broken", "confused", "disappointed", "frustrating", "annoying",
]

# ---- FIXED VALUES: refusal phrases (case-insensitive, word-bounded, optional apostrophe/comma) --------
DENIAL_PATTERNS = [
    r"\bi\s+cannot\b",
    r"\bi'?m\s+unable\b",
    r"\bi\s+can'?t\b",
    r"\bas\s+an?\s+ai\b",
    r"\bi\s+don'?t\s+have\s+access\b",
    r"\bi'?m\s+not\s+able\b",
    r"\bi\s+am\s+not\s+able\b",
    r"\bi\s+apologize,?\s+but\s+i\b",
    r"\bunfortunately,?\s+i\s+(cannot|can'?t)\b",
    r"\bi\s+do\s+not\s+have\s+(the\s+ability|enough\s+information)\b",
]

# ---- FIXED VALUES: sortable columns and time-series metrics -----------------------------------------
SORTABLE_COLUMNS = ["timestamp", "health_score", "app_name", "hallucination_score", "drift_score", "created_at"]
TIME_SERIES_METRICS = [
    "hallucination_score", "drift_score", "faithfulness_score", "groundedness_score",
    "sentiment_score", "toxicity_score", "health_score", "context_relevance", "answer_relevancy",
    "response_length", "latency_ms",
]
TIME_BUCKET_FORMATS = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}

# ---- FIXED VALUES: CSV export columns (in export order) ---------------------------------------------
CSV_EXPORT_COLUMNS = [
    "id", "app_name", "timestamp", "query", "response", "model_name", "latency_ms", "health_score",
    "hallucination_score", "drift_score", "faithfulness_score", "context_relevance", "answer_relevancy",
    "groundedness_score", "sentiment_score", "toxicity_score", "response_length", "language_detected",
    "is_denial",
]


@dataclass(frozen=True)
class ModuleFlags:
    """Which scorers ``evaluate`` runs (all on by default)."""
    hallucination: bool = True
    drift: bool = True
    rag: bool = True
    quality: bool = True
    regression: bool = False
    extra: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class TextLimits:
    """How much of texts and lists the scorers read; ``None`` is everything."""
    rag_chars: int | None = None
    rag_sentences: int | None = None
    claims: int | None = None
    claim_chars: int | None = None
    event_chars: int | None = None
    tags: int | None = None
    tag_chars: int | None = None


WHOLE_TEXTS = TextLimits()
PARITY_LIMITS = TextLimits(RAG_MAX_TEXT_CHARS, RAG_MAX_SENTENCES, CLAIMS_PER_RESPONSE, CLAIM_MAX_CHARS,
                           MAX_TEXT_CHARS, MAX_TAGS, MAX_TAG_CHARS)
