"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers run over the classes of a clause's words:

* lexical: a word to its class (insult, threat, target, negator, reporter, other) and weight;
* target: whether a person is named within the last ``WINDOW`` words;
* negation: whether a negator's scope of ``SCOPE`` words is open;
* reported speech: whether a reporting verb came before in the clause;
* match: an insult or threat ends a match, labelled with the other transducers' states.

They are composed into one table, state x class -> (state, match).  A text's score comes
from its matched clauses, not from isolated words: the weight of a match goes to one of 16
patterns (kind x targeted x negated x reported), and a ridge-regularised logistic model over
the patterns' summed weights gives the score, so a negated or reported match counts as
the labels say it should.

The insult lexicon is learned from labelled rows: words and word stems (first
``STEM`` letters) that at least ``SUPPORT`` of the toxic rows hold and that are ``ODDS`` times
likelier there even at the low end of the estimate.  Supports are shares, so at most (words of a text / SUPPORT) entries pass,
whatever the corpus' size.  Training reads a bounded number of labelled rows
(``training.MAX_LABELLED``); every row is scored, over its whole text.

Defined results: null and empty texts get the score of a text without a match; without labels
of both kinds every score is the share of toxic labels (0.5 without labels); repeated rows are each
returned; empty tables give an empty table; extra columns, also ``toxic`` or ``y`` in the
documents, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import crc_mod, own, staged
from ternlens.llm.training import labelled, training_labels

FOLDS, HELD_OUT = 5, 0
SUPPORT = 0.004
ODDS = 8.0
#: Deviations by which the log odds are lowered before they count, so that a term few rows hold needs more.
DEVIATIONS = 1.64
STEM = 5
WINDOW, SCOPE = 4, 3
RIDGE = 1.0
#: FIXED VALUES: closed word classes of the grammar.
NEGATORS = "not no never without isn't don't nicht kein keine keinen nie ohne pas jamais aucun sans nunca sin ningún ninguna".split()
REPORTERS = "said says wrote writes called quoted quote sagte schrieb nannte zitierte dit écrit appelé cité dijo escribió llamó citó".split()
TARGETS = "you your you're he she they them du dich dir dein ihr euch sie tu te toi vous votre ils elles tú ti usted ustedes ellos ellas".split()
THREATS = "kill hurt beat destroy burn töten schlagen verletzen vernichten tuer frapper détruire matar golpear destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER = range(6)
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"\w+(?:'\w+)?")


def compose() -> tuple[list[list[tuple[int, int]]], int]:
    """table[state][class] = (next state, pattern or -1); the start state is 0."""
    def target(s, c):
        return WINDOW if c == TARGET else max(s - 1, 0)

    def negation(s, c):
        return SCOPE if c == NEGATOR else max(s - 1, 0)

    def reported(s, c):
        return 1 if c == REPORTER else s

    states = {s: k for k, s in enumerate(product(range(WINDOW + 1), range(SCOPE + 1), range(2)))}
    table = []
    for t, n, r in states:
        row = []
        for c in range(6):
            match = -1
            if c in (INSULT, THREAT):
                match = 8 * (c == THREAT) + 4 * (t > 0) + 2 * (n > 0) + r
            row.append((states[target(t, c), negation(n, c), reported(r, c)], match))
        table.append(row)
    return table, len(states)


PATTERNS = 16
TABLE, _ = compose()
CLOSED = ({w: NEGATOR for w in NEGATORS} | {w: REPORTER for w in REPORTERS} | {w: TARGET for w in TARGETS}
          | {w: THREAT for w in THREATS})


def terms(text: str) -> set[str]:
    """Distinct words, and their stems with a hyphen."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM}


def matches(text: str, lexicon: dict[str, float]) -> list[float]:
    """Summed weights of the matches by pattern."""
    out = [0.0] * PATTERNS
    low = text.lower()
    words = set(WORD.findall(low))
    if not any(w in lexicon or w[:STEM] + "-" in lexicon or CLOSED.get(w) == THREAT for w in words):
        return out
    for clause in CLAUSE.split(low):
        state = 0
        for w in WORD.findall(clause):
            weight = lexicon.get(w) or (lexicon.get(w[:STEM] + "-") if len(w) > STEM else None)
            kind = INSULT if weight else CLOSED.get(w, OTHER)
            state, match = TABLE[state][kind]
            if match >= 0:
                out[match] += weight or 1.0
    return out


def learn_lexicon(docs: DataFrame, labels: DataFrame, n_toxic: int, n_clean: int, id_col: str,
                  text_col: str) -> dict[str, float]:
    """Terms and weights (log odds), from document frequencies over the labelled rows."""
    rows = own(labelled(own(docs, id_col, text_col), labels, id_col), text_col, "__y")

    def counts(only: set[str] | None):
        def run(batches):
            seen: Counter = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    if t:
                        seen.update(terms(t) if only is None else terms(t) & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["term", "n"])
        return run

    def frequency(y: int, only: set[str] | None, least: float) -> dict[str, int]:
        part = rows.filter(F.col("__y") == y).select(text_col).mapInArrow(counts(only), "term string, n long")
        total = part.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {r["term"]: r["n"] for r in total.collect()}  # terms / SUPPORT rows at most

    toxic = frequency(1, None, max(3.0, SUPPORT * n_toxic))
    clean = frequency(0, set(toxic), 0)
    out = {}
    for term, n in toxic.items():
        other = clean.get(term, 0)
        odds = (n + 0.5) / (n_toxic + 1) / ((other + 0.5) / (n_clean + 1))
        sure = math.log(odds) - DEVIATIONS * math.sqrt(1 / (n + 0.5) + 1 / (other + 0.5))
        if sure >= math.log(ODDS):
            out[term] = sure
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Newton's method; weights with the intercept first (which the ridge leaves alone)."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pattern_features(docs: DataFrame, lexicon: dict[str, float], id_col: str, text_col: str) -> DataFrame:
    """id, f array<double>: log(1 + weight) of each pattern, of all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        for b in batches:
            f = np.array([matches(t, lex) if t else [0.0] * PATTERNS for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(np.log1p(f.reshape(-1, PATTERNS))), pa.list_(pa.float64()))], names=[id_col, "f"])
    kind = docs.schema[id_col].dataType.simpleString()
    return own(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, f array<double>")


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    train = training_labels(labels, label_col, FOLDS, HELD_OUT, id_col)
    n = {r["__y"]: r["n"] for r in train.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    lexicon = learn_lexicon(docs, train, n_toxic, n_clean, id_col, text_col) if n_toxic and n_clean else {}
    features = staged(pattern_features(docs, lexicon, id_col, text_col), "toxicity")
    share = n_toxic / (n_toxic + n_clean) if n else 0.5
    w = np.zeros(PATTERNS + 1)
    w[0] = math.log(max(share, 1e-9) / max(1 - share, 1e-9)) if n else 0.0
    if lexicon:
        # equal feature rows are one row with a count of their labels; labelled rows are bounded
        got = labelled(features, train, id_col).select("f", "__y").toPandas()
        if len(got) and got["__y"].nunique() == 2:
            w = fit_logistic(np.array(got["f"].tolist()), got["__y"].to_numpy(float))
    logit = F.aggregate(F.zip_with(F.col("f"), F.array(*[F.lit(float(v)) for v in w[1:]]), lambda a, b: a * b),
                        F.lit(float(w[0])), lambda a, b: a + b)
    scored = features.select(F.col(id_col), (crc_mod(id_col, FOLDS) == HELD_OUT).alias("held_out"),
                             (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.select(id_col, "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
