"""Quality classifier as a sparse rule ensemble.

Paths of small boosted trees over document statistics become conjunctive rules;
a lasso logistic regression gives most rules weight 0; the rest are compiled into
one Spark column expression, so scoring is part of the query's own code.

Learning uses a bounded sample (``max_rows``) of labelled rows whose
crc32(id as text) mod 5 is not 0; the other fifth is held out.  Labels, language,
source and id are never inputs of a score.

Defined results: every row is scored; null and empty texts have zero statistics and
get the score of those; without any label every score is 0.5; repeated rows get
equal scores; null and repeated ids are rows of their own; other columns of any name do
no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.statistics import FEATURES, feature_columns, labelled_sample, with_statistics
from scoutline.llm.trees import fit_trees

MAX_TRAIN_ROWS = 20_000
FOLDS = 5
PREDICT_FROM = 0.3
PENALTY = 0.002


@dataclass
class RuleEnsemble:
    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: np.ndarray
    intercept: float

    def score(self, features: dict[str, Column]) -> Column:
        """The ensemble as one column over the feature columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for f, below, t in rule:
                c = features[FEATURES[f]]
                holds = holds & (c <= t if below else c > t)
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32(id as text) mod 5 is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def rule_matrix(rules, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for i, rule in enumerate(rules):
        for f, below, t in rule:
            out[:, i] *= (x[:, f] <= t) if below else (x[:, f] > t)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the penalty acts
    on weights of standardised columns, the intercept is free."""
    mean, scale = z.mean(0), z.std(0) + 1e-9
    z = (z - mean) / scale
    n, m = z.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    step = 1 / (0.25 * (np.linalg.norm(z, 2) ** 2 / n + 1))
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(z @ ahead_w + ahead_b))) - y) / n
        new = ahead_w - step * (z.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = ahead_b - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w / scale, float(b - (w * mean / scale).sum())


def fit_ensemble(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    trees = fit_trees(x, y, rounds=20, depth=3, rate=0.3, rows=0.7, seed=1)
    rules = sorted(set(trees.paths()))
    if not rules:
        return RuleEnsemble([], np.zeros(0), trees.start)
    z = rule_matrix(rules, x)
    seen, unique = set(), []
    for i in range(len(rules)):                    # rules with equal support say the same
        if (key := z[:, i].tobytes()) not in seen and 0 < z[:, i].mean() < 1:
            seen.add(key)
            unique.append(i)
    if not unique:
        return RuleEnsemble([], np.zeros(0), trees.start)
    w, b = lasso_logistic(z[:, unique], y, penalty)
    live = np.flatnonzero(w)
    return RuleEnsemble([rules[unique[i]] for i in live], w[live], b)


def fit_quality_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> RuleEnsemble:
    return fit_ensemble(*labelled_sample(docs, labels, max_rows, allowed=~held_out("label_id")))


def quality_score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``."""
    stats = with_statistics(docs, text_col, [id_col])
    features = stats.select(F.col(f"row.{id_col}").alias(id_col), *[c.alias(k) for k, c in feature_columns().items()])
    scored = features.select(id_col, held_out(id_col).alias("held_out"),
                             model.score({k: F.col(k) for k in FEATURES}).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0).cast("int"))
