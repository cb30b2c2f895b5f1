"""Quality rules learned as boosted trees with monotonic constraints.

Fixed base rules fail a document with fewer than ``MIN_WORDS`` words or with more
than ``MAX_REPEAT`` percent of its words in repeated 8-word windows.  The verdict on
all others comes from gradient-boosted trees over document statistics, fitted on
a bounded sample of labelled rows (``max_rows``), flattened to numpy node arrays
and applied to whole Arrow batches.  The probability may only fall with symbols,
repeats, repeated lines and a dominating word, and so no document can gain by
having more of them.

One pass over all texts, no shuffle.  Defined results: a null or empty text has zero
counts and fails the base rules; without any label the trees are empty and only the
base rules decide; repeated rows, and those with null or
repeated ids, are judged each on its own; input columns of any name come back below ``row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.statistics import COUNTS, FEATURES, labelled_sample, with_statistics
from scoutline.llm.trees import Trees, fit_trees

MIN_WORDS = 20
MAX_REPEAT = 30          # percent
KEEP_FROM = 0.3          # probability of label 1 from which a document is kept
MAX_TRAIN_ROWS = 20_000  # bound of the labelled sample
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "top_ratio": -1}


def fit_quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Trees:
    x, y = labelled_sample(docs, labels, max_rows)
    return fit_trees(x, y, monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})


def quality_rules(docs: DataFrame, model: Trees, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``row`` (struct of ``keep``, by default all columns), the counts,
    ``base_failed``, ``probability`` and ``kept`` for every row."""
    judged = with_statistics(docs, text_col, keep, model.probability)
    failed = (F.col("stats.n_words") < MIN_WORDS) | (
        100 * F.col("stats.n_repeat_words") > MAX_REPEAT * F.col("stats.n_words"))
    return judged.select("row", *[F.col(f"stats.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"),
                         "probability", (~failed & (F.col("probability") >= KEEP_FROM)).alias("kept"))
