"""Quality classifier: a sparse ensemble of rules.

Statistics of whole texts become ratios; boosted trees are fitted to labels; each path of a tree is a conjunctive rule;
logistic regression with a lasso penalty keeps few of them; those are compiled into one Spark column expression.

The fit uses at most about ``MOST_LABELLED`` labelled rows (a documented bound; rows are drawn by a hash of the id, and all of
them while the labels are fewer). Everything else covers all rows.

Edge cases: null and empty texts have all-zero statistics and get the score of such a text; labels that are null are left out;
of several labels of one document the rounded mean counts; without labels, or with labels of one class, the score is the
share of that class (0.5 without any); repeated rows get equal scores; rows without doc_id are scored and never held out
nor learnt from; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from ._stats import STATS, with_stats
from ._trees import boost, holds, lasso_logistic, rule_column

MOST_LABELLED = 40_000
TREES, DEPTH, PENALTY = 24, 3, 0.0005


def features() -> dict[str, Column]:
    """Ratios over the statistics columns; never null."""
    s = {k: F.col(_io.OWN + k).cast("double") for k in STATS}
    words, lines, letters = F.greatest(s["n_words"], F.lit(1.0)), F.greatest(s["n_lines"], F.lit(1.0)), F.greatest(s["n_upper"] + s["n_lower"], F.lit(1.0))
    out = {f"{k}_a_word": s[k] / words for k in ("word_chars", "n_symbols", "n_repeat_words", "n_distinct_words", "n_upper_words", "n_digits", "n_stops", "n_marks", "n_bars", "n_word_bytes_over_20")}
    return out | {"upper_share": s["n_upper"] / letters, "dup_line_share": s["n_dup_lines"] / lines, "words_a_line": s["n_words"] / lines, "log_words": F.log1p(s["n_words"])}


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept and (weight, rule) of the rules that the lasso keeps."""
    base, trees = boost(x, y, TREES, DEPTH, least=max(5, len(y) // 500))
    found = list(dict.fromkeys(tuple(sorted(p)) for t in trees for p in t.paths()))
    if not found:
        return base, []
    z = np.stack([holds(r, x) for r in found], 1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows count once
    found, z = [found[i] for i in sorted(first)], z[:, sorted(first)]
    intercept, w = lasso_logistic(z, y, PENALTY)
    return intercept, [(float(a), r) for a, r in zip(w, found, strict=True) if abs(a) > 1e-6]


def score_column(intercept: float, rules: list[tuple[float, tuple]], columns: list[Column]) -> Column:
    total = F.lit(float(intercept))
    for weight, rule in rules:
        total = total + F.when(rule_column(rule, columns), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) with ``__cv_held_out`` and ``__cv_score`` (0 to 1)."""
    keep = docs.columns if keep is None else keep
    made = features()
    own = [f"{_io.OWN}f_{k}" for k in made]
    table = _io.materialize(with_stats(docs, keep=keep).select(*[f"`{c}`" for c in keep], *[c.alias(n) for c, n in zip(made.values(), own, strict=True)]))
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).cast("double").alias(_io.OWN + "y")).filter(~held_out())
    n = marked.count()
    if n > MOST_LABELLED:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int((1 << 20) * MOST_LABELLED / n))
    got = table.select("doc_id", *own).join(marked, "doc_id").select(*own, _io.OWN + "y").toPandas().to_numpy(float)
    got = got[np.lexsort(got.T)] if len(got) else got.reshape(0, len(own) + 1)
    intercept, rules = fit_rules(got[:, :-1], got[:, -1])
    return table.select(*[f"`{c}`" for c in keep], held_out().alias(_io.OWN + "held_out"), score_column(intercept, rules, [F.col(c) for c in own]).alias(_io.OWN + "score"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(_io.read(spark, sf_dir, "documents"), _io.read(spark, sf_dir, "labels"), keep=["doc_id"])
    score = F.col(_io.OWN + "score")
    return out.select("doc_id", F.col(_io.OWN + "held_out").alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
