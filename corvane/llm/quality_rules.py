"""Quality rules by weak supervision.

Rules look at whole-text statistics and vote 1 (good), -1 (bad) or 0 (abstain). Expectation-maximisation over the counts of
vote patterns of the whole corpus estimates a latent-class model: how many texts are good, and how often each rule gives a
bad vote to good texts and to bad ones, by kind of defect. A text's posterior probability of being good then replaces a
filter that asks for all rules at once.

Bad texts are bad in different ways, so the model begins with one good and one bad class and splits off a further class
while the Bayesian information criterion gains from it. Given its class a text's votes are independent; an abstention is a
missing vote and carries no evidence. Classes are named by what the estimate says of all rules together (``_bad_classes``): the
class that rules reject least is the good one, and a class is bad if rules reject half a vote more of it than of that one. A
rule that rejects about the same share of every class counts for nothing there, and so does one that is wrong more often than right.
Each rate has a Beta(1/2, 1/2) prior, half a vote on either side, which is all that keeps it from 0 and 1; no estimate is clipped.

Only the counts of vote patterns reach the driver: at most 3**9 rows, whatever the corpus holds.

Edge cases: null and empty text have no words, fail the base and are not kept; repeated rows get equal results, one each; an
empty table gives an empty result; columns of the caller are kept and never clash with helper columns, which start with
``__cv_``. A defect that all texts share cannot be told from a useless rule; where most rules reject most of every class, nothing is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from ._stats import with_stats

#: Classes of the latent-class model at most.
MOST_CLASSES = 8
#: Rates of a rule that differ by less over all classes tell nothing; votes against a class, over those against the best one, that make it bad.
SPREAD, EXCESS = 0.1, 0.5


def _s(name: str) -> Column:
    return F.col(_io.OWN + name)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes as Column expressions over the statistics columns."""
    n = _s("n_words")
    return {
        "length": _vote(n < 50, n >= 100),
        "symbols": _vote(_s("n_symbols") * 10 > n, _s("n_symbols") * 50 <= n),
        "upper_case": _vote(_s("n_upper_words") * 100 > 30 * n, _s("n_upper_words") * 10 <= n),
        "repeated_lines": _vote(_s("n_dup_lines") * 2 > _s("n_lines"), (_s("n_dup_lines") == 0) & (_s("n_lines") >= 2)),
        "repeated_words": _vote(_s("n_repeat_words") * 10 > 4 * n, _s("n_repeat_words") * 10 <= n),
        "word_length": _vote((_s("word_chars") < 3 * n) | (_s("word_chars") > 7 * n), (_s("word_chars") * 2 >= 7 * n) & (_s("word_chars") <= 6 * n)),
        "loud_marks": _vote((_s("n_marks") + _s("n_bars")) * 5 > n, (_s("n_marks") + _s("n_bars")) * 20 <= n),
        "variety": _vote(_s("n_distinct_words") * 5 < F.least(n, F.lit(400)), _s("n_distinct_words") * 5 >= 2 * F.least(n, F.lit(400))),
        "sentences": _vote(_s("n_stops") * 200 < n, (_s("n_stops") * 50 >= n) & (_s("n_stops") * 3 <= n)),
    }


@dataclass
class LabelModel:
    """Latent classes: their shares, P(bad vote | class, the rule votes) for each rule, and which classes are of good texts."""

    names: list[str]
    share: np.ndarray
    rejects: np.ndarray
    good: np.ndarray

    def rates(self, good: bool) -> np.ndarray:
        """P(bad vote | texts are good, or bad; the rule votes) for each rule; NaN where the model has no such texts."""
        own = self.good == good
        return self.share[own] @ self.rejects[own] / self.share[own].sum() if own.any() else np.full(len(self.names), np.nan)

    @property
    def prior(self) -> float:
        """The share of good texts."""
        return float(self.share[self.good].sum())

    def accuracies(self) -> np.ndarray:
        """P(the vote is right | the rule votes) of each rule."""
        return self.prior * (1 - np.nan_to_num(self.rates(True))) + (1 - self.prior) * np.nan_to_num(self.rates(False))

    def posteriors(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) of patterns (p, rules) of -1, 0, 1."""
        bad, cast = (patterns == -1).astype(float), (patterns != 0).astype(float)
        log = np.log(self.share) + bad @ np.log(self.rejects).T + (cast - bad) @ np.log1p(-self.rejects).T
        each = np.exp(log - log.max(1, keepdims=True))
        return each[:, self.good].sum(1) / each.sum(1)


def _number(votes: list) -> Column | np.ndarray:
    """The number of a pattern of votes: -1, 0, 1 are its digits 0, 1, 2."""
    return sum((v + 1) * 3**r for r, v in enumerate(votes))


def _maximise(bad: np.ndarray, cast: np.ndarray, counts: np.ndarray, q: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """EM from responsibilities ``q`` (pattern, class): shares, rates of bad votes, responsibilities, log likelihood."""
    last = -np.inf
    for _ in range(rounds):
        w = counts[:, None] * q
        share = (w.sum(0) + 0.5) / (w.sum() + 0.5 * w.shape[1])
        rejects = (w.T @ bad + 0.5) / (w.T @ cast + 1.0)
        log = np.log(share) + bad @ np.log(rejects).T + (cast - bad) @ np.log1p(-rejects).T
        top = log.max(1, keepdims=True)
        each = np.exp(log - top)
        total = each.sum(1, keepdims=True)
        q = each / total
        like = float(counts @ (top + np.log(total))[:, 0])
        if abs(like - last) <= 1e-9 * abs(like):
            break
        last = like
    return share, rejects, q, like


def _bad_classes(share: np.ndarray, rejects: np.ndarray) -> np.ndarray:
    """Which classes are of bad texts, from their shares and P(bad vote | class, the rule votes)."""
    told = np.ptp(rejects, axis=0) >= SPREAD
    weight = told.astype(float)
    bad = np.zeros(len(share), bool)
    for _ in range(4):  # names follow weights, weights follow names
        good = int((rejects @ weight).argmin())
        before, bad = bad, (rejects - rejects[good]) @ weight >= EXCESS
        if bad.any() and not bad.all():
            gain = share[bad] @ rejects[bad] / share[bad].sum() - share[~bad] @ rejects[~bad] / share[~bad].sum()
            weight = (told & (gain > 0)).astype(float)
        if (bad == before).all():
            break
    return bad | ((rejects >= 0.5).mean(1) > 0.5)


def fit(patterns: np.ndarray, counts: np.ndarray, names: list[str], rounds: int = 300) -> LabelModel:
    """The latent-class model of vote patterns; patterns: (p, rules) of -1, 0, 1; counts: (p,).

    EM begins with each pattern bad in proportion to its share of bad votes. A split of a class begins from the texts that one
    rule rejects; the split of the greatest likelihood is taken.
    """
    if not len(counts):
        return LabelModel(names, np.ones(1), np.full((1, len(names)), 0.5), np.zeros(1, bool))
    bad, cast = (patterns == -1).astype(float), (patterns != 0).astype(float)
    part = np.clip(2 * bad.sum(1) / np.maximum(cast.sum(1), 1), 0.02, 0.98)
    best = _maximise(bad, cast, counts, np.stack([1 - part, part], 1), rounds)
    cost = 0.5 * (1 + len(names)) * np.log(counts.sum() + 1)  # the criterion's penalty for a class
    while len(best[0]) < MOST_CLASSES:
        tries = []
        for k in range(len(best[0])):
            for r in range(len(names)):
                moved = best[2][:, k] * np.where(bad[:, r] > 0, 0.9, 0.1)
                q = np.column_stack([best[2], moved])
                q[:, k] -= moved
                tries.append(_maximise(bad, cast, counts, q, 40))
        found = max(tries, key=lambda t: t[3])
        found = _maximise(bad, cast, counts, found[2], rounds)
        if found[3] - best[3] <= cost:
            break
        best = found
    share, rejects, _, _ = best
    return LabelModel(names, share, rejects, ~_bad_classes(share, rejects))


def quality_rules(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) with ``__cv_base_failed``, ``__cv_posterior`` and ``__cv_kept``, statistics and votes.

    The estimate needs the statistics of the whole corpus before any verdict. They are written to the shared folder, where the
    verdicts read them; if the text is kept, they are made a second time instead, so that texts are not copied.
    """
    whole = text in (docs.columns if keep is None else keep)
    table = with_stats(docs, text, keep) if whole else _io.materialize(with_stats(docs, text, keep))
    votes = {_io.OWN + "v_" + k: v.cast("int") for k, v in rules().items()}
    voted = table.withColumns(votes)
    counted = with_stats(docs, text, []).select(*[v.alias(k) for k, v in votes.items()]) if whole else voted
    seen = counted.groupBy(*votes).agg(F.count("*").alias("n")).collect()
    patterns = np.array([r[:-1] for r in seen], dtype=int).reshape(len(seen), len(votes))
    model = fit(patterns, np.array([r[-1] for r in seen], dtype=float), list(rules()))
    n, key, name = _s("n_words"), _io.OWN + "pattern", _io.OWN + "posterior"
    rows = list(zip(_number(list(patterns.T)).tolist(), model.posteriors(patterns).tolist(), strict=True)) if len(seen) else []
    known = docs.sparkSession.createDataFrame(rows, f"{key} int, {name} double")  # at most 3**9 rows
    return (
        voted.withColumn(_io.OWN + "base_failed", (n < 50) | (100 * _s("n_repeat_words") > 50 * n))
        .join(F.broadcast(known), _number([F.col(c) for c in votes]) == F.col(key), "left")
        .drop(key)
        .withColumn(_io.OWN + "kept", ~F.col(_io.OWN + "base_failed") & (F.col(name) >= threshold))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_io.read(spark, sf_dir, "documents"), keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return out.select("doc_id", *[_s(c).alias(c) for c in names])
