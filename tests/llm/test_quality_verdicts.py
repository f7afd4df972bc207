"""Verdicts follow the estimate: rules that tell nothing, or the wrong way round, overrule no others."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.llm import quality_rules as Q


def votes(rng, bad, on_good, on_bad, abstain=0.1):
    """Votes (texts, rules) of rules that reject the given shares of good and of bad texts."""
    rate = np.where(bad[:, None], np.array(on_bad), np.array(on_good))
    v = np.where(rng.random(rate.shape) < rate, -1, 1)
    return np.where(rng.random(rate.shape) < abstain, 0, v)


def kept(v):
    patterns, which, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    model = Q.fit(patterns, counts.astype(float), [f"r{i}" for i in range(v.shape[1])])
    return (model.posteriors(patterns) >= 0.5)[which.ravel()], model


@pytest.mark.parametrize(("name", "on_good", "on_bad"), [("useless", 0.6, 0.6), ("below chance", 0.7, 0.2), ("rejects all", 0.97, 0.97), ("ninth good one", 0.05, 0.8)])
def test_one_odd_rule_among_eight(name, on_good, on_bad):
    rng = np.random.default_rng(3)
    bad = rng.random(20_000) < 0.2
    got, model = kept(votes(rng, bad, [0.05] * 8 + [on_good], [0.8] * 8 + [on_bad]))
    assert got[~bad].mean() > 0.95 and got[bad].mean() < 0.05, name
    assert model.prior == pytest.approx(0.8, abs=0.02)


def test_two_kinds_of_defects_and_a_useless_rule():
    """Each kind is noticed by two rules only; the useless rule votes on everything."""
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 30_000, p=[0.7, 0.2, 0.1])
    rate = np.full((30_000, 7), 0.005)
    rate[kind == 1, :2], rate[kind == 2, 2:4], rate[:, 6] = 0.9, 0.9, 0.55
    v = np.where(rng.random(rate.shape) < rate, -1, 1)
    got, _ = kept(v)
    assert got[kind == 0].mean() > 0.95 and got[kind == 1].mean() < 0.1 and got[kind == 2].mean() < 0.1


def test_nothing_is_kept_where_most_rules_reject_everything():
    rng = np.random.default_rng(5)
    got, _ = kept(votes(rng, np.ones(5_000, bool), [0.9] * 9, [0.9] * 9))
    assert not got.any()
