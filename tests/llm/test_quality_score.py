"""The quality score recomputed in plain Python from kept rules and statistics, and its accuracy on labels that it never saw."""

import math
import zlib

from corvane.llm import _io, quality_classifier
from corvane.llm._stats import STATS, with_stats

SF = "/root/testdata/sf0.01"
RATIOS = ("word_chars", "n_symbols", "n_repeat_words", "n_distinct_words", "n_upper_words", "n_digits", "n_stops", "n_marks", "n_bars", "n_word_bytes_over_20")


def ratios(s):
    words, lines, letters = max(s["n_words"], 1), max(s["n_lines"], 1), max(s["n_upper"] + s["n_lower"], 1)
    return [*[s[k] / words for k in RATIOS], s["n_upper"] / letters, s["n_dup_lines"] / lines, s["n_words"] / lines, math.log1p(s["n_words"])]


def test_op4_score_equals_brute_force_and_holds_on_unseen_labels(spark, monkeypatch):
    fitted = {}

    def fit(x, y):
        fitted["n"], fitted["model"] = len(y), real(x, y)
        return fitted["model"]

    real = quality_classifier.fit_rules
    monkeypatch.setattr(quality_classifier, "fit_rules", fit)
    got = {r.doc_id: r for r in quality_classifier.op4_quality_classifier(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stats = {r["doc_id"]: {k: r[_io.OWN + k] for k in STATS} for r in with_stats(docs, keep=["doc_id"]).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    intercept, rules = fitted["model"]
    assert len(got) == len(stats) and rules and fitted["n"] == sum(not held(d) and d in stats for d in labels)
    for d, r in got.items():
        x = ratios(stats[d])
        total = intercept
        for weight, rule in rules:
            total += weight * all((x[i] <= cut) == below for i, below, cut in rule)
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9 and r.held_out == held(d) and r.predicted == int(r.score >= 0.5)
    unseen = [d for d in labels if held(d) and d in got]
    right = sum(got[d].predicted == labels[d] for d in unseen) / len(unseen)
    print(f"{len(rules)} rules, accuracy {right:.3f} on {len(unseen)} unseen labels")
    assert right > 0.95
