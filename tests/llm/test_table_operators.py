"""Line dedup, URL filters, license scans, the classifier and the pipeline on small tables."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corvane.llm import license_scan, line_dedup, quality_classifier, url_filter
from corvane.llm._trees import boost, holds, lasso_logistic

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __x string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


def brute_lines(texts):
    first, places = {}, []
    for d, t in enumerate(texts):
        full = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\f\x0b")] if t is not None else []
        for j in range(len(full) - 2):
            w = tuple(x for _, x in full[j : j + 3])
            places.append((d, [i for i, _ in full[j : j + 3]], w))
            first.setdefault(w, (d, full[j][0]))
    gone = {}
    for d, at, w in places:
        if first[w] < (d, at[0]):
            gone.setdefault(d, set()).update(at)
    return [t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)], {d: len(g) for d, g in gone.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "\n\n\n", "a\nb\nc", "a\n\nb\n \nc\na\nb\nc\nd", "a\nb\nc\nd\ne\nf\n" * 300] + ["\n".join(rng.choice(["a", "b", "c", "", "é", " "]) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    want, gone = brute_lines(texts)
    rows = line_dedup.line_dedup(frame(spark, texts).repartition(3)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.text, r["__cv_n_removed"]) == (want[r.doc_id], gone.get(r.doc_id, 0)), texts[r.doc_id]
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_without_ids_and_with_repeated_rows(spark):
    t = "a\nb\nc"
    rows = line_dedup.line_dedup(frame(spark, [t, t, t, t], [None, 4, 4, 9])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("4", t), ("4", t), ("9", ""), ("None", t)]


def test_url_filter_reads_the_dot_of_the_root_away(spark):
    day = dt.date(2024, 5, 1)
    c = spark.createDataFrame([(1, "http://b.org./x", day), (2, "http://u@A.B.org.:80/", day), (3, "http://b.org/y", day), (4, "http://.", day), (5, "http://c.net./z", day)], "id int, url string, day date")
    events = spark.createDataFrame([("b.org", "spam", "add", dt.date(2024, 1, 1)), ("c.net.", "spam", "add", dt.date(2024, 1, 1)), ("c.net./z", "malware", "add", dt.date(2024, 1, 1))], "pattern string, category string, action string, day date")
    out = {r.id: (r["__cv_n_active"], r["__cv_categories"]) for r in url_filter.url_filter(c, events).collect()}
    assert out == {1: (1, ["spam"]), 2: (1, ["spam"]), 3: (1, ["spam"]), 4: (0, []), 5: (2, ["malware", "spam"])}


def test_url_filter_is_as_of_the_fetch_day(spark):
    day = lambda n: dt.date(2024, 1, n)
    events = [("bad.org", "spam", "add", day(5)), ("bad.org", "spam", "remove", day(10)), ("bad.org", "spam", "add", day(20)), ("bad.org", "spam", "add", day(7)), ("x.com/ads", "malware", "add", day(3)), ("tie.net", "spam", "add", day(4)), ("tie.net", "spam", "remove", day(4)), (None, "spam", "add", day(1))]
    captures = [(1, "http://www.bad.org/a", day(4)), (2, "http://www.bad.org/a", day(5)), (3, "HTTPS://u@BAD.org:80/q", day(9)), (4, "http://bad.org", day(10)), (5, "http://bad.org#f", day(25)), (6, "http://x.com/ads/1?u=bad.org", day(6)), (7, "http://x.com/adsense", day(6)), (8, None, day(6)), (9, "nonsense", day(6)), (10, "http://bad.org/", None), (11, "http://tie.net/", day(8)), (2, "http://www.bad.org/a", day(5))]
    c = spark.createDataFrame(captures, "id int, url string, day date")
    out = url_filter.url_filter(c, spark.createDataFrame(events, "pattern string, category string, action string, day date")).collect()
    assert sorted(r.id for r in out if r["__cv_n_active"]) == [2, 2, 3, 5, 6] and len(out) == 12
    assert {r.id: list(r["__cv_categories"]) for r in out}[6] == ["malware"]
    assert url_filter.url_filter(c.limit(0), spark.createDataFrame([], "pattern string, category string, action string, day date")).count() == 0


def test_license_scan(spark):
    filler = "lorem ipsum dolor sit amet consectetur " * 40
    texts = [filler + "LICENSED under the Apache License,\n version 2.0 " + filler, "Released under the MIT License.", "Released under the BSD License.", None, "", "a b c d", filler + "licensed under cc by nc 4 0", license_scan.TEMPLATES["MIT-text"].replace("granted", "given"), license_scan.TEMPLATES["BSD-3-Clause"].replace("conditions are met", "conditions hold")]
    rows = {r.doc_id: [(x.license, round(x.containment, 3)) for x in r["__cv_licenses"]] for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert rows[0] == [("Apache-2.0", 1.0)] and rows[1] == [("MIT", 1.0)] and rows[6] == [("CC-BY-NC-4.0", 1.0)]
    assert all(rows[i] == [] for i in (2, 3, 4, 5))
    assert rows[7] == [] and [k for k, _ in rows[8]] == ["BSD-3-Clause"]
    with pytest.raises(Exception, match="five words"):
        license_scan.license_scan(frame(spark, texts), {"short": "too short"}).count()
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_trees_rules_and_lasso():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.5)).astype(float)
    base, trees = boost(x, y, 20, 3)
    p = 1 / (1 + np.exp(-(base + sum(t.predict(x) for t in trees))))
    assert ((p > 0.5) == y).mean() > 0.99
    rules = [r for t in trees for r in t.paths()]
    z = np.stack([holds(r, x) for r in rules], 1).astype(float)
    b, w = lasso_logistic(z, y, 0.001)
    assert (((b + z @ w) > 0) == y).mean() > 0.98 and 0 < (np.abs(w) > 1e-6).sum() < len(w) / 2


def test_classifier_without_labels_and_with_one_class(spark):
    docs = frame(spark, [None, "", "some words here", "###### $$$"], [1, 2, 3, None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.quality_scores(docs, none).collect()
    assert {round(r["__cv_score"], 6) for r in out} == {0.5} and len(out) == 4
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 4)] + [(2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r["__cv_score"] <= 1 for r in quality_classifier.quality_scores(docs, one).collect())
    assert quality_classifier.quality_scores(docs.limit(0), none).count() == 0


def test_classifier_on_held_out_labels(spark):
    out = entry.queries()["op4_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    rows = out.collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_stages_keep_the_columns_and_only_remove(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        after = {r.doc_id for r in out.collect()}
        assert after <= before and len(after) > len(before) / 2, name
        docs, before = spark.createDataFrame(out.collect(), docs.schema), after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in last.collect()} == before
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_repeated_lines_and_documents_leave_the_pipeline(spark):
    rng = random.Random(5)
    text = lambda n: ". ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "theta"]) + rng.choice("abcdefgh") + rng.choice("stuvw") for _ in range(12)) for _ in range(n)) + "."
    a = text(12)
    near = a.replace(a.split()[5], "changed", 1)
    out = corpus_pipeline.near_duplicate_stage(spark, frame(spark, [a, near, text(12), None, ""]), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4]
