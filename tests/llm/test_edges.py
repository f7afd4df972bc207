"""Repeated rows, missing ids, very long texts, clashing columns and empty tables, for operators whose other tests leave them out."""

from __future__ import annotations

import datetime as dt
import zlib

import pytest

from corvane.llm import byte_bpe, decontaminate, license_scan, pii, quality_classifier, url_filter
from corvane.llm.line_dedup import MOST_LINES, line_dedup


def rows(spark, texts, ids=None, more="__x string, score string, licenses string"):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "clash", "clash", "clash") for i, t in enumerate(texts)], f"doc_id long, text string, {more}")


LONG = "plain words of a very long text. " * 60_000


def test_classifier_keeps_columns_and_repeated_rows(spark):
    texts = ["good words make a good text. " * 30, "### $$$ ||| " * 40, LONG, None, "good words make a good text. " * 30, ""]
    docs = rows(spark, texts, [1, 2, 3, 4, 1, None])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (2, 0)], "doc_id long, quality int")
    out = quality_classifier.quality_scores(docs, labels).collect()
    assert len(out) == 6 and set(docs.columns) <= set(out[0].asDict())
    one = [r["__cv_score"] for r in out if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1] and all(0 <= r["__cv_score"] <= 1 and r.score == "clash" for r in out)


def test_held_out_labels_are_never_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    score = lambda ls: {r.doc_id: r["__cv_score"] for r in quality_classifier.quality_scores(docs, spark.createDataFrame(ls, "doc_id long, quality int"), keep=["doc_id"]).collect()}
    true = score([(r.doc_id, r.quality) for r in labels])
    turned = score([(r.doc_id, 1 - r.quality if held(r.doc_id) and r.quality is not None else r.quality) for r in labels])
    assert true == turned and any(held(r.doc_id) for r in labels)


def test_license_scan_of_long_and_repeated_texts_and_missing_ids(spark):
    mit = license_scan.TEMPLATES["MIT-full"]
    texts = [LONG + mit + LONG, mit, mit, mit.upper(), LONG, None]
    out = license_scan.license_scan(rows(spark, texts, [1, 2, 2, None, 3, None])).collect()
    assert len(out) == 6 and out[0].licenses == "clash"
    found = [sorted(x.license for x in r["__cv_licenses"]) for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None))]
    assert found == [["MIT-full", "MIT-text"]] * 3 + [[], ["MIT-full", "MIT-text"], []]


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_every_template_finds_itself(name):
    assert len(license_scan._distinct_shingles(license_scan.TEMPLATES[name])) >= 1


def test_templates_are_found_whole_and_nearly_whole(spark):
    texts, want = [], []
    for name, t in sorted(license_scan.TEMPLATES.items()):
        texts.append(f"Some words before it. {t} And some after.")
        want.append(name)
    out = {r.doc_id: {x.license: x.containment for x in r["__cv_licenses"]} for r in license_scan.license_scan(rows(spark, texts)).collect()}
    assert all(out[i][name] == 1.0 for i, name in enumerate(want))


def test_url_filter_of_long_urls_and_clashing_columns(spark):
    day = dt.date(2024, 1, 5)
    events = spark.createDataFrame([("bad.org", "spam", "add", dt.date(2024, 1, 1))], "pattern string, category string, action string, day date")
    urls = ["http://bad.org/" + "a/" * 100_000, "http://" + "x." * 50_000 + "bad.org/", "http://" + "y" * 300_000, "", None]
    caps = spark.createDataFrame([(i, u, day, "clash", "clash", "clash") for i, u in enumerate(urls)], "id int, url string, day date, pattern string, category string, host string")
    out = {r.id: r for r in url_filter.url_filter(caps, events).collect()}
    assert len(out) == 5 and [out[i]["__cv_n_active"] > 0 for i in (0, 2, 3, 4)] == [True, False, False, False] and out[0].pattern == "clash"


def test_personal_data_of_repeated_rows_and_missing_ids(spark):
    texts = ["mail a@b.co now", "mail a@b.co now", "mail a@b.co now", None, LONG + "a@b.co"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip([1, 1, None, None, 2], texts, strict=True)], "doc_id long, text string, spans string, start int")
    out = pii.personal_data(docs).collect()
    assert sorted([(s.kind, s.start, s.end) for s in r["__cv_spans"]] for r in out) == [[], [("email", 5, 11)], [("email", 5, 11)], [("email", 5, 11)], [("email", len(LONG), len(LONG) + 6)]]
    assert all(r.spans == "clash" for r in out) and pii.personal_data(docs.limit(0)).count() == 0


def test_encoding_of_repeated_rows_and_empty_tables(spark):
    ranks = byte_bpe.default_ranks()
    docs = spark.createDataFrame([(1, "two words", "clash"), (1, "two words", "clash"), (None, "two words", "clash"), (3, None, "clash")], "doc_id long, text string, ids string")
    df = byte_bpe.encode(docs, ranks)
    out = df.collect()
    ids = [list(r["__cv_ids"]) for r in out if r.text]
    assert len(out) == 4 and ids[0] == ids[1] == ids[2] != [] and all(r.ids == "clash" for r in out)
    assert byte_bpe.encode(docs.limit(0), ranks).count() == 0 and byte_bpe.decode(df.limit(0), ranks).count() == 0


def test_line_dedup_beyond_the_broadcast_bound(spark, monkeypatch):
    """A shuffle join gives what the broadcast gives."""
    from corvane.llm import line_dedup as module

    texts = [f"a{i % 3}\nb\nc\nown {i}" for i in range(30)] + [None, ""]
    docs = rows(spark, texts)
    small = sorted((r.doc_id, r.text) for r in line_dedup(docs).collect() if r.text is not None)
    monkeypatch.setattr(module, "MOST_LINES", 3)
    assert MOST_LINES > 3 and sorted((r.doc_id, r.text) for r in line_dedup(docs).collect() if r.text is not None) == small


def test_decontamination_of_long_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = rows(spark, [LONG + item, item, LONG], [1, 1, None])
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()
    assert sorted((r["__cv_n_hit"], r["__cv_items"]) for r in out) == [(0, []), (14, [7]), (14, [7])]
