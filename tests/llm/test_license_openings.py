"""Notices of one shingle that open a text lie in two windows, as those inside it."""

from __future__ import annotations

from corvane.llm import license_scan as L


def test_opening_notices_have_two_windows(spark, monkeypatch):
    one = L._constants()[:1]
    monkeypatch.setattr(L, "_constants", lambda: one)  # a single band: found at random, at 1/4 by one window of four
    notices = {f"t{i}": f"alpha{i} beta{i} gamma{i} delta{i} end{i}" for i in range(300)}
    docs = spark.createDataFrame([(i, f"{t} " + " ".join(f"w{i}x{j}" for j in range(30))) for i, t in enumerate(notices.values())], "doc_id long, text string")
    found = {r.doc_id for r in L.retrieve(docs, L.templates_table(spark, notices)).collect()}
    assert len(found) > 0.4 * len(notices)
