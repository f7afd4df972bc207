"""The whole pipeline against brute force, stage after stage on what the stage before kept."""

from __future__ import annotations

import pytest
from test_jaccard_join import brute as brute_components
from test_table_operators import brute_lines
from test_text_operators import base, brute9

import corpus_pipeline
from corvane.llm.byte_bpe import default_ranks

DIR = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]

    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, DIR).collect()}
    for d, t in rows:  # the estimate decides about the rest
        n, _, symbols, _, repeat = base(t)
        if n < 50 or 100 * repeat > 50 * n or symbols * 3 > n:
            assert d not in kept
    rows = [(d, t) for d, t in rows if d in kept]
    assert len(rows) > 100

    texts, _ = brute_lines([t for _, t in rows])
    rows = [(d, t) for (d, _), t in zip(rows, texts, strict=True)]
    alone = [i == root for i, _, root in brute_components([t for _, t in rows], 5, 80)]
    rows = [r for r, a in zip(rows, alone, strict=True) if a]
    clean = []
    for d, t in rows:
        n, hit, _ = brute9(t, bench)
        if not (hit and 20 * hit >= n):
            clean.append((d, t))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=default_ranks(), special_tokens={})
    want = [(d, len(ids := enc.encode_ordinary(t)), ids) for d, t in clean]
    got = sorted((r.doc_id, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == want
