"""Queries over whole tables against brute force on small ones."""

from __future__ import annotations

import random
import re

import pytest

from corvane.operators import joins as J
from corvane.plans.registry import QUERIES


def words(text):
    return set(re.findall("[a-z]{3,}", text.lower()))


def test_self_jaccard_reads_long_documents(spark, tmp_path):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs = [(i, f"s{i % 3}", " ".join(rng.sample(pool, rng.choice([0, 20, 90, 150])))) for i in range(40)]
    docs += [(100 + i, f"s{(i + 1) % 3}", " ".join(rng.sample(docs[i][2].split(), len(docs[i][2].split()) * 4 // 5))) for i in range(1, 40, 2)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, s, x in docs:
        for k, r, y in docs:
            if i < k and s != r and words(x) and words(y) and (j := len(words(x) & words(y)) / len(words(x) | words(y))) >= 0.4:
                want[i, k] = j
    assert any(len(words(x)) > 40 for i, _, x in docs if any(i in k for k in want))
    got = {(r.a, r.b): r.j for r in QUERIES["join_self_jaccard"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)


def test_graph_queries_read_every_key(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("nation", [(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(k, k * 3 % 25) for k in range(1, 90)], "c_custkey long, c_nationkey int")
    write("supplier", [(k, k % 25) for k in range(1, 30)], "s_suppkey long, s_nationkey int")
    write("part", [(k, f"part {k}") for k in range(280, 420)], "p_partkey long, p_name string")
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    sub = {(f"g{i % 5}", f"n{i}", f"r{i % 5}") for i in range(25)}
    for k in range(1, 90):
        g = f"g{k * 3 % 25 % 5}"
        sub |= {(g, f"k{k}", f"n{k * 3 % 25}")} | ({(g, f"k{k}", f"k{k // 2}")} if k > 1 else set())
    closed = set(sub)
    while more := {(g, a, d) for g, a, b in closed for h, x, d in sub if g == h and b == x} - closed:
        closed |= more
    assert set(run("g_closure")) == closed
    both = sub | {(g, b, a) for g, a, b in sub}
    root = {(g, a): a for g, a, _ in both}
    for _ in range(len(root)):
        after = {(g, a): min([root[g, a], *[root[g, y] for h, x, y in both if (h, x) == (g, a)]]) for g, a in root}
        if after == root:
            break
        root = after
    assert set(run("g_components")) == {(g, a, r) for (g, a), r in root.items()}
    lifted = {(g, p) for g, _, p, _ in run("g_lift")}
    assert {(f"g{k % 25 % 5}", f"p{k}") for k in range(280, 420)} <= lifted
    assert len(run("g_match_props")) >= 140
    assert {r[1] for r in run("g_superprops")} == {f"p{k}" for k in range(280, 420) if k % 2 == 0}


def test_sev_status_of_every_document(spark, tmp_path):
    texts = ["short", "@prefix : <http://e/> . :a :b :c .", "# nothing but a comment here", "no ontology at all but words"]
    spark.createDataFrame([(i, texts[i % 4]) for i in range(1, 24)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 5) for i in range(3)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    want = ["no_ontology", "parsed", "empty", "unparseable"]
    got = {r.k: r.status for r in QUERIES["parse_sev_status"](spark, str(tmp_path)).collect()}
    assert got == {str(i): want[i % 4] for i in range(1, 24)} | {f"g{i}": "parsed" for i in range(3)}


def test_judge_group_reads_all_events(spark, tmp_path):
    rows = [(1, 7, 2.0), (2, 7, 4.0), (3, 8, 5.0), (4, 9, None), (58, 8, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.n, r.mean_overall, r.sd_overall) for r in QUERIES["agg_judge_group"](spark, str(tmp_path)).collect()}
    assert got == {7: (2, 3.0, 1.414214), 8: (2, 5.0, 0.0), 9: (1, None, None)}


def test_faithfulness_scores_all_pairs(spark, tmp_path):
    docs = [(1, "en", "one two three four"), (2, "de", "eins zwei one"), (3, "fr", "a b"), (4, "es", "four five five six")]
    items = [(0, "one two"), (3, "four five six seven eight"), (9, "no")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.recall, r.covered, r.extra) for r in QUERIES["agg_faithfulness"](spark, str(tmp_path)).collect()}
    want = {}
    for d, _, x in docs:
        for k, y in items:
            w, q = words(x), words(y)
            want[d, k] = (round(len(w & q) / max(1, len(q)), 9), len(w & q) >= 0.4 * len(q), round(len(w - q) / max(1, len(w)), 9))
    assert got == want


def test_best_worst_ties_take_the_first_key(spark, tmp_path):
    parts = [(k + 100000 * i, f"b{k % 3}", float(k % 2)) for i in range(4) for k in range(12)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_brand: (r.best, r.worst) for r in QUERIES["win_best_worst"](spark, str(tmp_path)).collect()}
    value = lambda p: p[2] * 100000 + p[0] % 100000
    want = {b: (max((p for p in parts if p[1] == b), key=value)[0], min((p for p in parts if p[1] == b), key=value)[0]) for b in ("b0", "b1", "b2")}
    assert got == want


def test_faithfulness_shuffles_no_pairs(spark, tmp_path):
    """Pairs are made by the last join and go nowhere after it: documents and words are shuffled, never by document and item."""
    spark.createDataFrame([(i, f"some text about thing{chr(97 + i)} and wine") for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "what wine about") for i in range(3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["agg_faithfulness"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, item_id", plan)
    assert {(r.recall, r.covered) for r in out.collect()} == {(round(2 / 3, 9), True)} and out.count() == 15


def test_best_worst_leaves_out_parts_without_a_price(spark, tmp_path):
    parts = [(5, "a", None), (6, "a", 2.0), (7, "a", 1.0), (8, "b", None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_brand: (r.best, r.worst) for r in QUERIES["win_best_worst"](spark, str(tmp_path)).collect()}
    assert got == {"a": (6, 7), "b": (None, None)}


def test_self_jaccard_verifies_pairs_in_turns(spark, tmp_path, monkeypatch):
    """No turn verifies many more pairs than there are documents, and all turns together give every pair."""
    n, turns = 60, []
    spark.createDataFrame([(i, f"s{i}", "one and the same text") for i in range(n)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = J.materialize

    def noted(df, *args):
        out = before(df, *args)
        if out.columns == ["a", "b", "j"]:
            turns.append(out.count())
        return out

    monkeypatch.setattr(J, "materialize", noted)
    got = [(r.a, r.b) for r in QUERIES["join_self_jaccard"](spark, str(tmp_path)).collect()]
    assert len(got) == n * (n - 1) // 2 and set(got) == {(a, b) for a in range(n) for b in range(a + 1, n)}
    assert sum(turns) == len(got) and max(turns) <= 4 * n
