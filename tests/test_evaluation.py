"""Evaluation end to end, injected models and audits."""

from __future__ import annotations

import random

import pytest

from corvane.operators import audits as A
from corvane.operators import evaluation as E
from corvane.operators.sev import RELATIONS, SLOTS

HEAD = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . "
FULL = HEAD + " ".join(f":C{i} a owl:Class ; rdfs:subClassOf :C{i + 1} ." for i in range(5)) + " :p a owl:ObjectProperty ; rdfs:domain :C1 ; rdfs:range :C2 ."


def test_every_artefact_keeps_its_row(spark):
    texts = {"full": FULL, "clash": FULL + " :C1 owl:disjointWith :C2 . :x a :C1 , :C2 .", "stub": HEAD + ":A a owl:Class ; rdfs:subClassOf :B .", "silent": HEAD + "# nothing more is said", "prose": "I am sorry, but I cannot do that today.", "blank": ""}
    got = {r.graph_id: r for r in E.evaluate(spark.createDataFrame(list(texts.items()), "graph_id string, text string")).collect()}
    assert {k: (r.gate, r.score) for k, r in got.items()} == {"full": ("ok", 1.0), "clash": ("ok", 0.0), "stub": ("near_empty", 0.5), "silent": ("empty", 0.0), "prose": ("unparseable", 0.0), "blank": ("unparseable", 0.0)}
    assert got["clash"].consistent is False and got["prose"].consistent is None and got["silent"].vacuous


def test_sections_that_are_given_enter_the_record(spark):
    texts = spark.createDataFrame([("full", FULL), ("prose", "I am sorry, but I cannot do that today.")], "graph_id string, text string")
    pitfalls = spark.createDataFrame([("full", "P01", "Important"), ("full", "P02", "Minor"), ("full", "P03", "Critical")], "report string, code string, importance string")
    slots = [("A", "class", ["C 1"], []), ("B", "class", ["C 2"], [])]
    signatures = spark.createDataFrame([(g, "q", "?", "structural", "authored", slots, [("A", "B", ["p"])]) for g in ("full", "prose")], f"graph_id string, cq_id string, cq string, cq_type string, source string, slots {SLOTS}, relations {RELATIONS}")
    got = {r.graph_id: r for r in E.evaluate(texts, pitfalls=pitfalls, signatures=signatures).collect()}
    assert (got["full"].pitfalls_total, got["full"].pitfalls_important, got["full"].pitfalls_critical, got["full"].pitfalls_minor) == (2, 1, 1, 1)
    assert (got["full"].cqs_total, got["full"].cqs_passed, got["full"].sev_score) == (1, 1, 1.0) and abs(got["full"].score - 2 / 3) < 1e-9
    assert (got["prose"].cqs_passed, got["prose"].sev_score, got["prose"].score, got["prose"].pitfalls_total) == (0, 0.0, 0.0, None)


def test_a_section_that_fails_leaves_the_others(spark):
    texts = spark.createDataFrame([("full", FULL), ("gone", None)], "graph_id string, text string")
    broken = spark.createDataFrame([(1,)], "nothing int")
    got = {r.graph_id: r for r in E.evaluate(texts, pitfalls=broken, signatures=broken).collect()}
    assert set(got["full"].errors) == {"oops", "cq"} and "nothing" in got["full"].errors["oops"]
    assert (got["full"].score, got["full"].consistent, got["full"].pitfalls_total, got["full"].sev_score) == (1.0, True, None, None) and got["full"].inferred_triples > 0
    assert (got["gone"].status, got["gone"].note, got["gone"].score) == ("missing", "not found", 0.0)


def test_a_question_of_another_scenario_stops_the_run(spark):
    texts = spark.createDataFrame([("full", FULL)], "graph_id string, text string")
    slots = [("A", "class", ["C 1"], [])]
    signatures = spark.createDataFrame([("full", "q", "mine?", "structural", "authored", slots, [("A", "literal", ["p"])]), ("full", "r", "foreign?", "structural", "authored", slots, [("A", "literal", ["p"])])], f"graph_id string, cq_id string, cq string, cq_type string, source string, slots {SLOTS}, relations {RELATIONS}")
    with pytest.raises(E.Contaminated, match="foreign"):
        E.evaluate(texts, signatures=signatures, authentic=spark.createDataFrame([("mine?",)], "cq string"))
    assert E.evaluate(texts, signatures=signatures, authentic=signatures.select("cq")).first().cqs_total == 2


def test_pairs_are_judged_in_both_orders(spark):
    def judge(prompt):
        if "boom" in prompt:
            raise RuntimeError("no service")
        first = prompt.split("\n---\n")[0]
        return ('{"a_q": "9", "b_q": "3"}' if first == "good" else '{"a_q": 5, "b_q": 7}'), "stop"

    pairs = spark.createDataFrame([("k", "good", "bad"), ("e", "boom", "x")], "id string, a string, b string")
    got = {r.id: (r.first_q, r.second_q) for r in E.judge_pairs(pairs, "id", "a", "b", judge, ["q"]).collect()}
    assert got == {"k": (8.0, 4.0), "e": (0.0, 0.0)}


WORDS = {1: ["ship", "port", "cargo", "route", "class"], 2: ["poem", "author", "verse", "rhyme"], 3: ["gene", "cell", "organ", "tissue", "enzyme"]}


def test_audit_of_misplaced_questions(spark):
    contexts = spark.createDataFrame(list(WORDS.items()), "scenario int, words array<string>")
    rows = [
        (1, 0, "a", ["ship", "port", "cargo"], False), (1, 1, "b", ["poem", "author", "verse"], False), (1, 2, None, [], False), (2, 0, "c", ["verse", "rhyme", "output"], True), (1, 3, "a", ["ship", "port", "cargo"], False),
        (1, 4, "d", ["class", "robot", "arm", "wheel"], False), (1, 5, "e", ["robot", "leg", "ship", "axle", "gear"], False), (3, 0, "f", ["gene", "cell", "organ"], False), (3, 1, "g", ["gene", "tissue"], False), (3, 2, "h", ["gene", "enzyme", "cell"], False), (3, 3, "i", ["gene", "organ", "fin"], False), (2, 1, "j", [], False),
        (2, 2, "k", ["poem", "author", "verse"], False),
    ]
    questions = spark.createDataFrame(rows, "scenario int, idx int, key string, words array<string>, boilerplate boolean")
    got = {(r.scenario, r.idx): r for r in A.verdicts(questions, contexts).collect()}
    verdict = lambda *k: got[k].verdict
    assert verdict(1, 0) == "clean" and verdict(1, 1) == "misfiled" and verdict(1, 2) == "malformed" and verdict(2, 0) == "suspicious"
    assert verdict(1, 3) == "suspicious" and got[1, 3].within and verdict(2, 1) == "suspicious" and got[2, 1].weak_anchor
    assert got[1, 4].generic_only and got[1, 4].island == 2 and got[1, 5].island == 2 and verdict(1, 4) == "suspicious"  # agree on robots
    assert got[1, 1].across and got[2, 2].across
    assert [got[3, i].siblings for i in range(4)] == [3, 3, 3, 3] and got[1, 0].siblings == 1 and got[1, 1].siblings == 0
    # 0.5 * (1 - 0.2) for the share, 0.15 for the island, less 0.05 twice for two well-anchored questions on ships
    assert got[1, 5].suspicion == 0.45 and got[3, 0].suspicion == 0.0


def test_injected_questions_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [w for ws in WORDS.values() for w in ws] + ["stray", "odd", "alien"]
    rows = [(s, i, f"t{s}{i}", rng.sample(WORDS[s], 3) + rng.sample(pool, rng.randint(0, 3)), rng.random() < 0.1) for s in WORDS for i in range(8)] + [(2, 20, "x", ["gene"], False)]
    rows = [(s, i, k, list(dict.fromkeys(w)), b) for s, i, k, w, b in rows]
    share = lambda w, s: round(len(set(w) & set(WORDS[s])) / len(w), 3)

    def misfiled(w, bad, s):
        home, best = share(w, s), max(share(w, t) for t in WORDS if t != s)
        return len(w) >= 3 and not bad and (home == 0 or round(best - home, 3) >= 0.34 and best >= 0.30 and home <= 0.60)

    able = [r for r in rows if len(r[3]) >= 3]
    caught = [misfiled(w, b, t) for s, _, _, w, b in able for t in WORDS if t != s]
    native = sum(misfiled(w, b, s) for s, _, _, w, b in rows)
    rounds = max(sum(r[0] != t for r in able) for t in WORDS)
    r = A.injection_recall(spark.createDataFrame(rows, "scenario int, idx int, key string, words array<string>, boilerplate boolean"), spark.createDataFrame(list(WORDS.items()), "scenario int, words array<string>")).first()
    assert (r.injections, r.tp, r.fn, r.fp, r.native) == (len(caught), sum(caught), len(caught) - sum(caught), native * rounds, native)
    assert r.recall == round(sum(caught) / len(caught), 4)
    home = [(s, i, k, WORDS[s][:4], False) for s, i, k, _, _ in able]  # questions that are at home reach the contract
    r = A.injection_recall(spark.createDataFrame(home, "scenario int, idx int, key string, words array<string>, boilerplate boolean"), spark.createDataFrame(list(WORDS.items()), "scenario int, words array<string>")).first()
    assert r.recall >= 0.8 and r.precision >= 0.8 and r.native_rate <= 0.02


def test_words_of_questions_stay_where_they_are(spark):
    """Whatever the size of the questions, the counted vocabulary is what is sent; a table read from files was sent by its size before."""
    q = spark.createDataFrame([(0, 1, "k", ["a", "b", "c"], False)], "scenario int, idx int, key string, words array<string>, boilerplate boolean")
    v = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "scenario int, words array<string>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.support(q, v)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.context, round(r.share, 3)) for r in A.support(q, v).collect()) == [(0, 0.667), (1, 0.333)]
