"""Replies: repair, recovery, signatures; readers and writers; streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import replies as Y
from corvane.functions import text as X
from corvane.operators import graph as G
from corvane.plans.registry import QUERIES
from corvane.sources import files
from corvane.streaming import incremental


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def test_repairs(spark):
    bad = "@prefix : <http://e/> .\n; :Heading text\n:A a :owl:Class ;\n  :p :q\n  ; has_method :m .\n:B a owl:Class ;\n  :cut"
    good = ":A a owl:Class .\n"
    out = {r.i: r for r in Y.repaired(rows(spark, [bad, good, "", "no end"]), "t").collect()}
    assert out[0].fixed == "@prefix : <http://e/> .\n# :Heading text\n:A a owl:Class ;\n  :p :q\n  ; :has_method :m ."
    assert out[0].repairs == [Y.QNAMES, Y.HEADING, Y.BARE, Y.DROPPED]
    assert out[1].repairs == [] and out[2].fixed == "" and out[3].fixed == "no end"


TTL = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n:A a owl:Class ."
TABLE = "| question | axiom |\n" + "| what | :A a owl:Class and much more of it |\n" * 5


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        (f"Sure.\n```turtle\n{TTL}\n```\nDone.", TTL),
        (f"It is wrapped in ```turtle ... ``` as asked.\n```turtle\n{TTL}\n```", TTL),  # the echoed instruction
        (f"```turtle\n@prefix : <http://e/> .\n# only this\n```\n```turtle\n{TTL}\n```", TTL),
        (f"```turtle\n{TTL}\n```\n```\n{TABLE}```", TTL),
        (f"```\n{TABLE}```\n```ttl\n{TTL}\n```", TTL),
        ("```turtle\n@prefix : <http://e/> .\n```", "@prefix : <http://e/> ."),  # directives only, and nothing else
        (f"```python\n{TTL}\n```", TTL),  # another name
        (f"```python\n{TTL} # longer\n```\n```text\n{TTL}\n```", TTL),
        (f"```turtle\n{TTL}\n:B a owl:Cl", TTL + "\n:B a owl:Cl"),  # open
        (":Foo a owl:Class .\n:Bar a owl:Class .", ":Foo a owl:Class .\n:Bar a owl:Class ."),
        ("The answer:\n  <http://e/a> a <http://e/B> .\nThat is all.", "<http://e/a> a <http://e/B> .\nThat is all."),
        (f"Here it is:\n{TTL}\n```", TTL),
        (f"```sparql\nASK {{ ?x ?p ?y }}\n```\n{TTL}", TTL),
        ("- :Foo is a class\n- :Bar is another", None),
        ("```\n...\n```", None),
        ("Sorry, I cannot.", None),
        ("", None),
        (None, None),
    ],
)
def test_extraction(spark, reply, want):
    assert rows(spark, [reply]).select(X.extracted_turtle(F.col("t")).alias("x")).first().x == want


def test_recovery_accepts_only_what_stands_in_a_closed_block(spark):
    cut = f'```turtle\n{TTL}\n:B :says "stops here.\nand"; :p "cut'
    texts = [
        f"```turtle\n{TTL}\n```", f"```\n{TABLE}```\n```ttl\n{TTL}\n```", cut, "Sorry.", " ", f"{TTL}\nbare, and no fence", f"```turtle\n{TTL[:-1]};\n  :p :q\n  ; has_method :m .\n```",
        "```turtle\n@prefix : <x> .\n```", f"```turtle\n{TTL}\n``` and ```turtle\n{TTL} :cut", None, f"```turtle\n{TTL}\n:A nonsense .\n```",
    ]
    df = rows(spark, texts)
    got = {r.i: r for r in Y.recovered(df, "i", "t").collect()}
    assert (got[0].text, got[0].extractor, got[0].n_triples, got[0].reason) == (TTL, "extracted", 1, None)
    assert got[1].text == TTL and got[6].repaired and got[6].n_triples == 3 and got[6].text == TTL[:-1] + ";\n  :p :q\n  ; :has_method :m ."
    assert [got[i].reason for i in (2, 3, 4, 7, 9, 10)] == [Y.UNTERMINATED, Y.NO_TURTLE, Y.NO_TEXT, Y.TOO_SHORT, Y.NO_REPLY, Y.UNPARSEABLE]
    assert got[8].text == TTL  # the closed block and not the tail
    assert got[5].text == TTL and got[5].repaired  # bare Turtle with words after it
    assert got[8].extractor == "extracted"
    part = {r.i: r for r in Y.recovered(df, "i", "t", truncated=True).collect()}
    assert (part[2].text, part[2].partial, part[2].extractor, part[2].n_triples) == (TTL, True, "open_tail", 1) and part[2].dropped_bytes > 20
    stored = spark.createDataFrame([(part[2].text, True), (TTL, False), ("# " + Y.CUT_SHORT[0] + "\n" + TTL, True)], "t string, p boolean").select(Y.stored_text(F.col("t"), F.col("p")).alias("s")).collect()
    assert [r.s.startswith("# " + Y.CUT_SHORT[0]) for r in stored] == [True, False, True] and stored[2].s.count(Y.CUT_SHORT[0]) == 1
    why = [r.d for r in df.orderBy("i").select(Y.diagnosis(F.col("t")).alias("d")).collect()]
    assert why == [Y.UNPARSEABLE, Y.UNPARSEABLE, Y.UNTERMINATED, Y.NO_TURTLE, Y.NO_TEXT, Y.NOT_FENCED, Y.UNPARSEABLE, Y.UNPARSEABLE, Y.UNPARSEABLE, Y.NO_REPLY, Y.UNPARSEABLE]


def test_decisions_about_stored_artefacts(spark):
    rows_ = [("ok", 100, None, None), ("missing", 0, TTL, None), ("too_small", 3, None, Y.NO_TURTLE), ("unparseable", 9, TTL, None), ("unparseable", 9000, TTL, None), ("unparseable", 90, None, Y.UNPARSEABLE)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "i int, state string, size int, found string, reason string").orderBy("i")
    got = [(r.d.status, r.d.reason) for r in df.select(Y.decided(*[F.col(k) for k in ("state", "size", "found", "reason")]).alias("d")).collect()]
    assert got == [("healthy", None), ("recovered", None), ("unrecoverable", Y.NO_TURTLE), ("recovered", None), ("unrecoverable", Y.NOT_BETTER), ("skipped_unparseable", Y.UNPARSEABLE)]


def test_signature(spark):
    s = rows(spark, ["Which sensors are used in the observation of a ship?", "How many ships are registered?", "Can the ontology represent delay?", ""]).orderBy("i").select(Y.signature(F.col("t")).alias("s")).collect()
    assert s[0].s.kind == "structural" and s[0].s.subject == ["observation", "ship", "observation ship"] and s[0].s.relation == ["sensors"]
    assert s[1].s.kind == "data_dependent" and s[2].s.kind == "meta" and s[3].s.subject == ["thing"]


def test_normal_forms(spark):
    r = rows(spark, ["  What   IS `this` ?! "]).select(*[X.norm_question(F.col("t"), k).alias(k) for k in ("guard", "audit", "key")]).first()
    assert (r.guard, r.audit, r.key) == ("what is `this`", "what is this", "what is this")


def test_sinks_refuse_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", "c", 1), ("m", "d", None)], "model string, config string, v int")
    files.write_records(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="exist"):
        files.write_records(df, f"{tmp_path}/out")
    with pytest.raises(ValueError, match="evidence"):
        files.write_csv(df, f"{tmp_path}/kept/x", ["v"], kept=[f"{tmp_path}/kept"])
    files.write_csv(df, f"{tmp_path}/csv", ["model", "v", "gone"])
    assert sorted(map(tuple, files.csv_table(spark, f"{tmp_path}/csv", ["model", "v", "gone"]).collect())) == [("m", "", ""), ("m", "1", "")]
    assert files.rendered_table(df.limit(1)).splitlines()[0] == "| model | config | v |" and r"\begin{tabular}" in files.rendered_table(df, "latex")
    with pytest.raises(ValueError, match="duplicate"):
        files.unique_records(df, ["model"])


def test_stream_upserts(spark, tmp_path):
    for n, part in enumerate([[(1, "a"), (2, "b")], [(2, "B"), (3, "c")]]):
        spark.createDataFrame(part, "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = incremental.upsert_stream(spark, f"{tmp_path}/in", "k int, v string", f"{tmp_path}/table", ["k"], f"{tmp_path}/cp")
        q.awaitTermination(60)
        assert n < 2
    got = {(r.k, r.v, r.record_origin) for r in spark.read.parquet(f"{tmp_path}/table/v=1").collect()}
    assert got == {(1, "a", "carried_over"), (2, "B", "this_run"), (3, "c", "this_run")}


def test_records_of_every_kind_keep_their_file(spark, tmp_path):
    def put(path, text):
        p = tmp_path / "r" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    good = '{"id": "%s", "model": "m", "config": "c", "oops": {"pitfalls_total": 2}, "other": [1]}'
    put("m/c/a.json", good % "a")
    put("m/c/b.json", good % "b")
    put("m/c/number.json", '{"id": 5, "model": "m", "config": "c", "oops": {}}')
    put("m/c/plain.json", '{"id": "p", "model": "m", "config": "c"}')
    put("m/c/list.json", "[1]")
    put("m/c/broken.json", '{"id": "a", ')
    put("m/c/empty.json", "")
    put("m/c/run_manifest.json", '{"files": 3}')
    put("x/deep/down/in/a.json", '{"id": "z", "model": "m", "config": "c", "error": "gone"}')
    put("m/c/notes.txt", "no record")
    r = files.record_files(spark, f"{tmp_path}/r")
    state = {r_.rel_path.rsplit("/", 1)[1] + ("!" if "deep" in r_.rel_path else ""): r_.state for r_ in r.collect()}
    assert state == {"a.json": "record", "b.json": "record", "a.json!": "record", "number.json": "foreign", "plain.json": "foreign", "list.json": "foreign", "broken.json": "corrupt", "empty.json": "corrupt", "run_manifest.json": "foreign"} or state.pop("empty.json", None) is None
    assert {x.id: x.record.oops.pitfalls_total for x in files.loaded_records(r).filter("record.oops is not null").collect()} == {"a": 2, "b": 2}
    put("m/d/again.json", good % "b")
    with pytest.raises(ValueError, match=r"\('m', 'c', 'b'\).*b\.json and .*again\.json|\('m', 'c', 'b'\).*again\.json and .*b\.json"):
        files.loaded_records(files.record_files(spark, f"{tmp_path}/r"))
    done = spark.createDataFrame([("m", "c", "a")], "model string, config string, id string")
    old = {x.rel_path.rsplit("/", 1)[1]: (x.model, x.config, x.id, x.record_origin) for x in files.existing_records(spark, f"{tmp_path}/r", done).collect()}
    assert old["number.json"] == ("m", "c", "number", "carried_over") and old["plain.json"][2] == "p" and "a.json" not in old and "run_manifest.json" not in old
    assert old["broken.json"][3] is None and old["list.json"][3] is None and old["again.json"] == ("m", "c", "b", "carried_over")


def test_a_batch_that_fails_is_played_again(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a")], "k int, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    whole = incremental.upsert
    run = lambda: incremental.upsert_stream(spark, f"{tmp_path}/in", "k int, v string", f"{tmp_path}/table", ["k"], f"{tmp_path}/cp")

    def fails(*args):
        whole(*args)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(incremental, "upsert", fails)
    with pytest.raises(Exception, match="lost after the write"):
        run().awaitTermination(60)
    monkeypatch.setattr(incremental, "upsert", whole)
    q = run()
    q.awaitTermination(60)
    assert incremental.last_version(q) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/table/v=0").collect()] == [(1, "a", "this_run")]
    q = run()
    q.awaitTermination(60)
    assert incremental.last_version(q) == -1


def test_closure_and_strong_components(spark):
    e = spark.createDataFrame([("g", "a", "p", "x"), ("g", "x", "q", "b"), ("g", "c", "p", G.ANY), ("g", "x", "p", "y"), ("g", "y", "p", "d")], "graph_id string, a string, p string, b string")
    assert G.transitive_closure(e.select("graph_id", "a", "b")).filter("a = 'a'").count() == 4
    assert {r.root for r in G.strong_components(spark.createDataFrame([("g", "m", "n"), ("g", "n", "m"), ("g", "n", "o")], "graph_id string, a string, b string")).collect()} == {"m", "o"}


def test_fallback_extract_tries_replies_and_texts(spark, tmp_path):
    """A closed block, an open one up to its last whole statement, and the turn's own text, which holds Turtle here."""
    turtle = "```turtle\n@prefix : <http://example.org/of/this/test/> .\n:a a :B .\n:b a :B .\n```"
    rows = [(1, t, "user", turtle if t == 2 else "prose") for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.found, r.rank) for r in QUERIES["str_fallback_extract"](spark, str(tmp_path)).collect()}
    assert got == {0: (True, 0), 1: (True, 1), 2: (True, 0), 3: (True, 0), 4: (True, 1), 5: (False, None)}


def test_signature_works_each_part_out_once(spark):
    """Words of the body, the head and the tail: three places of the plan at most, whatever uses them."""
    x = spark.range(1).select(F.lit("Which wines are produced in the region of France?").alias("t")).repartition(1).select(Y.signature(F.col("t")).alias("s")).select("s.kind", "s.subject", "s.relation")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all") <= 3
    assert x.first().subject == ["region", "france", "region france"]
