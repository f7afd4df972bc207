"""TriG, N3 and JSON-LD, the order in which syntaxes are tried, and texts that break off."""

from __future__ import annotations

import json
import random

import pytest

from corvane.sources import rdf

P = "@prefix : <http://e/> . "
T = rdf.RDF + "type"


def short(rows):
    return sorted((s, p, o) if k != "literal" else (s, p, '"' + o) for s, _, p, o, k, *_ in rows)


def test_trig_takes_the_triples_of_all_graphs():
    text = P + ":g1 { :a :p :b . :b :p [ :q 1 ] } GRAPH :g2 { :c a :D } { :x :y \"z\" . } :s :t :u ."
    got = short(rdf.parse_trig(text, "g"))
    assert ("http://e/a", "http://e/p", "http://e/b") in got and ("http://e/c", T, "http://e/D") in got and ("http://e/x", "http://e/y", '"z') in got and ("http://e/s", "http://e/t", "http://e/u") in got
    assert len(got) == 6
    with pytest.raises(rdf.ParseError):
        rdf.parse_turtle(text)
    assert rdf.parse_any(text, "", "sniff")[0] == "parsed" and rdf.parse_any(text, "", "ladder")[0] == "unparseable"


def test_n3_formulas_are_read_and_not_asserted():
    text = P + "{ ?x :p ?y . ?y :q :z } => { ?x :r :z } . :a = :b . :c :p { :d :e :f } ."
    got = rdf.parse_n3(text, "g")
    assert {p for _, _, p, *_ in got} == {rdf.SIGNS["mark", "=>"], rdf.OWL + "sameAs", "http://e/p"} and len(got) == 3
    assert rdf.parse_any(text, "", "sniff") [0] == "parsed"


def test_jsonld():
    doc = {
        "@context": {"@vocab": "http://v/", "ex": "http://e/", "name": {"@id": "ex:name", "@language": "en"}, "knows": {"@id": "ex:knows", "@type": "@id"}, "order": {"@id": "ex:order", "@container": "@list"}, "born": {"@id": "ex:born", "@type": "http://x/date"}, "child": {"@reverse": "ex:parent"}, "label": {"@id": "ex:label", "@container": "@language"}, "gone": None},
        "@graph": [
            {"@id": "ex:a", "@type": ["Person", "ex:Other"], "name": "Ann", "knows": ["ex:b", "_:n1"], "order": [1, "two", {"@id": "ex:c"}], "born": "2000", "gone": "x", "child": {"@id": "ex:kid"}},
            {"@id": "_:n1", "age": 3.5, "ok": True, "label": {"en": "x", "de": ["y"]}, "plain": {"@value": "v", "@type": "ex:t"}, "nested": {"inner": {"@set": [1, 2]}}, "none": None, "empty": {"@list": []}},
        ],
    }
    rows = rdf.parse_jsonld(json.dumps(doc), "g")
    got = short(rows)
    e = "http://e/"
    for t in [(e + "a", T, "http://v/Person"), (e + "a", T, e + "Other"), (e + "a", e + "name", '"Ann'), (e + "a", e + "knows", e + "b"), (e + "a", e + "knows", "_:g/nn1"), (e + "a", e + "born", '"2000'), (e + "kid", e + "parent", e + "a"), ("_:g/nn1", "http://v/age", '"3.5'), ("_:g/nn1", "http://v/ok", '"true'), ("_:g/nn1", e + "label", '"y'), ("_:g/nn1", "http://v/empty", rdf.RDF + "nil")]:
        assert t in got, t
    assert {(o, d, lang) for _, _, p, o, _, d, lang in rows if p == e + "name"} == {("Ann", rdf.RDF + "langString", "en")}
    assert [(o, d) for _, _, p, o, _, d, _ in rows if p.endswith("plain")] == [("v", e + "t")]
    firsts = [o for _, _, p, o, *_ in rows if p == rdf.RDF + "first"]
    assert sorted(firsts) == ["1", e + "c", "two"] and not any(p.endswith("gone") for _, _, p, *_ in rows)
    assert rdf.parse_any(json.dumps(doc), "", "sniff")[0] == "parsed"
    for bad in ('{"@context": "http://elsewhere/", "a": 1}', "[1, 2", '{"@context": {"a": "b", "b": "a"}, "a": 1}', '"text"'):
        assert rdf.parse_any(bad, "", "sniff")[0] == "unparseable"
    assert rdf.parse_any("{}", "", "sniff")[0] == "empty" and rdf.parse_any("  \n", "", "sniff")[0] == "empty"


def test_six_syntaxes_have_a_status(spark):
    texts = {
        "turtle": P + ":a :b :c .", "nt": "<http://e/a> <http://e/b> <http://e/c> .", "xml": f'<rdf:RDF xmlns:rdf="{rdf.RDF}" xmlns:e="http://e/"><rdf:Description rdf:about="http://e/a"><e:b rdf:resource="http://e/c"/></rdf:Description></rdf:RDF>',
        "jsonld": '[{"@id": "http://e/a", "http://e/b": {"@id": "http://e/c"}}]', "trig": P + ":g { :a :b :c }", "n3": P + ":a :b :c . :a = :a .", "none": "just some words", "empty": "# nothing", "blank": " ",
    }
    got = {r.graph_id: (r.status, r.n_triples) for r in rdf.parse_status(spark.createDataFrame(list(texts.items()), "graph_id string, text string"), "sniff", 0).collect()}
    assert all(got[k] == ("parsed", 1 + (k == "n3")) for k in ("turtle", "nt", "xml", "jsonld", "trig", "n3"))
    assert (got["none"][0], got["empty"][0], got["blank"][0]) == ("unparseable", "empty", "empty")


def test_broken_off_texts_end_with_their_last_whole_statement():
    whole = [P.strip(), ":a :says \"ends with a stop.\nand goes on\" .".replace("\n", " "), ":b :p 15 , 2 ; :q [ :r ( :x :y ) ] .", ":c :url <http://e/x.y.> ."]
    text = "\n".join(whole)
    ends, at = [], 0
    for x in whole:
        at = text.index(x, at) + len(x)
        ends.append(at)
    rng = random.Random(1)
    for cut in [*ends, *[rng.randrange(len(text)) for _ in range(200)]]:
        end, rows = rdf.whole_statements(text[:cut], "g")
        assert end == max([e for e in ends if e <= cut], default=0), text[:cut]
        assert {x[:3] for x in rows} == {x[:3] for x in rdf.parse_turtle(text[:end], "g")}
