"""RDF readers and entailment on fixtures of our own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import entailment as N
from corvane.operators import graph as G
from corvane.operators.structure import Analysis
from corvane.sources import rdf

TTL = """
@prefix : <http://e/> . PREFIX owl: <http://www.w3.org/2002/07/owl#>
@base <http://e/> .
# a comment
:A a owl:Class ; owl:disjointWith :B ; .
:B a owl:Class . <rel> :p "x"@EN , 'y', \"\"\"long "quoted"
text\"\"\" , 1 , 1.5 , 2e3 , true , "7"^^<http://www.w3.org/2001/XMLSchema#byte> .
:A :list ( :x [ :q :r ] ) .
[] :q [ :deep [ :deeper "z" ] ] .
_:b1 :q _:b1 .
"""
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://e/">
<e:K rdf:about="a" e:att="v"><e:p rdf:resource="b"/><e:t xml:lang="FR">mot</e:t><e:n><rdf:Description rdf:nodeID="k"/></e:n>
<e:c rdf:parseType="Collection"><rdf:Description rdf:about="x"/></e:c><e:i rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</e:i></e:K></rdf:RDF>"""
OWLXML = """<Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://e/o"><Prefix name="f" IRI="http://f/"/><Declaration><Class IRI="#A"/></Declaration>
<Declaration><ObjectProperty abbreviatedIRI="f:p"/></Declaration></Ontology>"""


def test_turtle():
    t = rdf.parse_turtle(TTL, "g")
    assert ("http://e/A", "iri", rdf.RDF + "type", rdf.OWL + "Class", "iri", None, None) in t
    said = {(o, d, lang) for s, _, p, o, k, d, lang in t if s == "http://e/rel"}
    assert said == {("x", rdf.RDF + "langString", "en"), ("y", rdf.XSD + "string", None), ('long "quoted"\ntext', rdf.XSD + "string", None), ("1", rdf.XSD + "integer", None), ("1.5", rdf.XSD + "decimal", None), ("2e3", rdf.XSD + "double", None), ("true", rdf.XSD + "boolean", None), ("7", rdf.XSD + "byte", None)}
    assert sum(p == rdf.RDF + "first" for _, _, p, *_ in t) == 2 and len(t) == len(set(t)) == 21
    assert all(s.startswith("_:g/") for s, k, *_ in t if k == "bnode")


@pytest.mark.parametrize("bad", [":a :b :c .", "@prefix : <http://e/> . :a :b", "@prefix : <http://e/> . :a :b ( :c .", "Sorry, I cannot do that.", "@prefix : <http://e/> . " + ":a :b " + "[ :c " * 300])
def test_bad_turtle_is_refused_not_raised(bad):
    with pytest.raises(rdf.ParseError):
        rdf.parse_turtle(bad)
    assert rdf.parse_any(bad) == ("unparseable", [])


def test_rdfxml_and_owlxml():
    t = rdf.parse_rdfxml(XML, "g")
    assert ("http://e/a", "iri", "http://e/t", "mot", "literal", rdf.RDF + "langString", "fr") in t and ("http://e/a", "iri", "http://e/i", "5", "literal", rdf.XSD + "int", None) in t and len(t) == 9
    assert rdf.parse_any(XML, "g", "sniff")[0] == "parsed"
    assert {x[3] for x in rdf.parse_any(OWLXML, "g", "nonempty")[1]} == {rdf.OWL + "Class", rdf.OWL + "ObjectProperty"}
    assert rdf.parse_any("# nothing here", mode="ladder") == ("empty", []) and rdf.parse_any(None)[0] == "unparseable"


def test_scan_and_parse(spark, tmp_path):
    d = tmp_path / "m" / "c" / "s1"
    d.mkdir(parents=True)
    (d / "ontology.ttl").write_text(TTL)
    files = rdf.scan_tree(spark, str(tmp_path))
    assert files.select("model", "config", "id").collect() == [("m", "c", "s1")]
    t = rdf.triples(files.select(F.col("id").alias("graph_id"), "text"))
    assert t.count() == 21 and G.ontometrics(t).first().classes_count == 2
    assert rdf.parse_status(files.select(F.col("id").alias("graph_id"), "text")).first().status == "parsed"


def closed(spark, body, graph="g"):
    text = f"@prefix : <http://e/> . @prefix owl: <{rdf.OWL}> . @prefix rdfs: <{rdf.RDFS}> . {body}"
    return N.closed(rdf.triples(spark.createDataFrame([(graph, text)], "graph_id string, text string")))


def test_entailment_and_clashes(spark):
    c = closed(spark, ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :C owl:disjointWith :D . :x a :A , :D . :p rdfs:domain :B ; owl:inverseOf :q . :y :p :z . :t a owl:TransitiveProperty . :a :t :b . :b :t :c .")
    have = {(r.s[9:], r.p.split("/")[-1].split("#")[-1], r.o[9:]) for r in c.collect()}
    assert {("A", "subClassOf", "C"), ("x", "type", "C"), ("y", "type", "C"), ("z", "q", "y"), ("a", "t", "c")} <= have
    assert [(r.s, r.reason) for r in N.clashes(c).collect()] == [("http://e/x", "disjoint classes")]


def test_replication_and_order_do_not_matter(spark):
    rng = random.Random(3)
    lines = [f":c{rng.randrange(9)} rdfs:subClassOf :c{rng.randrange(9)} ." for _ in range(14)] + [f":p{i} rdfs:domain :c{i} ; rdfs:range :c{i + 1} ." for i in range(5)]
    shuffled = lines[:]
    rng.shuffle(shuffled)
    head = f"@prefix : <http://e/> . @prefix rdfs: <{rdf.RDFS}> . "
    docs = spark.createDataFrame([("a", head + " ".join(lines)), ("b", head + " ".join(shuffled + lines))], "graph_id string, text string")
    t = rdf.triples(docs)
    one = Analysis(t).scores().drop("graph_id").collect()
    assert one[0] == one[1] and 0 < one[0].score <= 1
    lifted = G.lift(t).groupBy("graph_id").count().collect()
    assert lifted[0]["count"] == lifted[1]["count"]


def test_class_expressions_are_lifted_with_every_filler(spark):
    """Several properties and fillers, data ranges, fillers and holders that are open, both sides of subsumption, and equivalents."""
    text = """@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    :A rdfs:subClassOf [ owl:onProperty :q , :r ; owl:someValuesFrom :X , :Y ; owl:allValuesFrom owl:Thing ] .
    [] owl:onProperty :s ; owl:onDataRange xsd:string ; rdfs:subClassOf :B . :C owl:equivalentClass [ owl:onProperty :t ; owl:minCardinality 1 ] .
    owl:Thing rdfs:subClassOf [ owl:onProperty :u ; owl:allValuesFrom :X ] . :D owl:disjointWith [ owl:onProperty :v ; owl:someValuesFrom :X ] ."""
    t = rdf.triples(spark.createDataFrame([("g", text)], "graph_id string, text string"))
    e = "http://e/"
    got = {(r.a.replace(e, ""), r.p.replace(e, ""), r.b.replace(e, "")) for r in G.lift(t).collect()}
    assert got >= {("A", p, b) for p in "qr" for b in ("X", "Y", G.ANY)} | {("B", "s", G.LITERAL), ("C", "t", G.ANY), (G.ANY, "u", "X")}
    assert not any(a == "D" or p == "v" and a not in (G.ANY,) for a, p, _ in got)


def test_texts_are_read_whole():
    """A text of over 64 MB is neither cut nor refused: what stands at its end counts."""
    text = "@prefix : <http://e/> . :a :b :c .\n" + ("# " + "x" * 1021 + "\n") * (65 << 10) + ":d :e :f ."
    assert len(text) > 64 << 20
    for mode in ("ladder", "nonempty", "sniff"):
        status, rows = rdf.parse_any(text, "", mode)
        assert status == "parsed" and len(rows) == 2
