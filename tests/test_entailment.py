"""Entailment against a plain closure: every rule over all triples until nothing is new."""

from __future__ import annotations

import random

import pytest

from corvane.operators import entailment as N
from corvane.operators import graph as G
from corvane.sources.rdf import OWL, RDF, XSD

SCHEMA = "graph_id string, s string, s_kind string, p string, o string, o_kind string"
E = "http://e/"
SAME, ON = OWL + "sameAs", OWL + "onProperty"


def items(t, node):
    """The members of a list, and whether it ends."""
    out, seen = [], set()
    while node != N.NIL:
        first, rest = [o for s, p, o in t if s == node and p == N.FIRST], [o for s, p, o in t if s == node and p == N.REST]
        if not first or not rest or node in seen:
            return out + first, False
        seen.add(node)
        out += first
        node = rest[0]
    return out, True


def brute(t):
    """Objects that are literals begin with a quote."""
    t = set(t)
    while True:
        new = set()
        by = lambda p: [(s, o) for s, q, o in t if q == p]  # noqa: E731, B023
        typed = lambda k: {s for s, q, o in t if q == G.TYPE and o == OWL + k}  # noqa: E731, B023
        for a, b in by(G.EQUIVALENT):
            new |= {(a, G.SUB, b), (b, G.SUB, a)}
        for a, b in by(OWL + "equivalentProperty"):
            new |= {(a, G.SUBP, b), (b, G.SUBP, a)}
        for p1, p2, p3 in [(G.SUB, G.SUB, G.SUB), (G.SUBP, G.SUBP, G.SUBP), (G.TYPE, G.SUB, G.TYPE), (G.DOMAIN, G.SUB, G.DOMAIN), (G.RANGE, G.SUB, G.RANGE), (G.SUBP, G.DOMAIN, G.DOMAIN), (G.SUBP, G.RANGE, G.RANGE), *[(p, p, p) for p in typed("TransitiveProperty")]]:
            new |= {(a, p3, d) for a, b in by(p1) for x, d in by(p2) if b == x}
        for p, q in by(G.SUBP):
            new |= {(a, q, b) for a, b in by(p)}
        for p, q in [*by(G.INVERSE), *[(b, a) for a, b in by(G.INVERSE)], *[(p, p) for p in typed("SymmetricProperty")]]:
            new |= {(b, q, a) for a, b in by(p)}
        for p, k in by(G.DOMAIN):
            new |= {(a, G.TYPE, k) for a, _ in by(p)}
        for p, k in by(G.RANGE):
            new |= {(b, G.TYPE, k) for _, b in by(p)}
        for p in typed("FunctionalProperty"):
            new |= {(b, SAME, d) for a, b in by(p) for x, d in by(p) if a == x and b != d and d[0] != '"'}
        for p in typed("InverseFunctionalProperty"):
            new |= {(a, SAME, x) for a, b in by(p) for x, d in by(p) if b == d and a != x and b[0] != '"'}
        for x, p in by(ON):
            new |= {(u, G.TYPE, x) for y in [o for s, o in by(OWL + "someValuesFrom") if s == x] for u, v in by(p) if y == N.THING or (v, G.TYPE, y) in t}
            new |= {(v, G.TYPE, y) for y in [o for s, o in by(OWL + "allValuesFrom") if s == x] for u, v in by(p) if (u, G.TYPE, x) in t}
            for v in [o for s, o in by(OWL + "hasValue") if s == x]:
                new |= {(u, G.TYPE, x) for u, w in by(p) if w == v} | {(u, p, v) for u, k in by(G.TYPE) if k == x}
        for p, node in by(OWL + "propertyChainAxiom"):
            steps, whole = items(t, node)
            if whole and steps:
                now = set(by(steps[0]))
                for q in steps[1:]:
                    now = {(a, d) for a, b in now for x, d in by(q) if b == x}
                new |= {(a, p, b) for a, b in now}
        for x, node in by(OWL + "intersectionOf"):
            parts, whole = items(t, node)
            new |= {(x, G.SUB, k) for k in parts}
            if whole and parts:
                new |= {(u, G.TYPE, x) for u, _ in by(G.TYPE) if all((u, G.TYPE, k) in t for k in parts)}
        for x, node in by(OWL + "unionOf"):
            new |= {(k, G.SUB, x) for k in items(t, node)[0]}
        for x, node in by(OWL + "oneOf"):
            new |= {(k, G.TYPE, x) for k in items(t, node)[0]}
        for a, b in by(SAME):
            new |= {(b, SAME, a)} | {(a, SAME, d) for x, d in by(SAME) if x == b}
            if a != b:
                new |= {(b, p, o) for s, p, o in t if s == a} | {(s, b, o) for s, p, o in t if p == a} | {(s, p, b) for s, p, o in t if o == a}
        new = {(s, p, o) for s, p, o in new if s[0] != '"'} - t
        if not new:
            return t
        t |= new


def make_list(add, name, members):
    for i, m in enumerate(members):
        add(f"_:{name}{i}", N.FIRST, m)
        add(f"_:{name}{i}", N.REST, f"_:{name}{i + 1}" if i + 1 < len(members) else N.NIL)
    return f"_:{name}0" if members else N.NIL


def random_graph(rng):
    t = set()
    e = lambda x: x if ":" in x else E + x
    add = lambda s, p, o: t.add((e(s), e(p), o if o[0] == '"' else e(o)))
    K, P, X = [f"K{i}" for i in range(5)], [f"p{i}" for i in range(4)], [f"x{i}" for i in range(5)]
    for _ in range(rng.randint(0, 4)):
        add(rng.choice(K), rng.choice([G.SUB, G.SUB, G.EQUIVALENT]), rng.choice(K))
    for p in P:
        if rng.random() < 0.35:
            add(p, G.TYPE, OWL + rng.choice(["SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty"]))
        if rng.random() < 0.4:
            add(p, rng.choice([G.SUBP, G.INVERSE, OWL + "equivalentProperty"]), rng.choice(P))
        if rng.random() < 0.4:
            add(p, rng.choice([G.DOMAIN, G.RANGE]), rng.choice(K))
    for i in range(rng.randint(0, 3)):
        add(f"_:r{i}", ON, rng.choice(P))
        kind = rng.choice(["someValuesFrom", "allValuesFrom", "hasValue"])
        add(f"_:r{i}", OWL + kind, rng.choice(X) if kind == "hasValue" else rng.choice([*K, N.THING]))
        add(rng.choice(K), rng.choice([G.SUB, G.EQUIVALENT]), f"_:r{i}")
    if rng.random() < 0.5:
        add(rng.choice(P), OWL + "propertyChainAxiom", make_list(add, "c", [rng.choice(P) for _ in range(rng.randint(1, 3))]))
    for i in range(rng.randint(0, 2)):
        add(rng.choice(K), OWL + rng.choice(["intersectionOf", "unionOf", "oneOf"]), make_list(add, f"l{i}", [rng.choice(K) for _ in range(rng.randint(1, 3))]))
    for _ in range(rng.randint(2, 8)):
        add(rng.choice(X), rng.choice(P), rng.choice([*X, '"word', '"other']))
    for x in X:
        if rng.random() < 0.5:
            add(x, G.TYPE, rng.choice(K))
    if rng.random() < 0.2:
        add(rng.choice(X), SAME, rng.choice(X))
    return t


def frame(spark, graphs):
    kind = lambda x: "literal" if x[0] == '"' else "bnode" if x.startswith("_:") else "iri"
    return spark.createDataFrame([(k, s, kind(s), p, o.lstrip('"'), kind(o)) for k, t in graphs.items() for s, p, o in sorted(t)], SCHEMA)


@pytest.mark.parametrize("seed", [11])
def test_closure_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    graphs = {f"g{i}": random_graph(rng) for i in range(40)}
    got = {}
    for r in N.closed(frame(spark, graphs)).collect():
        got.setdefault(r.graph_id, set()).add((r.s, r.p, ('"' if r.o_kind == "literal" else "") + r.o))
        assert r.inferred == ((r.s, r.p, ('"' if r.o_kind == "literal" else "") + r.o) not in graphs[r.graph_id])
    made = 0
    for k, t in graphs.items():
        want = brute(t)
        made += len(want) - len(t)
        assert got[k] == want, (k, sorted(want - got[k])[:5], sorted(got[k] - want)[:5], sorted(t))
    assert made > 400


def test_clashes_and_empty_classes(spark):
    def graph(*rows):
        t = set()
        for s, p, o in rows:
            t.add((s if ":" in s else E + s, p if ":" in p else E + p, o if ":" in o or o[0] == '"' else E + o))
        return t

    def listed(name, members):
        t = []
        head = make_list(lambda s, p, o: t.append((s, p, o)), name, members)
        return head, t

    head, members = listed("m", ["A", "B", "C"])
    graphs = {
        "fine": graph(("x", G.TYPE, "A"), ("A", G.SUB, "B")),
        "apart": graph(("x", G.TYPE, "A"), ("A", G.SUB, "B"), ("x", G.TYPE, "C"), ("C", G.DISJOINT, "B")),
        "all": graph(("_:d", G.TYPE, OWL + "AllDisjointClasses"), ("_:d", OWL + "members", head), *members, ("x", G.TYPE, "A"), ("x", G.TYPE, "C")),
        "nothing": graph(("A", G.SUB, N.NOTHING), ("D", G.SUB, "A"), ("x", G.TYPE, "D")),
        "empty class": graph(("A", G.SUB, "B"), ("B", G.SUB, N.NOTHING)),
        "same": graph(("p", G.TYPE, OWL + "FunctionalProperty"), ("x", "p", "y"), ("x", "p", "z"), ("z", OWL + "differentFrom", "y")),
        "loop": graph(("p", G.TYPE, OWL + "IrreflexiveProperty"), ("q", G.SUBP, "p"), ("x", "q", "x")),
        "turned": graph(("p", G.TYPE, OWL + "AsymmetricProperty"), ("x", "p", "y"), ("y", "p", "x")),
        "rivals": graph(("p", OWL + "propertyDisjointWith", "q"), ("x", "p", "y"), ("x", "q", "y")),
        "none": graph(("_:r", ON, "p"), ("_:r", OWL + "maxCardinality", '"0'), ("A", G.SUB, "_:r"), ("x", G.TYPE, "A"), ("x", "p", "y")),
        "complement": graph(("A", OWL + "complementOf", "B"), ("x", G.TYPE, "A"), ("x", G.TYPE, "B")),
    }
    got = {r.graph_id: r for r in N.reasoned(frame(spark, graphs)).collect()}
    want = {"apart": "disjoint classes", "all": "disjoint classes", "complement": "disjoint classes", "nothing": "member of nothing", "same": "same and different", "loop": "irreflexive property", "turned": "asymmetric property", "rivals": "disjoint properties", "none": "more than none"}
    for k, r in got.items():
        assert r.consistent == (k not in want) and (k not in want or want[k] in r.reasons), (k, r)
        assert r.triples_before == len(graphs[k]) and r.triples_after == r.triples_before + r.inferred_triples
    assert got["empty class"].unsatisfiable_classes == [E + "A", E + "B"] and got["fine"].unsatisfiable_classes == []
    assert N.closed(frame(spark, {"x": {("a", "b", "c")}}).limit(0)).count() == 0
    assert XSD and RDF


def test_long_lists_take_rounds_by_the_logarithm(spark):
    t = []
    make_list(lambda s, p, o: t.append((s, p, o)), "n", [f"{E}m{i}" for i in range(300)])
    got = N.list_members(frame(spark, {"g": set(t)}).select("graph_id", "s", "p", "o")).collect()
    assert len(got) == 300 and {r.list for r in got} == {"_:n0"}
