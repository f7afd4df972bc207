"""A graph of over 3,000 classes gets its whole closure, as small ones do."""

from __future__ import annotations

import pytest

from corvane.operators import graph as G
from corvane.operators import structure as S
from corvane.sources import rdf

N, E = 3100, "http://e/"


def above(i):
    while i > 1:
        i //= 2
        yield i


#: The tree's pairs but those of the root, which is comparable to all, has no anchor and says nothing.
PAIRS = {(i, j) for i in range(1, N + 1) for j in above(i) if j > 1}


@pytest.fixture(scope="module")
def large(spark):
    """A tree of classes, and a chain of four that the closure makes a complete relation."""
    sub = [(f"c{i}", f"c{i // 2}") for i in range(2, N + 1)] + [(f"d{i}", f"d{i + 1}") for i in range(3)]
    rows = [("g", E + a, "iri", G.SUB, E + b, "iri") for a, b in sub]
    rows += [("g", E + x, "iri", G.TYPE, rdf.OWL + "Class", "iri") for x in {x for e in sub for x in e}]
    return S.Analysis(spark.createDataFrame(rows, "graph_id string, s string, s_kind string, p string, o string, o_kind string"))


def test_taxonomy_of_a_large_graph(large):
    got = [tuple(sorted((r.a, r.b))) for r in large.taxonomy.collect()]
    assert len(got) == len(PAIRS) and set(got) == {tuple(sorted((f"{E}c{i}", f"{E}c{j}"))) for i, j in PAIRS}


def test_scores_of_a_large_graph(large):
    held = (N - 1) * 270
    assert large.scores().first().class_connectivity == pytest.approx(held / (held + (N - 1) * 9 + 5 * 270))


def test_diagnostics_of_a_large_graph(large):
    r = large.diagnostics().first()
    assert (r.comparability_pairs, r.dropped_taxonomy_nodes, r.dropped_taxonomy_components) == (len(PAIRS), 5, 1)


def test_grounded_terms_of_a_large_graph(large):
    assert {r.entity for r in large.roster.filter("d > 0").collect()} == {f"{E}c{i}" for i in range(2, N + 1)}


def test_incidences_of_a_large_graph(large):
    got = {r.entity: r.d for r in large.roster.collect()}
    assert got == {f"{E}c{i}": int(i > 1) for i in range(1, N + 1)} | {f"{E}d{i}": 0 for i in range(4)}
