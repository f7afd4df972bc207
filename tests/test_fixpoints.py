"""Components, strong components and closures against plain Python, in one task and in rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import fixpoints as X

SCHEMA = "graph_id string, a string, b string"


def reach(edges):
    out = set(edges)
    while more := {(a, z) for a, b in out for y, z in edges if b == y} - out:
        out |= more
    return out


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(5)
    out = {}
    for k in range(16):
        n = rng.randint(2, 12)
        out[f"g{k}"] = {(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(rng.randint(1, int(n * 1.6)))}
    return out


@pytest.fixture(scope="module")
def df(spark, graphs):
    return spark.createDataFrame([(k, a, b) for k, es in graphs.items() for a, b in sorted(es)] + [("g0", None, "n00")], SCHEMA)


@pytest.mark.parametrize("most", [X.MOST_EDGES, 0])
def test_strong_components(spark, graphs, df, most):
    got = {(r.graph_id, r.node): r.root for r in X.strong_components(df, most).collect()}
    want = {}
    for k, es in graphs.items():
        r = reach(es)
        nodes = {x for e in es for x in e}
        want |= {(k, x): min([x, *[y for y in nodes if (x, y) in r and (y, x) in r]]) for x in nodes}
    assert got == want


@pytest.mark.parametrize("most", [X.MOST_EDGES, 0])
def test_components(spark, graphs, df, most):
    got = sorted(tuple(r) for r in X.components(df, most_edges=most).collect())
    want = []
    for k, es in graphs.items():
        r = reach({(a, b) for x, y in es for a, b in ((x, y), (y, x))})
        want += [(k, x, min([x, *[b for a, b in r if a == x]])) for x in {x for e in es for x in e}]
    assert got == sorted(want)
    assert X.components(df.limit(0)).count() == 0


def test_closures(spark, graphs, df):
    want = sorted((k, a, b) for k, es in graphs.items() for a, b in reach(es))
    assert sorted(tuple(r) for r in X.transitive_closure(df).collect()) == want
    clean = df.filter("a is not null")
    number = X.numbered(clean.select("graph_id", F.explode(F.array("a", "b")).alias("node")).distinct())
    side = lambda s, x: number.select("graph_id", F.col("node").alias(s), F.col("id").alias(x), *(["n"] if s == "a" else []))
    edges = clean.join(side("a", "x"), ["graph_id", "a"]).join(side("b", "y"), ["graph_id", "b"]).select("graph_id", "n", F.col("x").alias("a"), F.col("y").alias("b"))
    name = {(r.graph_id, r.id): r.node for r in number.collect()}
    tiles = X.closure_tiles(edges, tile=4)  # several tiles a graph
    assert sorted((r.graph_id, name[r.graph_id, r.a], name[r.graph_id, r.b]) for r in X.tile_pairs(tiles, 4).collect()) == want
    degree = {(r.graph_id, name[r.graph_id, r.id]): (r.k, r.pairs) for r in X.tile_degrees(tiles, tile=4).collect()}
    for k, x in degree:
        assert degree[k, x] == (sum((g == k) * ((a == x) + (b == x)) for g, a, b in want), sum(g == k and a == x for g, a, b in want))


def test_a_long_cycle_settles(spark):
    n = 100_000
    name = lambda i: F.format_string("n%06d", i)
    cycle = spark.range(n).select(F.lit("g").alias("graph_id"), name(F.col("id")).alias("a"), name((F.col("id") + 1) % n).alias("b"))
    assert [tuple(r) for r in X.strong_components(cycle).groupBy("root").count().collect()] == [("n000000", n)]


def test_large_trees_need_no_rounds(spark, monkeypatch):
    """Forests too large for a task lose their leaves until they fit one; a round of stars or of contraction would raise."""
    for name in ("_starred", "_contracted", "_coloured"):
        monkeypatch.delattr(X, name)
    n = 4000
    name = lambda x: F.format_string("n%05d", x)
    i = F.col("id")
    tree = spark.range(1, n).select(F.lit("g").alias("graph_id"), name(n - i).alias("a"), name(n - F.floor(i / 8)).alias("b"))
    assert [tuple(r) for r in X.components(tree, most_edges=100).groupBy("root").count().collect()] == [("n00001", n)]
    assert X.strong_components(tree, most_edges=100).filter("node = root").count() == n


def test_small_graphs_share_batches(spark):
    """One row group of many graphs of an edge each, not a batch for each graph."""
    n = 3000
    edges = spark.range(n).select(F.col("id").cast("string").alias("graph_id"), F.lit("b").alias("a"), F.lit("a").alias("b"))
    sizes = X._whole(edges).mapInArrow(lambda it: (b.slice(0, 1) for b in it), "graph_id string, node string, root string")
    assert sizes.count() <= n / 10
    assert [tuple(r) for r in X._whole(edges).groupBy("node", "root").count().sort("node").collect()] == [("a", "a", n), ("b", "b", n)]
