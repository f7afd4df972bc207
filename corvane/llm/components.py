"""Connected components of an edge table, without collecting edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _io


#: Shares of a node's neighbours.
SALTS = 32


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m) of every edge (u, v), with the smallest neighbour ``m`` of u."""
    edges = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    share = edges.groupBy("u", "s").agg(F.min("v").alias("m"))
    return edges.join(share.withColumn("m", F.min("m").over(Window.partitionBy("u"))), ["u", "s"]).select("u", "v", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: every u has one v, and no v is a u. Counts by node are map-side aggregates."""
    ends = edges.filter("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up > 0 and root > 0)").limit(1).count() == 0


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every end of an edge (a, b) with the smallest node it reaches, for long ids.

    Alternating large-star and small-star steps: both only move a node's larger neighbours to its smallest one, so that a
    hub costs rows in proportion to its edges and the number of rounds grows with the logarithm of a component's size.
    The smallest neighbour is a minimum in two levels, first over each of ``SALTS`` shares of a node's neighbours, and the
    edges meet it share by share, so that a hub's edges are not one task's. Edges of a round are written to the shared
    folder; rounds end when the edges are stars, as those of a forest of two levels are at once. Self loops keep their node;
    rows with a null end are left out; no edges give no rows.
    """
    now = _io.materialize(edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = now.filter("u = v")
    first = now
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.filter("u <> v").select("u", "v").union(now.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v")
        before, now = now, _io.materialize(small.distinct())
        if before is not first:
            _io.discard(before)
    else:
        raise RuntimeError("components did not settle")
    now = now.filter("u <> v")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return roots.union(own).union(alone.join(now.select(F.col("u").alias("node")), "node", "left_anti")).distinct()
