"""Verification of questions: signatures from parts and conversations against the graphs of the regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as Y
from ..operators import graph as G
from ..operators import sev as V
from ._bind import catalogue, read
from .graph import _VIEW, T, triples

QUERIES, ORACLES, _add = catalogue()
c = F.col


def _slot(id_, kind, surface, anchors=None):
    none = F.array().cast("array<string>")
    return F.struct(F.lit(id_).alias("id"), F.lit(kind).alias("kind"), surface.alias("surface"), (none if anchors is None else anchors).alias("anchors"))


def authored(spark, sf_dir):
    """A question for every part: its property between two nations, to a literal, out of the graph, or to an unknown term."""
    n = F.broadcast(read(spark, sf_dir, "nation"))  # a fixed list of 25
    x = read(spark, sf_dir, "part").join(n, c("p_partkey") % 25 == c("n_nationkey"))
    kind = c("p_partkey") % 4
    none = F.array().cast("array<string>")
    far = F.when(kind == 3, F.array(F.lit("no such thing"))).otherwise(none)
    b = F.concat(F.lit("n"), (c("n_nationkey") * 7 % 25).cast("string"))
    to = F.when(kind == 1, "literal").when(kind == 2, "external").otherwise("B")
    relation = F.struct(F.lit("A").alias("from"), to.alias("to"), F.array(F.concat(F.lit("p"), c("p_partkey").cast("string"))).alias("surface"))
    cq = F.concat(F.lit("Which "), "p_name", F.lit(" belong to it?"))
    return x.select(
        F.concat(F.lit("g"), c("n_regionkey").cast("string")).alias("graph_id"), F.concat(F.lit("part"), c("p_partkey").cast("string")).alias("cq_id"), cq.alias("cq"), Y.question_kind(cq).alias("cq_type"), F.lit("authored").alias("source"),
        F.array(_slot("A", "class", F.array("n_name")), _slot("B", "class", far, F.when(kind == 3, none).otherwise(F.array(b)))).cast(V.SLOTS).alias("slots"), F.array(relation).cast(V.RELATIONS).alias("relations"),
    )


def derived(spark, sf_dir):
    """A derived signature for every turn of a conversation, each filed under a region; one graph in six does not exist."""
    x = read(spark, sf_dir, "conversations").withColumn("s", Y.signature(c("text")))
    relation = F.struct(F.lit("SUBJECT").alias("from"), F.lit("external").alias("to"), c("s.relation").alias("surface"))
    return x.select(
        F.concat(F.lit("g"), (c("conv_id") % 6).cast("string")).alias("graph_id"), F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("cq_id"), c("text").alias("cq"), c("s.kind").alias("cq_type"), F.lit("derived").alias("source"),
        F.array(_slot("SUBJECT", "class", c("s.subject"))).cast(V.SLOTS).alias("slots"), F.array(relation).cast(V.RELATIONS).alias("relations"),
    )


def _verified(spark, sf_dir):
    return V.verify(triples(spark, sf_dir), authored(spark, sf_dir).unionByName(derived(spark, sf_dir)))


@_add("g_score_cq", None)
def score_cq(spark, sf_dir):
    """The score of every question."""
    return _verified(spark, sf_dir).select("graph_id", "cq_id", "coverage", "connectivity", "score", "label", "answerable", F.array_join("tiers", ",").alias("tiers"))


@_add("g_run_cq_verification", None)
def run_cq(spark, sf_dir):
    """The headline of every graph."""
    return V.rolled_up(_verified(spark, sf_dir), "graph_id").withColumn("tier_histogram", F.to_json("tier_histogram"))


@_add("agg_sev", None)
def sev(spark, sf_dir):
    """The means of every graph and source of signatures."""
    return V.rolled_up(_verified(spark, sf_dir), "graph_id", "source").select("graph_id", "source", "cqs_total", "pass_rate", "sev_score", "sev_coverage", "sev_connectivity", F.to_json("tier_histogram").alias("tiers"))


@_add("g_zero_cq", "SELECT 'turn:' || conv_id || ':' || turn AS cq_id, 'empty' AS status, 0.0E0 AS score, 'unsupported' AS label FROM conversations WHERE conv_id % 6 = 5")
def zero_cq(spark, sf_dir):
    """The questions of the graph that does not exist: each scores 0 and stays."""
    return _verified(spark, sf_dir).filter("status = 'empty'").select("cq_id", "status", "score", "label")


@_add("agg_gold_calibration", None)
def gold_calibration(spark, sf_dir):
    """Whether each region's graph answers the questions written for it; the first region is exempt."""
    return V.calibration(V.verify(triples(spark, sf_dir), authored(spark, sf_dir)), spark.createDataFrame([("g0",)], "graph_id string"))


@_add("g_relation_credit", None)
def relation_credit(spark, sf_dir):
    """The rung and the credit of every part's property between its own nation and the nation that it ranges over."""
    n = F.broadcast(read(spark, sf_dir, "nation"))
    x = read(spark, sf_dir, "part").join(n, c("p_partkey") % 25 == c("n_nationkey"))
    name = lambda k, v: F.concat(F.lit(k), v.cast("string"))
    mode = F.when(c("p_partkey") % 7 == 1, "literal").when(c("p_partkey") % 7 > 4, "external").otherwise("slot")
    return V.relation_credits(V.Schema(triples(spark, sf_dir)), x.select(name("part", c("p_partkey")).alias("rid"), name("g", c("n_regionkey")).alias("graph_id"), name("n", c("n_nationkey")).alias("a"), name("n", c("n_nationkey") * 7 % 25).alias("b"), mode.alias("mode"), F.array(name("p", c("p_partkey"))).alias("surface"), (c("p_partkey") % 7 == 6).alias("derived")))


@_add("g_match_props", T + f", {_VIEW} SELECT graph_id, '' AS surface, term AS p FROM vw WHERE role <> 'class' UNION ALL SELECT 'g' || n_regionkey, 'p' || p_partkey, 'p' || p_partkey FROM part JOIN nation ON p_partkey % 25 = n_nationkey")
def match_props(spark, sf_dir):
    """All properties of a graph for an empty surface, and the one that a part's key names."""
    t = triples(spark, sf_dir)
    n = F.broadcast(read(spark, sf_dir, "nation"))
    own = read(spark, sf_dir, "part").join(n, c("p_partkey") % 25 == c("n_nationkey")).select(F.concat(F.lit("g"), c("n_regionkey").cast("string")).alias("graph_id"), F.array(F.concat(F.lit("p"), c("p_partkey").cast("string"))).alias("surface"))
    got = V.matched_properties(G.index(t), G.schema_view(t), own.unionByName(t.select("graph_id").distinct().withColumn("surface", F.array().cast("array<string>"))))
    return got.select("graph_id", F.array_join("surface", "").alias("surface"), "p")


@_add("g_fanout", None)
def fanout(spark, sf_dir):
    """The specificity of every property."""
    return V.specificity(V.Schema(triples(spark, sf_dir)))
