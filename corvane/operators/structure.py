"""The connectivity measure of graphs: anchors of every entity, the taxonomy without what says nothing, scores by role.

An entity is anchored by signatures (domain and range), class expressions (their holder, property and fillers), usage edges,
typing, and by a place in a taxonomy or among terms told apart. Shapes that say nothing are dropped first: complete relations, a class comparable to
all others without an anchor of its own. Doubt is kept in whole 270ths and divided once. All graphs are worked on at once.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from ..sources.rdf import OWL
from . import fixpoints as X
from . import graph as G

c = F.col
g = "graph_id"
# The weight of freedom from pitfalls, the least size of a shape that may be dropped.
PITFALL_NUMERATOR, PITFALL_DENOMINATOR, LEAST_SHAPE = 3, 20, 3
SUBSUMPTION, EQUIVALENCE = [G.SUB, G.SUBP], [G.EQUIVALENT, OWL + "equivalentProperty", OWL + "sameAs"]
DISTINCTION = [G.DISJOINT, OWL + "propertyDisjointWith", OWL + "differentFrom", G.INVERSE]
ROLES = ("property", "class", "individual")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kept(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (graph_id, p, a, b) of components that say something, and the dropped ones."""
    every, bad = G.judged(edges)
    key = [g, "p", "root"]
    return materialize(every.join(bad, key, "left_anti").drop("root")), every.join(bad, key, "left_semi").drop("root")


class Analysis:
    """What the measure counts in the triples of some graphs, each table made once, when it is first asked for."""

    def __init__(self, t: DataFrame):
        self.triples = materialize(t)

    @cached_property
    def connective(self) -> DataFrame:
        return materialize(G.triple_class(self.triples).filter("kind = 'connective'").drop("kind"))

    @cached_property
    def subjects(self) -> DataFrame:
        t = self.triples.filter(G.is_named(c("s"), c("s_kind")))
        return materialize(t.select(g, c("s").alias("entity")).distinct())

    @cached_property
    def roles(self) -> DataFrame:
        return materialize(G.roles(self.triples))

    def _of(self, role: str, as_: str) -> DataFrame:
        terms = self.roles.filter(c("role") == role).select(g, c("term").alias("entity"))
        if role == "class":  # a class counts where the graph says something of it, and does not declare it an ontology
            ontology = self.triples.filter((c("p") == G.TYPE) & (c("o") == OWL + "Ontology")).select(g, c("s").alias("entity"))
            terms = terms.join(self.subjects, [g, "entity"], "left_semi").join(ontology, [g, "entity"], "left_anti")
        return terms.withColumnRenamed("entity", as_)

    @cached_property
    def _signature(self) -> tuple[DataFrame, DataFrame]:
        e = self.connective.filter(c("p").isin(G.DOMAIN, G.RANGE) & (c("s_kind") == "iri") & (c("o_kind") == "iri")).select(g, "p", c("s").alias("a"), c("o").alias("b"))
        return _kept(e.join(self._of("property", "a"), [g, "a"], "left_semi").join(self._of("class", "b"), [g, "b"], "left_semi"))

    @cached_property
    def expressions(self) -> dict[str, DataFrame]:
        return G.expressions(self.triples, self._of("class", "entity"), self._of("property", "entity"))

    @cached_property
    def _usage(self) -> tuple[DataFrame, DataFrame]:
        return _kept(self._edges.filter("o_kind = 'iri'").select(g, "p", c("s").alias("a"), c("o").alias("b")))

    @cached_property
    def _edges(self) -> DataFrame:
        return G.usage_edges(self.connective)

    @cached_property
    def attributes(self) -> DataFrame:
        return self._edges.filter("o_kind = 'literal'").select(g, "p", c("s").alias("a"), c("o").alias("b"))

    @cached_property
    def typing(self) -> DataFrame:
        t = self.triples.filter((c("p") == G.TYPE) & (c("s_kind") == "iri") & (c("s") != c("o")) & ~c("o").isin(G.DECLARATIONS) & G.is_named(c("o"), c("o_kind")))
        return t.select(g, c("s").alias("a"), c("o").alias("b")).distinct()

    @cached_property
    def primary(self) -> DataFrame:
        """(graph_id, entity, d): anchors but those of the taxonomy."""
        bump = lambda df, term: df.select(g, c(term).alias("entity"))
        known = lambda df, term: bump(df, term).join(self.subjects, [g, "entity"], "left_semi")
        sign, use, attr, typed = self._signature[0], self._usage[0], self.attributes, self.typing
        rows = _union(
            bump(sign.select(g, "p", "a").distinct(), "a"), bump(sign, "b"), bump(self.expressions["arcs"], "entity"), bump(use, "a"), bump(use, "b"), known(use, "p"), bump(attr, "a"), known(attr, "p"),
            bump(typed.select(g, "a").distinct(), "a"), known(typed, "b"),
        )
        return materialize(rows.filter(G.is_named(c("entity"), F.lit("iri"))).groupBy(g, "entity").agg(F.count("*").alias("d")))

    @cached_property
    def _ties(self) -> DataFrame:
        """(graph_id, a, b, kind) between terms with a role that are subsumed, equivalent or told apart."""
        kind = F.when(c("p").isin(SUBSUMPTION), "sub").when(c("p").isin(EQUIVALENCE), "same").when(c("p").isin(DISTINCTION), "apart")
        e = self.connective.filter((c("s_kind") == "iri") & (c("o_kind") == "iri") & (c("s") != c("o"))).select(g, c("s").alias("a"), c("o").alias("b"), kind.alias("kind")).filter("kind is not null")
        for side in ("a", "b"):
            e = e.join(_union(self._of("class", side), self._of("property", side)), [g, side], "left_semi")
        return materialize(e)

    @cached_property
    def _quotient(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(graph_id, node, root) of terms tied by equivalence or a cycle of subsumption; (graph_id, root, comp, id, n), roots numbered
        within their graph, with the component they are in; (graph_id, n, a, b) of numbered roots of which one is stated to be above the other.
        """
        e = self._ties.filter("kind <> 'apart'")
        raw = materialize(_union(e.select(g, "a", "b"), e.filter("kind = 'same'").select(g, c("b").alias("a"), c("a").alias("b"))).distinct())
        root = X.strong_components(raw)
        side = lambda s: root.select(g, c("node").alias(s), c("root").alias("r" + s))
        edges = materialize(raw.join(side("a"), [g, "a"]).join(side("b"), [g, "b"]).filter("ra <> rb").select(g, c("ra").alias("a"), c("rb").alias("b")).distinct())
        comp = X.components(edges).withColumnRenamed("root", "comp")
        number = materialize(X.numbered(comp.select(g, "node")).join(comp, [g, "node"]).withColumnRenamed("node", "root"))
        at = lambda s: number.select(g, c("root").alias(s), c("id").alias("i" + s))
        size = number.groupBy(g).agg(F.max("n").alias("n"))
        numbered = materialize(edges.join(at("a"), [g, "a"]).join(at("b"), [g, "b"]).join(size, g).select(g, "n", c("ia").alias("a"), c("ib").alias("b")))
        discard(raw, edges)
        return root, number, numbered

    @cached_property
    def _tiles(self) -> DataFrame:
        """What reaches what, as tiles of bits."""
        return X.closure_tiles(self._quotient[2])

    def _degrees(self, weights: DataFrame | None = None) -> DataFrame:
        """(graph_id, id, k, pairs): how many roots each is comparable to; ``weights`` (graph_id, id, w) says what a root counts, none if absent."""
        if weights is None:
            return X.tile_degrees(self._tiles)
        every = self._quotient[1].select(g, "id").join(weights, [g, "id"], "left")
        blocks = every.groupBy(g, F.floor(c("id") / X.TILE).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).cast("int").alias("w")))), lambda x: x["w"]).alias("weights"))
        return X.tile_degrees(self._tiles, blocks)

    @cached_property
    def dropped(self) -> DataFrame:
        """(graph_id, root, shape): roots that classify nothing: of a component in which all are comparable (``mesh``), or comparable to all without an anchor (``universal``)."""
        root, number, _ = self._quotient
        degree = self._degrees().join(number.select(g, "id", "root", "comp"), [g, "id"])
        size = degree.groupBy(g, "comp").agg(F.count("*").alias("n"), (F.sum("k") / 2).alias("m")).filter(c("n") >= LEAST_SHAPE)
        held = root.join(self.primary.select(g, c("entity").alias("node")), [g, "node"], "left_semi").select(g, "root").distinct()
        x = degree.join(size, [g, "comp"]).join(held.withColumn("held", F.lit(True)), [g, "root"], "left")
        mesh = c("m") == c("n") * (c("n") - 1) / 2
        shape = F.when(mesh, "mesh").when((c("k") == c("n") - 1) & c("held").isNull(), "universal")
        return materialize(x.select(g, "root", shape.alias("shape"), "comp").filter("shape is not null"))

    @cached_property
    def placed(self) -> DataFrame:
        """(graph_id, root, pairs): roots with a pair that survives, and for how many pairs of terms it stands as the lower one."""
        root, number, _ = self._quotient
        members = root.groupBy(g, "root").agg(F.count("*").alias("w"))
        weights = number.join(members, [g, "root"]).join(self.dropped.select(g, "root"), [g, "root"], "left_anti").select(g, "id", "w")
        return materialize(self._degrees(weights).filter("k > 0").join(number.select(g, "id", "root"), [g, "id"]).select(g, "root", "pairs"))

    @cached_property
    def taxonomy(self) -> DataFrame:
        """(graph_id, a, b): pairs of terms of which one is above the other, expanded to the members of equivalent ones."""
        root, number, _ = self._quotient
        pairs = X.tile_pairs(self._tiles)
        term = number.join(self.dropped.select(g, "root"), [g, "root"], "left_anti").select(g, "id", "root").join(root, [g, "root"])
        member = lambda side: term.select(g, c("id").alias(side), c("node").alias(side + "_term"))
        return pairs.join(member("a"), [g, "a"]).join(member("b"), [g, "b"]).select(g, c("a_term").alias("a"), c("b_term").alias("b"))

    @cached_property
    def distinct(self) -> DataFrame:
        """(graph_id, a, b): terms told apart, without pairs of equal ones and complete relations."""
        root = self._quotient[0]
        e = self._ties.filter("kind = 'apart'").select(g, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for side in ("a", "b"):
            e = e.join(root.select(g, c("node").alias(side), c("root").alias("r" + side)), [g, side], "left")
        e = e.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(g, F.lit("apart").alias("p"), "a", "b")
        both = _union(e, e.select(g, "p", c("b").alias("a"), c("a").alias("b")))
        return materialize(_kept(both)[0].filter("a <= b").select(g, "a", "b"))

    @cached_property
    def incidences(self) -> DataFrame:
        """(graph_id, entity, d): all anchors; a place in the taxonomy counts once, and one among terms told apart."""
        placed = self.placed.select(g, "root").join(self._quotient[0], [g, "root"]).select(g, c("node").alias("entity"))
        apart = _union(self.distinct.select(g, c("a").alias("entity")), self.distinct.select(g, c("b").alias("entity"))).distinct()
        rows = _union(self.primary, placed.withColumn("d", F.lit(1).cast("long")), apart.withColumn("d", F.lit(1).cast("long")))
        return materialize(rows.groupBy(g, "entity").agg(F.sum("d").alias("d")))

    @cached_property
    def roster(self) -> DataFrame:
        """(graph_id, entity, role, d) of the terms that a graph says something of, but ontologies, annotation properties and ambiguous ones."""
        skipped = self.triples.filter((c("p") == G.TYPE) & c("o").isin(OWL + "Ontology", OWL + "AnnotationProperty")).select(g, c("s").alias("entity")).distinct()
        x = self.subjects.join(self.roles.withColumnRenamed("term", "entity"), [g, "entity"], "left").join(skipped, [g, "entity"], "left_anti").filter("role is null or role <> 'ambiguous'")
        x = x.join(self.incidences, [g, "entity"], "left")
        return materialize(x.select(g, "entity", F.coalesce("role", F.lit("individual")).alias("role"), F.coalesce("d", F.lit(0)).alias("d")))

    def scores(self, pitfalls: DataFrame | None = None) -> DataFrame:
        """(graph_id, vacuous, a ratio for each role, evidence, doubt, pitfall_freedom, score); null is missing, never 0.

        ``pitfalls`` (graph_id, total, critical) are reports; a graph without one has no such component. A graph without any
        connective triple scores 0.
        """
        doubt = F.get(F.array(*map(F.lit, G.DOUBT)), F.least(c("d"), F.lit(len(G.DOUBT) - 1)).cast("int"))
        each = self.roster.select(g, "role", (c("d") * 270).alias("e"), doubt.cast("long").alias("u"))
        of = lambda k, role=None: F.sum(c(k) if role is None else F.when(c("role") == role, c(k)))
        ratios = [F.try_divide(of("e", r), of("e", r) + of("u", r)).alias(f"{r}_connectivity") for r in ROLES]
        x = self.triples.select(g).distinct().join(each.groupBy(g).agg(*ratios, of("e").alias("evidence"), of("u").alias("doubt")), g, "left")
        x = x.join(self.connective.select(g).distinct().withColumn("alive", F.lit(True)), g, "left").withColumn("vacuous", c("alive").isNull())
        if pitfalls is None:
            x = x.withColumn("pitfall_freedom", F.lit(None).cast("double"))
        else:
            x = x.join(pitfalls.select(g, (1.0 / (1 + c("total") + 2 * c("critical"))).alias("pitfall_freedom")), g, "left")
        own = F.try_divide(c("evidence"), c("evidence") + c("doubt"))
        share = PITFALL_NUMERATOR / PITFALL_DENOMINATOR
        score = F.when(c("vacuous"), 0.0).when(c("pitfall_freedom").isNull(), own).when(own.isNull(), c("pitfall_freedom")).otherwise((1 - share) * own + share * c("pitfall_freedom"))
        zero = lambda k: F.when(c("vacuous") & c(k).isNotNull(), 0.0).otherwise(c(k)).alias(k)
        return x.select(g, "vacuous", *[zero(f"{r}_connectivity") for r in ROLES], "evidence", "doubt", zero("pitfall_freedom"), score.alias("score"))

    def diagnostics(self) -> DataFrame:
        """25 counts a graph; they describe, and no score reads them."""
        n = lambda df, name: df.groupBy(g).agg(F.count("*").alias(name))
        kinds = G.triple_class(self.triples)
        sign, use, arcs = self._signature, self._usage, self.expressions
        roster = self.roster.groupBy(g).agg(*[F.count_if(c("role") == r).alias(f"roster_{r}") for r in ROLES], *[F.count_if((c("role") == r) & (c("d") > 0)).alias(f"anchored_{r}") for r in ROLES])
        typed = _union(self.typing.select(g, F.lit(1).alias("x")))
        primary = _union(sign[0].select(g), arcs["arcs"].select(g), use[0].select(g), self.attributes.select(g), typed.select(g))
        sub = self.placed.groupBy(g).agg(F.sum("pairs").alias("comparability_pairs"))
        tables = [
            n(self.triples, "triples"), n(kinds.filter("kind = 'connective'"), "connective_axioms"), n(kinds.filter("kind = 'declaration'"), "declarations"), roster, n(primary, "primary_anchor_axioms"),
            n(sign[0].filter(c("p") == G.DOMAIN), "domains_counted"), n(sign[0].filter(c("p") == G.RANGE), "ranges_counted"), n(arcs["bodies"], "restriction_bodies"), n(arcs["sound"], "wellformed_restrictions"),
            n(use[0], "usage_edges"), n(self.attributes, "attribute_edges"), n(use[1], "dropped_universal_usage"), n(sign[1], "dropped_universal_signature"), n(arcs["dropped"], "dropped_universal_restrictions"),
            sub, n(self.distinct, "distinction_pairs"), n(self._ties.filter("kind = 'same'"), "equivalence_axioms"), n(self.dropped, "dropped_taxonomy_nodes"),
            self.dropped.filter("shape = 'mesh'").groupBy(g).agg(F.countDistinct("comp").alias("dropped_taxonomy_components")),
        ]
        out = self.triples.select(g).distinct()
        for t in tables:
            out = out.join(materialize(t), g, "left")
        out = out.na.fill(0)
        return out.withColumn("counted_anchor_axioms", c("primary_anchor_axioms") + c("comparability_pairs") + c("distinction_pairs"))


def reference_scores(status: DataFrame, scores: DataFrame) -> DataFrame:
    """(graph_id, score): a reference that cannot be parsed has no score; one that says nothing scores 0."""
    x = status.select(g, "status").join(scores.select(g, "score"), g, "left")
    return x.select(g, F.when(c("status") == "parsed", F.coalesce("score", F.lit(0.0))).when(c("status") == "empty", 0.0).alias("score"))
