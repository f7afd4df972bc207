"""Graph operators over triples: vocabulary counts, views, bounded closures, lifting, path tests, components, entailment.

Triples are rows (graph_id, s, s_kind, p, o, o_kind), distinct within a graph. Every operator works on all graphs at once,
keyed by graph_id. Fixpoints write each round to the folder named in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flat, identifier_tokens, local_name
from ..session import discard, materialize
from ..sources.rdf import OWL, RDF, RDFS, XSD
from .fixpoints import components, strong_components, transitive_closure

TYPE, SUB, SUBP, DOMAIN, RANGE = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
EQUIVALENT, DISJOINT, INVERSE = OWL + "equivalentClass", OWL + "disjointWith", OWL + "inverseOf"
ANY, LITERAL = "urn:sev:Anything", "urn:sev:LiteralValue"
# Types that declare a class or a property for the content gate.
CLASS_TYPES = [OWL + "Class", RDFS + "Class"]
PROPERTY_TYPES = [OWL + x for x in ("ObjectProperty", "DatatypeProperty", "FunctionalProperty", "InverseFunctionalProperty", "TransitiveProperty", "SymmetricProperty")] + [RDF + "Property", RDFS + "Property"]
# Predicates that only document.
SKOS, DCTERMS, DC = "http://www.w3.org/2004/02/skos/core#", "http://purl.org/dc/terms/", "http://purl.org/dc/elements/1.1/"
ANNOTATIONS = [RDFS + x for x in ("label", "comment", "seeAlso", "isDefinedBy")] + [OWL + x for x in ("versionInfo", "priorVersion", "backwardCompatibleWith", "incompatibleWith", "deprecated")]
ANNOTATIONS += [SKOS + x for x in ("definition", "note", "prefLabel", "altLabel", "scopeNote", "editorialNote", "example", "changeNote", "historyNote", "hiddenLabel")]
ANNOTATIONS += [DCTERMS + x for x in ("title", "description", "abstract", "license", "rights")] + [DC + x for x in ("title", "description", "rights")]
ANNOTATIONS += ["http://purl.org/vocab/vann/preferredNamespacePrefix", "http://purl.org/vocab/vann/preferredNamespaceUri", "http://schema.org/name", "http://schema.org/description"]
# Types that only declare; those of classes and of properties are wider than for the content gate.
DECLARED_CLASS = [*CLASS_TYPES, SKOS + "Concept", RDFS + "Klass"]
DECLARED_PROPERTY = [*PROPERTY_TYPES, *[OWL + x for x in ("AnnotationProperty", "AsymmetricProperty", "ReflexiveProperty", "IrreflexiveProperty")]]
DECLARATIONS = [*DECLARED_CLASS, *DECLARED_PROPERTY, *[OWL + x for x in ("NamedIndividual", "Thing", "Ontology", "Restriction", "AllDisjointClasses", "AllDifferent", "Axiom")]]
# Predicates of class expressions, and all that belong to the language's own structure.
FILLERS = [OWL + x for x in ("someValuesFrom", "allValuesFrom", "onClass", "onDataRange", "hasValue")]
CARDINALITIES = [OWL + x for x in ("cardinality", "minCardinality", "maxCardinality", "qualifiedCardinality", "minQualifiedCardinality", "maxQualifiedCardinality")]
HOLDERS = [SUB, EQUIVALENT, DISJOINT]
STRUCTURAL = [TYPE, SUB, SUBP, DOMAIN, RANGE, RDF + "first", RDF + "rest", *FILLERS, *CARDINALITIES, EQUIVALENT, DISJOINT, INVERSE]
STRUCTURAL += [OWL + x for x in ("equivalentProperty", "sameAs", "propertyDisjointWith", "differentFrom", "unionOf", "intersectionOf", "complementOf", "oneOf", "disjointUnionOf", "onProperty", "propertyChainAxiom", "hasKey", "members", "distinctMembers")]
STRUCTURAL += [OWL + x for x in ("imports", "withRestrictions", "onDatatype", "annotatedSource", "annotatedProperty", "annotatedTarget")]
# Rungs of plain path evidence, best first, with their credit; ``sev`` has the whole ladder.
# Doubt by number of incidences, in 270ths.
DOUBT = [270, 9, 4, 1, 0]
c = F.col


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def is_named(term: Column, kind: Column) -> Column:
    return (kind == "iri") & ~term.startswith(RDF) & ~term.startswith(RDFS) & ~term.startswith(OWL) & ~term.startswith(XSD)


def ontometrics(t: DataFrame) -> DataFrame:
    """Counts a graph, and three ratios that are 0 where their denominator is."""
    typed = lambda *kinds: F.countDistinct(F.when((c("p") == TYPE) & c("o").isin(*kinds), c("s")))
    axioms = lambda p: F.count_if(c("p") == p)
    out = t.groupBy("graph_id").agg(
        F.count("*").alias("triples_count"), typed(OWL + "Class").alias("classes_count"), typed(OWL + "ObjectProperty").alias("object_properties_count"),
        typed(OWL + "DatatypeProperty").alias("datatype_properties_count"), typed(OWL + "AnnotationProperty").alias("annotation_properties_count"), typed(OWL + "NamedIndividual").alias("individuals_count"),
        axioms(SUB).alias("subclass_axioms"), axioms(EQUIVALENT).alias("equivalence_axioms"), axioms(DISJOINT).alias("disjoint_axioms"), typed(OWL + "Restriction").alias("restriction_axioms"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({
        "attribute_richness": ratio(c("datatype_properties_count"), c("classes_count")),
        "relationship_richness": ratio(c("object_properties_count"), c("subclass_axioms") + c("object_properties_count")),
        "avg_subclass_per_class": ratio(c("subclass_axioms"), c("classes_count")),
    })


def declared_vocabulary(t: DataFrame) -> DataFrame:
    """(graph_id, class_terms, property_terms), counted generously."""
    typed = c("p") == TYPE
    pair = c("p").isin(SUB, EQUIVALENT, DISJOINT)
    cls = F.array_compact(F.array(F.when(typed & c("o").isin(CLASS_TYPES) | pair, c("s")), F.when(pair, c("o"))))
    prop = F.array_compact(F.array(F.when(typed & c("o").isin(PROPERTY_TYPES) | c("p").isin(DOMAIN, RANGE, SUBP), c("s")), F.when(c("p") == OWL + "onProperty", c("o"))))
    rows = t.select("graph_id", F.explode_outer(F.concat(F.transform(cls, lambda x: F.struct(F.lit("c").alias("k"), x.alias("x"))), F.transform(prop, lambda x: F.struct(F.lit("p").alias("k"), x.alias("x"))))).alias("r"))
    return rows.groupBy("graph_id").agg(F.countDistinct(F.when(c("r.k") == "c", c("r.x"))).alias("class_terms"), F.countDistinct(F.when(c("r.k") == "p", c("r.x"))).alias("property_terms"))


def triple_class(t: DataFrame) -> DataFrame:
    """``kind``: annotation, declaration or connective."""
    return t.withColumn("kind", F.when(c("p").isin(ANNOTATIONS), "annotation").when((c("p") == TYPE) & c("o").isin(DECLARATIONS), "declaration").otherwise("connective"))


def schema_view(t: DataFrame) -> DataFrame:
    """(graph_id, term, role): class, objprop or dataprop, also where a position in an axiom implies it; properties win over classes."""
    pos = t.filter(c("p").isin(TYPE, SUB, DOMAIN, RANGE, *[OWL + x for x in ("someValuesFrom", "allValuesFrom", "onClass")]))
    declared = c("o").isin(CLASS_TYPES)
    meta = reduce(lambda a, b: a | b, [c("o").startswith(n) for n in (RDF, RDFS, OWL, XSD)])
    subjects = pos.filter((c("s_kind") == "iri") & (c("p") == TYPE) & declared).select("graph_id", c("s").alias("term"))
    objects = pos.filter((c("o_kind") == "iri") & ~meta).select("graph_id", c("o").alias("term"))
    classes = _union(subjects, objects)
    typed = lambda kind, role: t.filter((c("p") == TYPE) & (c("o") == OWL + kind) & (c("s_kind") == "iri")).select("graph_id", c("s").alias("term"), F.lit(role).alias("role"))
    used = t.filter(is_named(c("p"), F.lit("iri"))).groupBy("graph_id", c("p").alias("term")).agg(F.min(c("o_kind") == "literal").alias("lit")).select("graph_id", "term", F.when(c("lit"), "dataprop").otherwise("objprop").alias("role"))
    anchored = t.filter(c("p").isin(DOMAIN, RANGE) & (c("s_kind") == "iri")).select("graph_id", c("s").alias("term"), F.lit("objprop").alias("role"))
    explicit = _union(typed("ObjectProperty", "objprop"), typed("DatatypeProperty", "dataprop"))
    implied = _union(used, anchored).join(explicit.select("graph_id", "term"), ["graph_id", "term"], "left_anti")
    props = _union(explicit, implied).groupBy("graph_id", "term").agg(F.max(F.struct((c("role") == "dataprop").cast("int").alias("d"), c("role").alias("role"))).alias("r")).select("graph_id", "term", "r.role")
    only = classes.distinct().join(props.select("graph_id", "term"), ["graph_id", "term"], "left_anti").withColumn("role", F.lit("class"))
    return _union(props, only).filter(is_named(c("term"), F.lit("iri"))).distinct()


def bounded_closure(edges: DataFrame, depth: int) -> DataFrame:
    """(graph_id, a, b, d): what a reaches in at most ``depth`` steps with the fewest steps d, without itself; joins are unrolled."""
    step = edges.select("graph_id", "a", "b").distinct()
    reached = front = step.withColumn("d", F.lit(1))
    for d in range(2, depth + 1):
        front = front.alias("f").join(step.alias("e"), (c("f.graph_id") == c("e.graph_id")) & (c("f.b") == c("e.a"))).select("f.graph_id", "f.a", "e.b").distinct().withColumn("d", F.lit(d))
        reached = reached.unionByName(front)
    return reached.filter("a <> b").groupBy("graph_id", "a", "b").agg(F.min("d").alias("d"))


def class_edges(t: DataFrame, up: bool) -> DataFrame:
    """Steps to superclasses (also over equivalence, as it is stated), or to subclasses (over subClassOf only)."""
    named = t.filter((c("s_kind") == "iri") & (c("o_kind") == "iri"))
    sub = named.filter(c("p") == SUB)
    if not up:
        return sub.select("graph_id", c("o").alias("a"), c("s").alias("b"))
    same = named.filter(c("p") == EQUIVALENT)
    return _union(sub.select("graph_id", c("s").alias("a"), c("o").alias("b")), same.select("graph_id", c("s").alias("a"), c("o").alias("b")))


def ancestors(t: DataFrame) -> DataFrame:
    return bounded_closure(class_edges(t, True), 4)


def descendants(t: DataFrame) -> DataFrame:
    return bounded_closure(class_edges(t, False), 4)


def superproperties(t: DataFrame) -> DataFrame:
    return bounded_closure(t.filter((c("p") == SUBP) & (c("s_kind") == "iri") & (c("o_kind") == "iri")).select("graph_id", c("s").alias("a"), c("o").alias("b")), 3)


def universal_hubs(t: DataFrame, view: DataFrame | None = None, down: DataFrame | None = None) -> DataFrame:
    """(graph_id, term): classes with at least four proper descendants that are more than half of all classes.

    ``view`` and ``down`` (its ``schema_view`` and ``descendants``) save making them again.
    """
    view = schema_view(t) if view is None else view
    classes = view.filter("role = 'class'").groupBy("graph_id").agg(F.count("*").alias("n"))
    below = (descendants(t) if down is None else down).groupBy("graph_id", "a").agg(F.count("*").alias("k"))
    below = below.join(view.filter("role = 'class'").select("graph_id", c("term").alias("a")), ["graph_id", "a"], "left_semi")
    return below.join(classes, "graph_id").filter((c("k") >= 4) & (2 * c("k") > c("n"))).select("graph_id", c("a").alias("term"))


def cone(t: DataFrame) -> DataFrame:
    """(graph_id, a, b): ancestors and descendants, without language terms and hubs."""
    both = _union(ancestors(t), descendants(t)).select("graph_id", "a", "b").distinct()
    return both.filter(is_named(c("b"), F.lit("iri"))).join(universal_hubs(t).withColumnRenamed("term", "b"), ["graph_id", "b"], "left_anti").select("graph_id", "a", "b")


def endpoints(t: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """(graph_id, prop, side, end): declared domains and ranges, also of super-properties; hubs and Thing are open, datatypes literal."""
    own = t.filter(c("p").isin(DOMAIN, RANGE) & (c("o_kind") == "iri")).select("graph_id", c("s").alias("prop"), F.when(c("p") == DOMAIN, "domain").otherwise("range").alias("side"), c("o").alias("end"))
    above = superproperties(t).select("graph_id", c("a").alias("sub"), c("b").alias("prop"))
    inherited = own.join(above, ["graph_id", "prop"]).select("graph_id", c("sub").alias("prop"), "side", "end")
    hubs = universal_hubs(t) if hubs is None else hubs
    return opened(_union(own, inherited), "end", hubs).distinct()


def opened(df: DataFrame, end: str, hubs: DataFrame) -> DataFrame:
    """``df`` (with graph_id) with its ends as nodes of the schema: hubs and Thing are open, datatypes literal."""
    hub = hubs.select("graph_id", c("term").alias(end), F.lit(True).alias("__hub"))
    as_node = F.when((c(end) == OWL + "Thing") | c("__hub"), ANY).when(c(end).contains("XMLSchema"), LITERAL).otherwise(c(end))
    return df.join(hub, ["graph_id", end], "left").withColumn(end, as_node).select(*df.columns)


def lift(t: DataFrame, view: DataFrame | None = None, ends: DataFrame | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """(graph_id, a, p, b): schema edges: every domain with every range; an inverse and a symmetric property turn them round.

    A class expression ties what stands beside it (below or above it, or as its equivalent) by each of its properties to each of its named fillers, to
    an open end without one. All ends are nodes in the sense of ``opened``.
    """
    hubs = materialize(universal_hubs(t)) if hubs is None else hubs
    props = (schema_view(t) if view is None else view).filter("role <> 'class'").select("graph_id", c("term").alias("prop"), "role")
    ends = materialize(endpoints(t, hubs)) if ends is None else ends  # read twice
    side = lambda s: ends.filter(c("side") == s).select("graph_id", "prop", c("end").alias(s))
    e = props.join(side("domain"), ["graph_id", "prop"], "left").join(side("range"), ["graph_id", "prop"], "left")
    edges = e.select("graph_id", F.coalesce("domain", F.lit(ANY)).alias("a"), c("prop").alias("p"), F.coalesce("range", F.when(c("role") == "dataprop", LITERAL).otherwise(ANY)).alias("b"))
    inv = t.filter(c("p") == INVERSE).select("graph_id", c("s").alias("p"), c("o").alias("q"))
    inv = _union(inv, inv.select("graph_id", c("q").alias("p"), c("p").alias("q")))
    sym = t.filter((c("p") == TYPE) & (c("o") == OWL + "SymmetricProperty")).select("graph_id", c("s").alias("p"), c("s").alias("q"))
    turned = edges.join(_union(inv, sym).distinct(), ["graph_id", "p"]).select("graph_id", c("b").alias("a"), c("q").alias("p"), c("a").alias("b"))
    named = t.filter("o_kind = 'iri'")
    on = named.filter(c("p") == OWL + "onProperty").select("graph_id", c("s").alias("x"), c("o").alias("p")).distinct()
    fill = named.filter(c("p").isin([f for f in FILLERS if f != OWL + "hasValue"])).select("graph_id", c("s").alias("x"), c("o").alias("b")).distinct()
    under = t.filter(c("p").isin(SUB, EQUIVALENT) & (c("s_kind") == "iri")).select("graph_id", c("s").alias("a"), c("o").alias("x"))
    over = named.filter((c("p") == SUB) & (c("s_kind") == "bnode")).select("graph_id", c("o").alias("a"), c("s").alias("x"))
    tied = _union(under, over).join(on, ["graph_id", "x"]).join(fill, ["graph_id", "x"], "left").select("graph_id", "a", "p", F.coalesce("b", F.lit(ANY)).alias("b"))
    restricted = opened(opened(tied, "a", hubs), "b", hubs)
    return _union(edges, turned, restricted).distinct()


def index(t: DataFrame) -> DataFrame:
    """(graph_id, term, tokens, flats): searchable words of a term's local name and labels, not of comments."""
    named = _union(t.select("graph_id", c("s").alias("term"), c("s_kind").alias("k")), t.select("graph_id", c("o").alias("term"), c("o_kind").alias("k"))).filter(is_named(c("term"), c("k"))).select("graph_id", "term").distinct()
    label = t.filter(c("p").isin(RDFS + "label", SKOS + "prefLabel", SKOS + "altLabel") & (c("o_kind") == "literal")).select("graph_id", c("s").alias("term"), c("o").alias("name"))
    names = _union(named.withColumn("name", local_name(c("term"))), label.join(named, ["graph_id", "term"], "left_semi").select("graph_id", "term", "name"))
    return names.groupBy("graph_id", "term").agg(F.array_distinct(F.flatten(F.collect_list(identifier_tokens(c("name"))))).alias("tokens"), F.array_sort(F.collect_set(flat(c("name")))).alias("flats"))


def judged(edges: DataFrame, loops: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (graph_id, p, a, b, root) with the component of their predicate, and (graph_id, p, root) of the components that say nothing.

    Those are complete, or complete between two sides, with at least three edges. Edges of a node to itself are left out unless
    ``loops`` says that they count.
    """
    named = edges.select(F.concat_ws("\u0001", "graph_id", "p").alias("graph_id"), "a", "b").distinct()
    named = named if loops else named.filter("a <> b")
    e = materialize(named.join(components(named).withColumnRenamed("node", "a"), ["graph_id", "a"]))
    ends = e.select("graph_id", "root", F.explode(F.array(F.struct(F.lit("s").alias("k"), c("a").alias("x")), F.struct(F.lit("t").alias("k"), c("b").alias("x")))).alias("r"))
    per = ends.groupBy("graph_id", "root", "r.x").agg(F.max(c("r.k") == "s").alias("s"), F.max(c("r.k") == "t").alias("t"))
    size = per.groupBy("graph_id", "root").agg(F.count("*").alias("n"), F.count_if("s").alias("s"), F.count_if("t").alias("t"))
    m = e.groupBy("graph_id", "root").agg(F.count("*").alias("m"))
    full = (c("n") >= 3) & (c("m") == c("n") * (c("n") - 1)) | (c("s") >= 2) & (c("t") >= 2) & (c("s") * c("t") >= 6) & (c("m") == c("s") * c("t")) & (c("n") == c("s") + c("t"))
    parts = F.split("graph_id", "\u0001")
    split = lambda df, *more: df.select(parts[0].alias("graph_id"), parts[1].alias("p"), *more, "root")
    return split(e, "a", "b"), split(m.join(size, ["graph_id", "root"]).filter((c("m") >= 3) & full))


def uninformative(edges: DataFrame) -> DataFrame:
    """(graph_id, p, root): components of a predicate that are complete, or complete between two sides, and so say nothing."""
    return judged(edges)[1]


def roles(t: DataFrame) -> DataFrame:
    """(graph_id, term, role): property, class, individual or ambiguous, by where a term stands and never by its name.

    Strong signs of a class (a declaration, a typed member, an end of a property, a filler) against any sign of a property make
    a term ambiguous; against weak ones (a place under or beside another class, a concept) the property wins. Other subjects are individuals.
    """
    x = triple_class(t)
    own, typed, ends, holds = c("kind") == "connective", c("p") == TYPE, c("p").isin(DOMAIN, RANGE), c("p").isin(HOLDERS)
    sides, fills = c("p").isin(SUBP, OWL + "equivalentProperty", INVERSE, OWL + "propertyDisjointWith"), c("p").isin([f for f in FILLERS if f != OWL + "hasValue"])
    no = F.lit(False)

    def at(df, term, p, c_, w):  # each end of a triple is read once, with all the signs that it gives
        return df.select("graph_id", c(term).alias("term"), *[F.coalesce(s, no).alias(k) for k, s in (("p", p), ("c", c_), ("w", w))])

    subject = at(x.filter("s_kind = 'iri'"), "s", typed & c("o").isin(DECLARED_PROPERTY) | own & (sides | ends), typed & c("o").isin(*CLASS_TYPES, RDFS + "Klass"), typed & (c("o") == SKOS + "Concept") | own & holds)
    of = at(x.filter("o_kind = 'iri'"), "o", own & (sides | (c("p") == OWL + "onProperty")), own & (typed & (c("s_kind") == "iri") | ends | fills), own & holds).filter("p or c or w")
    used = at(x.filter(own & ~c("p").isin(STRUCTURAL)), "p", F.lit(True), no, no)
    rows = _union(subject, of, used).filter(is_named(c("term"), F.lit("iri")))
    k = rows.groupBy("graph_id", "term").agg(*[F.max(k).alias(k) for k in "pcw"])
    return k.select("graph_id", "term", F.when(c("p") & c("c"), "ambiguous").when(c("p"), "property").when(c("c") | c("w"), "class").otherwise("individual").alias("role"))


def formal_quality(t: DataFrame) -> DataFrame:
    """Shares of declared classes and properties with a label, a comment, and (properties) domain and range."""
    term = t.filter((c("p") == TYPE) & c("o").isin(*CLASS_TYPES, *PROPERTY_TYPES)).select("graph_id", "s", c("o").isin(PROPERTY_TYPES).alias("is_property")).distinct()
    has = t.groupBy("graph_id", "s").agg(*[F.max(c("p") == p).alias(k) for k, p in (("label", RDFS + "label"), ("comment", RDFS + "comment"), ("domain", DOMAIN), ("range", RANGE))])
    x = term.join(has, ["graph_id", "s"])
    share = lambda cond: F.coalesce(F.avg(F.when(cond, 1.0).otherwise(0.0)), F.lit(0.0))
    both = F.coalesce(F.avg(F.when(c("is_property"), F.when(c("domain") & c("range"), 1.0).otherwise(0.0))), F.lit(0.0))
    return x.groupBy("graph_id").agg(F.count("*").alias("terms"), share(c("label")).alias("label_share"), share(c("comment")).alias("comment_share"), both.alias("domain_range_share"))


def vacuous(t: DataFrame) -> DataFrame:
    """(graph_id, vacuous): whether a graph has no connective axiom."""
    return triple_class(t).groupBy("graph_id").agg((F.count_if(c("kind") == "connective") == 0).alias("vacuous"))


def usage_edges(t: DataFrame, depth: int = 12) -> DataFrame:
    """(graph_id, s, p, o, o_kind): edges of the domain's own predicates between named terms and to literals; blank nodes are seen through.

    ``s -p-> blank -q-> o`` is an edge by q; items of a list keep the predicate that leads to the list. Blank nodes behind a
    predicate of the language (a class expression, a list of it) make no edges. Chains have at most ``depth`` + 1 blank nodes.
    """
    own = triple_class(t).filter("kind = 'connective'").select("graph_id", "s", "s_kind", "p", "o", "o_kind")
    front = own.filter("s_kind = 'iri'").select("graph_id", "s", "p", "o", "o_kind")
    ends = lambda df: df.filter(~c("p").isin(STRUCTURAL) & ((c("o_kind") == "literal") | (c("o_kind") == "iri") & (c("o") != c("s")))).select("graph_id", "s", "p", "o", "o_kind")
    inner = own.filter("s_kind = 'bnode'").select("graph_id", c("s").alias("o"), c("p").alias("q"), c("o").alias("next"), c("o_kind").alias("k"))
    inner = materialize(inner)
    done, held = ends(front), []
    listed = c("q").isin(RDF + "first", RDF + "rest")
    for _ in range(depth + 1):
        step = front.filter("o_kind = 'bnode'").drop("o_kind").join(inner, ["graph_id", "o"]).filter(listed | ~c("p").isin(STRUCTURAL))
        front = materialize(step.select("graph_id", "s", F.when(listed, c("p")).otherwise(c("q")).alias("p"), c("next").alias("o"), c("k").alias("o_kind")).distinct())
        held.append(front)
        if front.isEmpty():
            break
        done = done.unionByName(ends(front))
    out = materialize(done.distinct())
    discard(inner, *held)
    return out


def expressions(t: DataFrame, is_class: DataFrame, is_property: DataFrame) -> dict[str, DataFrame]:
    """What anonymous class expressions say, arc by arc, of terms that a graph introduces (``is_class``, ``is_property``: graph_id, entity).

    ``arcs`` (graph_id, entity, body, arc): holder, property and filler of every body each get an arc, one for each triple that
    leads there. The two relations that bodies induce, of holders with properties (attachment) and of properties with fillers,
    are judged like a predicate; bodies of a pair that says nothing have no arcs. ``dropped`` are those pairs, ``bodies`` the blank nodes with a
    property, and ``sound`` those of one property, with a filler that is a class or a cardinality, held by a class.
    """
    g = "graph_id"
    own = triple_class(t).filter("kind = 'connective'")
    of = lambda term, kind: F.when(c(kind) == "iri", c(term)).otherwise(F.concat_ws(" ", c(kind), c(term)))
    inner = materialize(own.filter("s_kind = 'bnode'").select(g, c("s").alias("body"), "p", "o", "o_kind"))
    on = inner.filter(c("p") == OWL + "onProperty").select(g, "body", of("o", "o_kind").alias("prop"), (c("o_kind") == "iri").alias("named"))
    fill = inner.filter(c("p").isin(FILLERS)).select(g, "body", "p", of("o", "o_kind").alias("filler"), (c("o_kind") == "iri").alias("named"))
    held = own.filter(c("p").isin(HOLDERS) & (c("o_kind") == "bnode")).select(g, c("o").alias("body"), "p", of("s", "s_kind").alias("holder"), (c("s_kind") == "iri").alias("named"))
    held = materialize(held.join(inner.select(g, "body").distinct(), [g, "body"], "left_semi"))
    attach = held.select(g, "body", "holder").join(on.select(g, "body", "prop"), [g, "body"]).select(g, F.lit("attachment").alias("p"), "body", c("holder").alias("a"), c("prop").alias("b")).distinct()
    leads = on.select(g, "body", "prop").join(fill.select(g, "body", "filler"), [g, "body"]).select(g, F.lit("filler").alias("p"), "body", c("prop").alias("a"), c("filler").alias("b")).distinct()
    pairs = materialize(_union(attach, leads))
    every, bad = judged(pairs, loops=True)
    dropped = materialize(every.join(bad, [g, "p", "root"], "left_semi").select(g, "p", "a", "b"))
    dead = pairs.join(dropped, [g, "p", "a", "b"], "left_semi").select(g, "body").distinct()
    known = lambda df, term, terms: df.filter("named").join(terms.select(g, c("entity").alias(term)), [g, term], "left_semi").select(g, "body", c(term).alias("entity"))
    ends = [(known(held, "holder", is_class), "holder"), (known(on, "prop", is_property), "property"), (known(fill, "filler", is_class), "filler")]
    arcs = _union(*[df.withColumn("arc", F.lit(arc)) for df, arc in ends]).join(dead, [g, "body"], "left_anti").select(g, "entity", "body", "arc")
    bodies = on.select(g, "body").distinct()
    filled = _union(ends[2][0].select(g, "body"), inner.filter(c("p").isin(CARDINALITIES)).select(g, "body")).distinct()
    one = on.groupBy(g, "body").agg(F.count("*").alias("n")).filter("n = 1").select(g, "body").join(ends[1][0], [g, "body"], "left_semi")
    sound = one.join(filled, [g, "body"], "left_semi").join(ends[0][0], [g, "body"], "left_semi")
    return {"arcs": materialize(arcs), "dropped": dropped, "bodies": bodies, "sound": sound}


def load_bearing(t: DataFrame) -> DataFrame:
    """(graph_id, s, p, o): connective triples, those that neither document nor only declare."""
    return triple_class(t).filter("kind = 'connective'").select("graph_id", "s", "p", "o")
