"""Graph operators over triples that the test tables stand for: regions hold nations, nations hold customers, parts are properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import camel_split, local_name, looks_like_turtle, words
from ..operators import entailment
from ..operators import graph as G
from ..operators import sev as V
from ..sources import rdf
from ._bind import catalogue, read

QUERIES, ORACLES, _add = catalogue()
c = F.col
_T, _S, _D, _R, _P = G.TYPE, G.SUB, G.DOMAIN, G.RANGE, G.SUBP
_OWL, _XSD, _RDFS = rdf.OWL, rdf.XSD, rdf.RDFS
_V = "CAST({} AS STRING)"


def _sql(cast: str) -> str:
    """Triples of all nations, customers, suppliers and parts, each a node of its own.

    Customers, suppliers and properties form trees (half and a third of the key), so paths grow with the logarithm of the tables.
    """
    s = lambda x: f"CAST({x} AS {cast})"
    half = lambda x, by: s(f"CAST(floor({x} / {by}) AS BIGINT)")
    g = f"concat('g', {s('n_regionkey')})"
    n, k, u, p = (f"concat('{x}', {s(key)})" for x, key in (("n", "n_nationkey"), ("k", "c_custkey"), ("s", "s_suppkey"), ("p", "p_partkey")))
    customer, supplier, part = "FROM customer JOIN nation ON c_nationkey = n_nationkey", "FROM supplier JOIN nation ON s_nationkey = n_nationkey", "FROM part JOIN nation ON p_partkey % 25 = n_nationkey"
    return f"""
SELECT {g} AS graph_id, {n} AS s, 'iri' AS s_kind, '{_S}' AS p, concat('r', {s('n_regionkey')}) AS o, 'iri' AS o_kind FROM nation
UNION SELECT {g}, {n}, 'iri', '{_T}', '{_OWL}Class', 'iri' FROM nation
UNION SELECT {g}, {n}, 'iri', '{_RDFS}label', n_name, 'literal' FROM nation
UNION SELECT {g}, {k}, 'iri', '{_S}', {n}, 'iri' {customer}
UNION SELECT {g}, {k}, 'iri', '{_S}', concat('k', {half('c_custkey', 2)}), 'iri' {customer} WHERE c_custkey > 1
UNION SELECT {g}, {u}, 'iri', '{_T}', {n}, 'iri' {supplier}
UNION SELECT {g}, {u}, 'iri', concat('p', {s('s_suppkey')}), concat('s', {half('s_suppkey', 2)}), 'iri' {supplier}
UNION SELECT {g}, {p}, 'iri', '{_T}', CASE WHEN p_partkey % 4 = 0 THEN '{_OWL}DatatypeProperty' ELSE '{_OWL}ObjectProperty' END, 'iri' {part}
UNION SELECT {g}, {p}, 'iri', '{_D}', {n}, 'iri' {part} WHERE p_partkey % 3 <> 0
UNION SELECT {g}, {p}, 'iri', '{_R}', CASE WHEN p_partkey % 4 = 0 THEN '{_XSD}string' ELSE concat('n', {s('(n_nationkey * 7) % 25')}) END, 'iri' {part} WHERE p_partkey % 5 <> 0
UNION SELECT {g}, {p}, 'iri', '{_P}', concat('p', {half('p_partkey', 3)}), 'iri' {part} WHERE p_partkey % 2 = 0
UNION SELECT {g}, {p}, 'iri', '{_RDFS}comment', p_name, 'literal' {part}"""


T = f"WITH RECURSIVE t AS MATERIALIZED ({_sql('VARCHAR')}) "


def triples(spark, sf_dir):
    for x in ("nation", "customer", "supplier", "part"):
        read(spark, sf_dir, x).createOrReplaceTempView(x)
    return spark.sql(_sql("STRING"))


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _ty(*kinds):
    return f"count(DISTINCT CASE WHEN p = '{_T}' AND o IN {_IN([_OWL + k for k in kinds])} THEN s END)"


@_add("agg_ontometrics", T + f"""SELECT *, CASE WHEN classes_count = 0 THEN 0.0E0 ELSE round(datatype_properties_count::DOUBLE / classes_count, 9) END AS attribute_richness,
 CASE WHEN subclass_axioms + object_properties_count = 0 THEN 0.0E0 ELSE round(object_properties_count::DOUBLE / (subclass_axioms + object_properties_count), 9) END AS relationship_richness, CASE WHEN classes_count = 0 THEN 0.0E0 ELSE round(subclass_axioms::DOUBLE / classes_count, 9) END AS avg_subclass_per_class FROM
 (SELECT graph_id, count(*) AS triples_count, {_ty('Class')} AS classes_count, {_ty('ObjectProperty')} AS object_properties_count, {_ty('DatatypeProperty')} AS datatype_properties_count, {_ty('AnnotationProperty')} AS annotation_properties_count, {_ty('NamedIndividual')} AS individuals_count,
  count(*) FILTER (WHERE p = '{_S}') AS subclass_axioms, count(*) FILTER (WHERE p = '{G.EQUIVALENT}') AS equivalence_axioms, count(*) FILTER (WHERE p = '{G.DISJOINT}') AS disjoint_axioms, {_ty('Restriction')} AS restriction_axioms FROM t GROUP BY graph_id)""")
def ontometrics(spark, sf_dir):
    m = G.ontometrics(triples(spark, sf_dir))
    return m.withColumns({k: F.round(k, 9) for k in ("attribute_richness", "relationship_richness", "avg_subclass_per_class")})


@_add("agg_declared_vocab", T + f""", v AS (SELECT graph_id, 'c' AS k, s AS x FROM t WHERE p = '{_T}' AND o IN {_IN(G.CLASS_TYPES)} OR p IN ('{_S}', '{G.EQUIVALENT}', '{G.DISJOINT}') UNION SELECT graph_id, 'c', o FROM t WHERE p IN ('{_S}', '{G.EQUIVALENT}', '{G.DISJOINT}')
 UNION SELECT graph_id, 'p', s FROM t WHERE p = '{_T}' AND o IN {_IN(G.PROPERTY_TYPES)} OR p IN ('{_D}', '{_R}', '{_P}')) SELECT graph_id, count(*) FILTER (WHERE k = 'c') AS class_terms, count(*) FILTER (WHERE k = 'p') AS property_terms FROM v GROUP BY graph_id""")
def declared_vocab(spark, sf_dir):
    return G.declared_vocabulary(triples(spark, sf_dir))


@_add("pred_triple_class", T + f"SELECT CASE WHEN p IN {_IN(G.ANNOTATIONS)} THEN 'annotation' WHEN p = '{_T}' AND o IN {_IN(G.DECLARATIONS)} THEN 'declaration' ELSE 'connective' END AS kind, count(*) AS n FROM t GROUP BY 1")
def triple_class(spark, sf_dir):
    return G.triple_class(triples(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@_add("g_vacuous", T + f"SELECT graph_id, count(*) FILTER (WHERE p NOT IN {_IN(G.ANNOTATIONS)} AND NOT (p = '{_T}' AND o IN {_IN(G.DECLARATIONS)})) = 0 AS vacuous FROM t GROUP BY graph_id")
def vacuous(spark, sf_dir):
    return G.vacuous(triples(spark, sf_dir))


def _reach(p, depth, swap=False):
    a, b = ("o", "s") if swap else ("s", "o")
    return f"e AS (SELECT DISTINCT graph_id, {a} AS a, {b} AS b FROM t WHERE p = '{p}'), w AS (SELECT graph_id, a, b, 1 AS d FROM e UNION SELECT w.graph_id, w.a, e.b, d + 1 FROM w JOIN e ON w.graph_id = e.graph_id AND w.b = e.a WHERE d < {depth}), z AS (SELECT graph_id, a, b, CAST(min(d) AS BIGINT) AS d FROM w WHERE a <> b GROUP BY graph_id, a, b)"


@_add("g_ancestors", T + f", {_reach(_S, 4)} SELECT * FROM z")
def ancestors(spark, sf_dir):
    return G.ancestors(triples(spark, sf_dir)).withColumn("d", c("d").cast("long"))


@_add("g_descendants", T + f", {_reach(_S, 4, True)} SELECT * FROM z")
def descendants(spark, sf_dir):
    return G.descendants(triples(spark, sf_dir)).withColumn("d", c("d").cast("long"))


@_add("g_superprops", T + f", {_reach(_P, 3)} SELECT * FROM z")
def superprops(spark, sf_dir):
    return G.superproperties(triples(spark, sf_dir)).withColumn("d", c("d").cast("long"))


@_add("g_closure", T + f", e AS (SELECT DISTINCT graph_id, s AS a, o AS b FROM t WHERE p = '{_S}'), w AS (SELECT * FROM e UNION SELECT w.graph_id, w.a, e.b FROM w JOIN e ON w.graph_id = e.graph_id AND w.b = e.a) SELECT * FROM w")
def closure(spark, sf_dir):
    return G.transitive_closure(_sub(spark, sf_dir))


def _sub(spark, sf_dir):
    return triples(spark, sf_dir).filter(c("p") == _S).select("graph_id", c("s").alias("a"), c("o").alias("b"))


_BOTH = f"e AS (SELECT DISTINCT graph_id, s AS a, o AS b FROM t WHERE p = '{_S}'), u AS (SELECT graph_id, a, b FROM e UNION SELECT graph_id, b, a FROM e), w AS (SELECT graph_id, a, b FROM u UNION SELECT w.graph_id, w.a, u.b FROM w JOIN u ON w.graph_id = u.graph_id AND w.b = u.a)"


@_add("g_components", T + f", {_BOTH} SELECT graph_id, a AS node, least(a, min(b)) AS root FROM w GROUP BY graph_id, a")
def components(spark, sf_dir):
    return G.components(_sub(spark, sf_dir))


@_add("g_scc", T + f", e AS (SELECT DISTINCT graph_id, s AS a, o AS b FROM t WHERE p = '{_S}'), w AS (SELECT * FROM e UNION SELECT w.graph_id, w.a, e.b FROM w JOIN e ON w.graph_id = e.graph_id AND w.b = e.a), n AS (SELECT graph_id, a AS x FROM e UNION SELECT graph_id, b FROM e), m AS (SELECT w.graph_id, w.a, w.b FROM w JOIN w v ON w.graph_id = v.graph_id AND w.a = v.b AND w.b = v.a) SELECT n.graph_id, n.x AS node, least(n.x, coalesce(min(m.b), n.x)) AS root FROM n LEFT JOIN m ON n.graph_id = m.graph_id AND n.x = m.a GROUP BY n.graph_id, n.x")
def scc(spark, sf_dir):
    return G.strong_components(_sub(spark, sf_dir))


_VIEW = f"""used AS (SELECT graph_id, p AS term, CASE WHEN bool_and(o_kind = 'literal') THEN 'dataprop' ELSE 'objprop' END AS role FROM t WHERE p NOT LIKE 'http://www.w3.org/%' GROUP BY graph_id, p),
 ex AS (SELECT DISTINCT graph_id, s AS term, CASE o WHEN '{_OWL}ObjectProperty' THEN 'objprop' ELSE 'dataprop' END AS role FROM t WHERE p = '{_T}' AND o IN ('{_OWL}ObjectProperty', '{_OWL}DatatypeProperty')),
 im AS (SELECT * FROM used UNION ALL SELECT graph_id, s, 'objprop' FROM t WHERE p IN ('{_D}', '{_R}')), pr AS (SELECT graph_id, term, min(role) AS role FROM (SELECT * FROM ex UNION ALL SELECT * FROM im ANTI JOIN ex USING (graph_id, term)) GROUP BY graph_id, term),
 cl AS (SELECT graph_id, s AS term FROM t WHERE p = '{_T}' AND o IN {_IN(G.CLASS_TYPES)} UNION SELECT graph_id, o FROM t WHERE p IN ('{_T}', '{_S}', '{_D}', '{_R}') AND o NOT LIKE 'http://www.w3.org/%'),
 vw AS (SELECT graph_id, term, role FROM pr UNION ALL SELECT graph_id, term, 'class' FROM cl ANTI JOIN pr USING (graph_id, term))"""


@_add("g_schema_view", T + f", {_VIEW} SELECT * FROM vw")
def schema_view(spark, sf_dir):
    return G.schema_view(triples(spark, sf_dir))


_HUBS = f"{_reach(_S, 4, True)}, hb AS (SELECT z.graph_id, z.a AS term FROM z JOIN (SELECT graph_id, count(*) AS n FROM vw WHERE role = 'class' GROUP BY graph_id) q USING (graph_id) GROUP BY z.graph_id, z.a, q.n HAVING count(*) >= 4 AND 2 * count(*) > q.n)"


@_add("g_universal_hubs", T + f", {_VIEW}, {_HUBS} SELECT * FROM hb")
def hubs(spark, sf_dir):
    return G.universal_hubs(triples(spark, sf_dir))


@_add("g_cone", T + f", {_VIEW}, {_HUBS}, up AS (SELECT graph_id, b AS a, a AS b FROM z), al AS (SELECT graph_id, a, b FROM z UNION SELECT graph_id, a, b FROM up) SELECT al.* FROM al ANTI JOIN hb ON al.graph_id = hb.graph_id AND al.b = hb.term")
def cone(spark, sf_dir):
    return G.cone(triples(spark, sf_dir))


_ENDS = f"""sp AS (SELECT DISTINCT graph_id, s AS a, o AS b FROM t WHERE p = '{_P}'), sw AS (SELECT graph_id, a, b, 1 AS d FROM sp UNION SELECT sw.graph_id, sw.a, sp.b, d + 1 FROM sw JOIN sp ON sw.graph_id = sp.graph_id AND sw.b = sp.a WHERE d < 3),
 ow AS (SELECT graph_id, s AS prop, CASE p WHEN '{_D}' THEN 'domain' ELSE 'range' END AS side, o AS e0 FROM t WHERE p IN ('{_D}', '{_R}')), ih AS (SELECT * FROM ow UNION SELECT sw.graph_id, sw.a, ow.side, ow.e0 FROM sw JOIN ow ON sw.graph_id = ow.graph_id AND sw.b = ow.prop AND sw.a <> sw.b),
 en AS (SELECT DISTINCT ih.graph_id, prop, side, CASE WHEN hb.term IS NOT NULL THEN '{G.ANY}' WHEN starts_with(e0, '{_XSD}') THEN '{G.LITERAL}' ELSE e0 END AS "end" FROM ih LEFT JOIN hb ON ih.graph_id = hb.graph_id AND ih.e0 = hb.term)"""


@_add("g_endpoint", T + f", {_VIEW}, {_HUBS}, {_ENDS} SELECT * FROM en")
def endpoint(spark, sf_dir):
    return G.endpoints(triples(spark, sf_dir))


@_add("g_declared_endpoints", T + f", {_VIEW}, {_HUBS}, {_ENDS} SELECT graph_id, prop, count(*) FILTER (WHERE side = 'domain') AS n_domains, count(*) FILTER (WHERE side = 'range') AS n_ranges FROM en GROUP BY graph_id, prop")
def declared_endpoints(spark, sf_dir):
    return G.endpoints(triples(spark, sf_dir)).groupBy("graph_id", "prop").agg(F.count_if(c("side") == "domain").alias("n_domains"), F.count_if(c("side") == "range").alias("n_ranges"))


_LIFT = f"""pp AS (SELECT graph_id, term AS prop, role FROM vw WHERE role <> 'class'), dd AS (SELECT graph_id, prop, "end" AS a FROM en WHERE side = 'domain'), rr AS (SELECT graph_id, prop, "end" AS b FROM en WHERE side = 'range'),
 lf AS (SELECT DISTINCT pp.graph_id, coalesce(a, '{G.ANY}') AS a, pp.prop AS p, coalesce(b, CASE role WHEN 'dataprop' THEN '{G.LITERAL}' ELSE '{G.ANY}' END) AS b FROM pp LEFT JOIN dd USING (graph_id, prop) LEFT JOIN rr USING (graph_id, prop))"""


@_add("g_lift", T + f", {_VIEW}, {_HUBS}, {_ENDS}, {_LIFT} SELECT * FROM lf")
def lift(spark, sf_dir):
    return G.lift(triples(spark, sf_dir))


# wanted: every pair of a graph's declared classes, and of each class a literal, a term outside the graph, and one of a derived signature
_WANTED = f"""k AS (SELECT DISTINCT graph_id AS g, s AS x FROM t WHERE p = '{_T}' AND o = '{_OWL}Class'), q AS (SELECT i.g, i.x || '>' || j.x AS q, i.x AS a, j.x AS b, 'slot' AS mode, false AS derived FROM k i JOIN k j ON i.g = j.g AND i.x <> j.x
 UNION ALL SELECT g, x || '>literal', x, '{G.LITERAL}', 'literal', false FROM k UNION ALL SELECT g, x || '>external', x, NULL, 'external', false FROM k UNION ALL SELECT g, x || '>derived', x, NULL, 'external', true FROM k)"""
_SPEC = f"""fo AS (SELECT graph_id, prop, greatest(count(DISTINCT "end") FILTER (WHERE side = 'domain'), 1) * greatest(count(DISTINCT "end") FILTER (WHERE side = 'range'), 1) AS n FROM en WHERE "end" NOT IN ('{G.ANY}', '{G.LITERAL}') GROUP BY graph_id, prop),
 sp2 AS (SELECT pp.graph_id, pp.prop, CASE WHEN coalesce(n, 1) <= 4 THEN 1.0E0 ELSE round(4.0E0 / n, 6) END AS spec FROM pp LEFT JOIN fo USING (graph_id, prop)), le AS (SELECT DISTINCT lf.graph_id AS g, a AS u, b AS v, spec FROM lf JOIN sp2 ON lf.graph_id = sp2.graph_id AND lf.p = sp2.prop)"""
_LEGS = f"""lg AS (SELECT g, u AS z, v AS x, 'out' AS k, spec FROM le UNION SELECT g, v, u, 'in', spec FROM le), lx AS (SELECT * FROM lg WHERE x NOT IN ('{G.ANY}', '{G.LITERAL}') AND x <> z),
 two AS (SELECT DISTINCT q.g, q.q, l.spec AS s1, r.spec AS s2 FROM q JOIN lx l ON q.g = l.g AND q.a = l.z JOIN lx r ON q.g = r.g AND q.b = r.z AND l.x = r.x WHERE NOT (l.k = 'in' AND r.k = 'out')),
 st AS (SELECT DISTINCT g, u, v FROM le WHERE u NOT IN ('{G.ANY}', '{G.LITERAL}') AND v NOT IN ('{G.ANY}', '{G.LITERAL}')), three AS (SELECT DISTINCT q.g, q.q FROM q JOIN st x ON q.g = x.g AND q.a = x.u JOIN st y ON x.g = y.g AND x.v = y.u JOIN le w ON y.g = w.g AND y.v = w.u AND w.v = q.b)"""
_RUNGS = f"""rg AS (SELECT q.g, q.q, spec, 1 AS r FROM q JOIN le ON q.g = le.g AND a = u AND b = v UNION SELECT q.g, q.q, spec, CASE WHEN NOT derived THEN 2 WHEN v <> '{G.ANY}' THEN 3 ELSE 4 END FROM q JOIN le ON q.g = le.g AND a = u WHERE mode = 'external'
 UNION SELECT g, q, s1, 6 FROM two UNION SELECT g, q, s2, 6 FROM two UNION SELECT q.g, q.q, spec, 7 FROM q JOIN le ON q.g = le.g AND (a = u AND v = '{G.ANY}' OR b = v AND u = '{G.ANY}') UNION SELECT three.g, three.q, spec, 8 FROM three JOIN (SELECT DISTINCT graph_id, spec FROM sp2) z ON three.g = z.graph_id
 UNION SELECT q.g, q.q, spec, 9 FROM q JOIN le ON q.g = le.g AND u = '{G.ANY}' AND v = '{G.ANY}'), bs AS (SELECT g, q, spec, min(r) AS r FROM rg GROUP BY g, q, spec),
 cr AS (SELECT g, q, spec, r, CASE r WHEN 1 THEN 1.0E0 WHEN 2 THEN 0.85E0 WHEN 3 THEN 0.60E0 WHEN 4 THEN 0.40E0 WHEN 6 THEN 0.85E0 WHEN 7 THEN 0.75E0 WHEN 8 THEN 0.60E0 ELSE 0.15E0 END * spec AS credit FROM bs),
 w1 AS (SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY round(credit, 9) DESC, spec DESC) AS i FROM cr)"""


@_add("g_relation_tier", T + f""", {_VIEW}, {_HUBS}, {_ENDS}, {_LIFT}, {_WANTED}, {_SPEC}, {_LEGS}, {_RUNGS}
 SELECT q.g AS graph_id, q.q, coalesce(CASE r WHEN 1 THEN 'direct' WHEN 2 THEN 'external' WHEN 3 THEN 'external_uncertified' WHEN 4 THEN 'external_open' WHEN 6 THEN 'indirect2' WHEN 7 THEN 'half' WHEN 8 THEN 'path3' WHEN 9 THEN 'floating' END, 'none') AS tier, coalesce(round(credit, 9), 0.0E0) AS credit
 FROM q LEFT JOIN (SELECT * FROM w1 WHERE i = 1) b ON q.g = b.g AND q.q = b.q""")
def relation_tier(spark, sf_dir):
    """The rung of every pair of a graph's classes, and of every class with a literal, a term outside and one of a derived signature, by any property."""
    t = triples(spark, sf_dir)
    k = t.filter((c("p") == _T) & (c("o") == _OWL + "Class")).select("graph_id", "s").distinct()
    pairs = k.select("graph_id", c("s").alias("a")).join(k.select("graph_id", c("s").alias("b")), "graph_id").filter("a <> b").select("graph_id", "a", "b", F.concat_ws(">", "a", "b").alias("q"), F.lit("slot").alias("mode"), F.lit(False).alias("derived"))
    far = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("mode"), F.lit(d).alias("derived")) for n, m, d in (("literal", "literal", False), ("external", "external", False), ("derived", "external", True))])).alias("f")
    open_ = k.select("graph_id", c("s").alias("a"), F.lit(None).cast("string").alias("b"), far).select("graph_id", "a", "b", F.concat_ws(">", "a", "f.n").alias("q"), "f.mode", "f.derived")
    wanted = pairs.unionByName(open_).withColumns({"rid": F.concat_ws("|", "graph_id", "q"), "surface": F.array().cast("array<string>")})
    parts = F.split("rid", r"\|", 2)
    return V.relation_credits(V.Schema(t), wanted.drop("q")).select(parts[0].alias("graph_id"), parts[1].alias("q"), "tier", F.round("credit", 9).alias("credit"))


QUERIES["join_paths"], ORACLES["join_paths"] = QUERIES["g_relation_tier"], ORACLES["g_relation_tier"]


@_add("g_index", T + f", n AS (SELECT graph_id, s AS term FROM t WHERE s_kind = 'iri' UNION SELECT graph_id, o FROM t WHERE o_kind = 'iri'), m AS (SELECT * FROM n WHERE term NOT LIKE 'http://www.w3.org/%'), f AS (SELECT graph_id, term, lower(term) AS x FROM m UNION SELECT graph_id, s, regexp_replace(lower(o), '[^a-z0-9]', '', 'g') FROM t WHERE p = '{_RDFS}label') SELECT graph_id, term, string_agg(x, ',' ORDER BY x) AS flats FROM f GROUP BY graph_id, term")
def index(spark, sf_dir):
    return G.index(triples(spark, sf_dir)).select("graph_id", "term", F.array_join("flats", ",").alias("flats"))


@_add("g_bind_slot", T + f""", l AS (SELECT graph_id, s AS term, lower(o) AS o FROM t WHERE p = '{_RDFS}label'), f AS (SELECT graph_id, min(term) AS term FROM l GROUP BY graph_id)
 SELECT graph_id, 'class' AS kind, o AS slot, '' AS anchors, min(term) AS term, 1.0E0 AS score FROM l GROUP BY graph_id, o UNION ALL SELECT graph_id, 'class', 'no such', 'nowhere,' || term, term, 1.0E0 FROM l
 UNION ALL SELECT graph_id, 'class', 'nation', '', term, 0.85E0 FROM f UNION ALL SELECT 'g' || n_regionkey, 'prop', 'p' || p_partkey, '', 'p' || p_partkey, 1.0E0 FROM part JOIN nation ON p_partkey % 25 = n_nationkey""")
def bind_slot(spark, sf_dir):
    """Slots by a class's label, by an anchor behind one that does not exist, by a word that all classes share, and by a property's name; a label is no property's."""
    t = triples(spark, sf_dir)
    none = F.array().cast("array<string>")
    label = t.filter(c("p") == _RDFS + "label").select("graph_id", "s", F.lower("o").alias("o"))
    slot = lambda df, kind, surface, anchors=none: df.select("graph_id", F.lit(kind).alias("kind"), F.array(surface).alias("surface"), anchors.alias("anchors"))
    props = t.filter((c("p") == _T) & c("o").isin(_OWL + "ObjectProperty", _OWL + "DatatypeProperty"))
    wanted = [slot(label, "class", c("o")), slot(label, "prop", c("o")), slot(label, "class", F.lit("no such"), F.array(F.lit("nowhere"), "s")), slot(label, "class", F.lit("nation")), slot(props, "prop", c("s"))]
    got = V.bind(G.index(t), G.schema_view(t), reduce(lambda x, y: x.unionByName(y), wanted))
    return got.select("graph_id", "kind", F.array_join("surface", ",").alias("slot"), F.array_join("anchors", ",").alias("anchors"), "term", "score")


@_add("g_uninformative", T + f""", e AS (SELECT DISTINCT graph_id, p, s AS a, o AS b FROM t WHERE p IN ('{_D}', '{_S}', '{_R}') AND s <> o), u AS (SELECT graph_id, p, a, b FROM e UNION SELECT graph_id, p, b, a FROM e), w AS (SELECT * FROM u UNION SELECT w.graph_id, w.p, w.a, u.b FROM w JOIN u ON w.graph_id = u.graph_id AND w.p = u.p AND w.b = u.a),
 r AS (SELECT graph_id, p, a AS x, least(a, min(b)) AS root FROM w GROUP BY graph_id, p, a), m AS (SELECT e.graph_id, e.p, r.root, count(*) AS m, count(DISTINCT e.a) AS s, count(DISTINCT e.b) AS t FROM e JOIN r ON e.graph_id = r.graph_id AND e.p = r.p AND e.a = r.x GROUP BY ALL), n AS (SELECT graph_id, p, root, count(*) AS n FROM r GROUP BY ALL)
 SELECT graph_id, p, root FROM m JOIN n USING (graph_id, p, root) WHERE m >= 3 AND (n >= 3 AND m = n * (n - 1) OR s >= 2 AND t >= 2 AND s * t >= 6 AND m = s * t AND n = s + t)""")
def uninformative(spark, sf_dir):
    return G.uninformative(triples(spark, sf_dir).filter(c("p").isin(_D, _S, _R)).select("graph_id", "p", c("s").alias("a"), c("o").alias("b")))


@_add("g_roles", T + f""", r AS (SELECT graph_id, s AS term, 'p' AS k FROM t WHERE p = '{_T}' AND o IN {_IN(G.DECLARED_PROPERTY)} OR p IN ('{_D}', '{_R}', '{_P}') UNION SELECT graph_id, o, 'p' FROM t WHERE p = '{_P}' UNION SELECT graph_id, p, 'p' FROM t
 UNION SELECT graph_id, s, 'c' FROM t WHERE p = '{_T}' AND o IN {_IN(G.CLASS_TYPES)} UNION SELECT graph_id, o, 'c' FROM t WHERE p IN ('{_D}', '{_R}', '{_T}') UNION SELECT graph_id, s, 'w' FROM t WHERE p = '{_S}' UNION SELECT graph_id, o, 'w' FROM t WHERE p = '{_S}' UNION SELECT graph_id, s, 'i' FROM t)
 SELECT graph_id, term, CASE WHEN bool_or(k = 'p') AND bool_or(k = 'c') THEN 'ambiguous' WHEN bool_or(k = 'p') THEN 'property' WHEN bool_or(k IN ('c', 'w')) THEN 'class' ELSE 'individual' END AS role FROM r WHERE term NOT LIKE 'http://www.w3.org/%' GROUP BY graph_id, term""")
def roles(spark, sf_dir):
    return G.roles(triples(spark, sf_dir))


@_add("g_owlrl", T + f""", sb AS (SELECT graph_id, s AS a, o AS b FROM t WHERE p = '{_S}' UNION SELECT sb.graph_id, sb.a, t.o FROM sb JOIN t ON t.graph_id = sb.graph_id AND t.s = sb.b AND t.p = '{_S}'),
 sp AS (SELECT graph_id, s AS a, o AS b FROM t WHERE p = '{_P}' UNION SELECT sp.graph_id, sp.a, t.o FROM sp JOIN t ON t.graph_id = sp.graph_id AND t.s = sp.b AND t.p = '{_P}'),
 e0 AS (SELECT graph_id, s AS q, p, o AS k FROM t WHERE p IN ('{_D}', '{_R}') UNION SELECT t.graph_id, sp.a, p, o FROM sp JOIN t ON t.graph_id = sp.graph_id AND t.s = sp.b WHERE p IN ('{_D}', '{_R}')),
 e AS (SELECT * FROM e0 UNION SELECT e0.graph_id, q, p, b FROM e0 JOIN sb ON sb.graph_id = e0.graph_id AND sb.a = e0.k),
 u AS (SELECT graph_id, s, p, o FROM t WHERE p NOT LIKE 'http://www.w3.org/%' UNION SELECT t.graph_id, s, sp.b, o FROM t JOIN sp ON sp.graph_id = t.graph_id AND sp.a = t.p),
 k0 AS (SELECT graph_id, s, o AS k FROM t WHERE p = '{_T}' UNION SELECT u.graph_id, CASE e.p WHEN '{_D}' THEN s ELSE o END, e.k FROM u JOIN e ON e.graph_id = u.graph_id AND e.q = u.p),
 k AS (SELECT * FROM k0 UNION SELECT k0.graph_id, s, b FROM k0 JOIN sb ON sb.graph_id = k0.graph_id AND sb.a = k0.k),
 z AS (SELECT graph_id, s, p, o FROM t UNION SELECT graph_id, a, '{_S}', b FROM sb UNION SELECT graph_id, a, '{_P}', b FROM sp UNION SELECT graph_id, q, p, k FROM e UNION SELECT * FROM u UNION SELECT graph_id, s, '{_T}', k FROM k)
 SELECT graph_id, n AS triples_before, m AS triples_after, m - n AS inferred_triples, true AS consistent, '' AS unsatisfiable_classes FROM (SELECT graph_id, count(*) AS m FROM z GROUP BY graph_id) JOIN (SELECT graph_id, count(*) AS n FROM t GROUP BY graph_id) USING (graph_id)""")
def owlrl(spark, sf_dir):
    """What the triples of each graph entail, whether that can be true, and which classes cannot have members."""
    return entailment.reasoned(triples(spark, sf_dir)).drop("reasons").withColumn("unsatisfiable_classes", F.array_join("unsatisfiable_classes", ","))


@_add("agg_formal_quality", T + f""", d AS (SELECT DISTINCT graph_id, s, o IN {_IN(G.PROPERTY_TYPES)} AS pr FROM t WHERE p = '{_T}' AND o IN {_IN([*G.CLASS_TYPES, *G.PROPERTY_TYPES])}), h AS (SELECT graph_id, s, bool_or(p = '{_RDFS}label') AS l, bool_or(p = '{_RDFS}comment') AS k, bool_or(p = '{_D}') AND bool_or(p = '{_R}') AS dr FROM t GROUP BY ALL)
 SELECT graph_id, count(*) AS terms, round(avg(CASE WHEN l THEN 1.0E0 ELSE 0 END), 9) AS label_share, round(avg(CASE WHEN k THEN 1.0E0 ELSE 0 END), 9) AS comment_share, round(coalesce(avg(CASE WHEN pr THEN CASE WHEN dr THEN 1.0E0 ELSE 0 END END), 0), 9) AS domain_range_share FROM d JOIN h USING (graph_id, s) GROUP BY graph_id""")
def formal_quality(spark, sf_dir):
    q = G.formal_quality(triples(spark, sf_dir))
    return q.withColumns({k: F.round(k, 9) for k in ("label_share", "comment_share", "domain_range_share")})


@_add("str_extract_names", T + f"SELECT DISTINCT graph_id, lower(s) AS name FROM t WHERE p = '{_T}' AND o LIKE 'http://www.w3.org/%'")
def extract_names(spark, sf_dir):
    """The distinct normalised names of typed terms."""
    t = triples(spark, sf_dir).filter((c("p") == _T) & c("o").startswith("http://www.w3.org/") & (c("s_kind") == "iri"))
    return t.select("graph_id", F.array_join(words(F.lower(camel_split(local_name(c("s")))), "[^a-z0-9]+"), "").alias("name")).distinct()


@_add("parse_rdf_ladder", "SELECT item_id, 3::BIGINT AS n_triples, 'parsed' AS status FROM benchmark")
def parse_ladder(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    text = F.concat(F.lit("@prefix : <http://e/> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n:a a owl:Class ; :says "), F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9), F.lit(" , "), F.col("item_id"), F.lit(" .\n"))
    s = rdf.parse_status(b.select(F.col("item_id").cast("string").alias("graph_id"), text.alias("text")))
    return s.select(F.col("graph_id").cast("long").alias("item_id"), "n_triples", "status")


@_add("parse_sev_status", "SELECT CAST(doc_id AS VARCHAR) AS k, CASE WHEN length(trim(text)) < 20 THEN 'no_ontology' ELSE 'unparseable' END AS status FROM documents UNION ALL SELECT 'g' || n_nationkey, 'parsed' FROM nation")
def sev_status(spark, sf_dir):
    """The status of every document, and of a graph for each nation."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("graph_id"), "text")
    return rdf.parse_status(d.unionByName(_written(spark, sf_dir))).select(F.col("graph_id").alias("k"), "status")


@_add("scan_path_key", "SELECT page_id, coalesce(string_split(url, '/')[-4], '<unknown>') AS model, coalesce(string_split(url, '/')[-3], '<unknown>') AS config, coalesce(string_split(url, '/')[-2], '<unknown>') AS id FROM pages")
def path_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", *rdf.path_key(F.col("url")))


@_add("str_ontology_vocab", "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(lower(html), '[a-z]{4,}'))) AS BIGINT) AS n_terms, false AS turtle FROM pages")
def ontology_vocab(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]{4,}"), F.lit(0)))).cast("long").alias("n_terms"), looks_like_turtle(c("html")).alias("turtle"))


@_add("join_usage_bnode", T + ", b AS (SELECT graph_id, s, p, o, CAST(regexp_extract(s, '[0-9]+') AS BIGINT) % 3 AS k FROM t WHERE p NOT LIKE 'http://www.w3.org/%') SELECT graph_id, s, p, o FROM b WHERE k <> 1 AND s <> o UNION SELECT graph_id, s, 'held', o FROM b WHERE k = 1 AND s <> o UNION SELECT graph_id, s, p, unnest(['first', '" + rdf.RDF + "nil']) FROM b WHERE k = 2")
def usage_bnode(spark, sf_dir):
    """Edges of suppliers: a third as they are, a third over a blank node, a third to the items of a list."""
    t = triples(spark, sf_dir).filter(~c("p").startswith("http://www.w3.org/"))
    k = F.regexp_extract("s", "[0-9]+", 0).cast("long") % 3
    blank = lambda x: F.concat(F.lit("_:" + x), "s")
    kind = lambda x: F.when(x.startswith("_:"), "bnode").otherwise("iri")
    row = lambda s, p, o: F.struct(s.alias("s"), kind(s).alias("s_kind"), p.alias("p"), o.alias("o"), kind(o).alias("o_kind"))
    first, rest, nil = (F.lit(rdf.RDF + x) for x in ("first", "rest", "nil"))
    over = F.array(row(c("s"), c("p"), blank("v")), row(blank("v"), F.lit("held"), c("o")))
    listed = F.array(row(c("s"), c("p"), blank("l")), row(blank("l"), first, F.lit("first")), row(blank("l"), rest, blank("m")), row(blank("m"), first, c("o")), row(blank("m"), rest, nil))
    rows = F.when(k == 0, F.array(row(c("s"), c("p"), c("o")))).when(k == 1, over).otherwise(listed)
    return G.usage_edges(t.select("graph_id", F.explode(rows).alias("r")).select("graph_id", "r.*")).drop("o_kind")


@_add("g_load_bearing", T + f"SELECT graph_id, s, p, o FROM t WHERE p NOT IN {_IN(G.ANNOTATIONS)} AND NOT (p = '{_T}' AND o IN {_IN(G.DECLARATIONS)})")
def load_bearing(spark, sf_dir):
    return G.load_bearing(triples(spark, sf_dir))


_EXPR = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . "


def _written(spark, sf_dir):
    """A small graph for each nation, in Turtle."""
    k = F.col("n_nationkey")
    body = F.concat(F.lit(_EXPR + ":N"), k, F.lit(" a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :inRegion ; owl:someValuesFrom :R"), F.col("n_regionkey"), F.lit(" ] . :inRegion a owl:ObjectProperty ."))
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("g"), k).alias("graph_id"), body.alias("text"))


@_add("parse_rdf_nonempty", "SELECT 'g' || n_nationkey AS graph_id, 'parsed' AS status, 6::BIGINT AS n_triples FROM nation")
def parse_nonempty(spark, sf_dir):
    return rdf.parse_status(_written(spark, sf_dir), "nonempty")


@_add("parse_rdf_sniffed", """SELECT 'c' || c_custkey AS graph_id, CASE WHEN c_custkey % 8 = 6 THEN 'unparseable' WHEN c_custkey % 8 = 7 THEN 'empty' ELSE 'parsed' END AS status,
 (CASE WHEN c_custkey % 8 >= 6 THEN 0 WHEN c_custkey % 8 IN (3, 4) THEN 4 ELSE 2 END)::BIGINT AS n_triples FROM customer""")
def parse_sniffed(spark, sf_dir):
    """The status of a text for each customer: in six syntaxes, prose, or nothing but a comment."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    e = "@prefix : <http://e/> . "
    forms = [
        text(e, ":c", k, ' :name "', name, '" ; :in "', seg, '" .'), text("<http://e/c", k, '> <http://e/name> "', name, '" .\n<http://e/c', k, '> <http://e/in> "', seg, '" .'),
        text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><rdf:Description rdf:about="http://e/c', k, '"><e:name>', name, "</e:name><e:in>", seg, "</e:in></rdf:Description></rdf:RDF>"),
        text('{"@context": {"@vocab": "http://e/", "seen": {"@container": "@list"}}, "@id": "http://e/c', k, '", "name": "', name, '", "seen": ["', seg, '"]}'),
        text(e, ":g { :c", k, ' :name "', name, '" . :c', k, ' :near [ :in "', seg, '" ] } :g a :Graph .'), text(e, ":c", k, ' :name "', name, '" . { ?x :in ?y } => { ?y :of ?x } .'),
        text("no graph but ", name), text("# ", name),
    ]
    form = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return rdf.parse_status(read(spark, sf_dir, "customer").select(text("c", k).alias("graph_id"), form.alias("text")), "sniff", 0)


@_add("parse_owlxml", "SELECT 'g' || n_nationkey AS graph_id, 'http://e/o#C' || n_nationkey AS s, 'http://www.w3.org/2002/07/owl#Class' AS o FROM nation")
def parse_owlxml(spark, sf_dir):
    xml = F.concat(F.lit('<Ontology xmlns="http://www.w3.org/2002/07/owl#" ontologyIRI="http://e/o"><Declaration><Class IRI="#C'), F.col("n_nationkey"), F.lit('"/></Declaration></Ontology>'))
    return rdf.triples(read(spark, sf_dir, "nation").select(F.concat(F.lit("g"), "n_nationkey").alias("graph_id"), xml.alias("text")), "sniff").select("graph_id", "s", "o")
