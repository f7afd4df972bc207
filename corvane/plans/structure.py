"""The connectivity measure over the regions' graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from ..sources import rdf
from ._bind import catalogue, read
from .graph import _D, _IN, _OWL, _P, _R, _S, _T, G, T, _written, triples

QUERIES, ORACLES, _add = catalogue()
c = F.col


def _expression_sql(cast: str) -> str:
    """Class expressions on every customer: by one of 40 properties to the class of half its key, some with a second filler, a
    cardinality or a second holder; and on every nation the same two expressions, which say nothing."""
    v = lambda x: f"CAST({x} AS {cast})"
    half = lambda by: v(f"CAST(floor(c_custkey / {by}) AS BIGINT)")
    g, x, b, q = f"concat('x', {v('n_regionkey')})", f"concat('x', {v('c_custkey')})", f"concat('_:b', {v('c_custkey')})", f"concat('y', {v('c_custkey % 40')})"
    n, u, w = f"concat('z', {v('n_nationkey')})", f"concat('_:u', {v('n_nationkey')}, '_', {v('j')})", f"concat('w', {v('j')})"
    customer, nation = "FROM customer JOIN nation ON c_nationkey = n_nationkey", "FROM nation CROSS JOIN (SELECT 0 AS j UNION SELECT 1) js"
    return f"""
SELECT {g} AS graph_id, {x} AS s, 'iri' AS s_kind, '{_T}' AS p, '{_OWL}Class' AS o, 'iri' AS o_kind {customer}
UNION SELECT {g}, {q}, 'iri', '{_T}', '{_OWL}ObjectProperty', 'iri' {customer}
UNION SELECT {g}, {x}, 'iri', '{_S}', {b}, 'bnode' {customer}
UNION SELECT {g}, concat('x', {half(2)}), 'iri', '{G.EQUIVALENT}', {b}, 'bnode' {customer} WHERE c_custkey % 11 = 0
UNION SELECT {g}, {b}, 'bnode', '{_T}', '{_OWL}Restriction', 'iri' {customer}
UNION SELECT {g}, {b}, 'bnode', '{_OWL}onProperty', {q}, 'iri' {customer}
UNION SELECT {g}, {b}, 'bnode', '{_OWL}someValuesFrom', concat('x', {half(2)}), 'iri' {customer}
UNION SELECT {g}, {b}, 'bnode', '{_OWL}allValuesFrom', concat('x', {half(3)}), 'iri' {customer} WHERE c_custkey % 5 = 0
UNION SELECT {g}, {b}, 'bnode', '{_OWL}minCardinality', '1', 'literal' {customer} WHERE c_custkey % 7 = 0
UNION SELECT {g}, {n}, 'iri', '{_T}', '{_OWL}Class', 'iri' {nation}
UNION SELECT {g}, {w}, 'iri', '{_T}', '{_OWL}ObjectProperty', 'iri' {nation}
UNION SELECT {g}, {n}, 'iri', '{_S}', {u}, 'bnode' {nation}
UNION SELECT {g}, {u}, 'bnode', '{_OWL}onProperty', {w}, 'iri' {nation}
UNION SELECT {g}, {u}, 'bnode', '{_OWL}someValuesFrom', {n}, 'iri' {nation}"""


def _expressions(spark, sf_dir):
    for x in ("nation", "customer"):
        read(spark, sf_dir, x).createOrReplaceTempView(x)
    return spark.sql(_expression_sql("STRING"))


def _analysis(spark, sf_dir):
    return S.Analysis(triples(spark, sf_dir).unionByName(_expressions(spark, sf_dir)))


@_add("g_restrictions", f"""WITH RECURSIVE t AS MATERIALIZED ({_expression_sql('VARCHAR')}), h AS (SELECT graph_id, s AS entity, o AS body FROM t WHERE o_kind = 'bnode'), o AS (SELECT graph_id, s AS body, o AS prop FROM t WHERE p = '{_OWL}onProperty'), f AS (SELECT graph_id, s AS body, o AS filler FROM t WHERE p IN {_IN(G.FILLERS)}),
 e AS MATERIALIZED (SELECT DISTINCT graph_id, 'attachment' AS p, entity AS a, prop AS b FROM h JOIN o USING (graph_id, body) UNION ALL SELECT DISTINCT graph_id, 'filler', prop, filler FROM o JOIN f USING (graph_id, body)),
 u AS MATERIALIZED (SELECT * FROM e UNION SELECT graph_id, p, b, a FROM e), w AS (SELECT * FROM u UNION SELECT w.graph_id, w.p, w.a, u.b FROM w JOIN u ON w.graph_id = u.graph_id AND w.p = u.p AND w.b = u.a),
 r AS MATERIALIZED (SELECT graph_id, p, a AS x, least(a, min(b)) AS root FROM w GROUP BY graph_id, p, a), m AS (SELECT e.graph_id, e.p, root, count(*) AS m, count(DISTINCT e.a) AS s, count(DISTINCT e.b) AS t FROM e JOIN r ON e.graph_id = r.graph_id AND e.p = r.p AND e.a = r.x GROUP BY ALL), n AS (SELECT graph_id, p, root, count(*) AS n FROM r GROUP BY ALL),
 bad AS (SELECT graph_id, p, r.x FROM m JOIN n USING (graph_id, p, root) JOIN r USING (graph_id, p, root) WHERE m >= 3 AND (n >= 3 AND m = n * (n - 1) OR s >= 2 AND t >= 2 AND s * t >= 6 AND m = s * t AND n = s + t)),
 dead AS (SELECT h.graph_id, h.body FROM h JOIN bad ON bad.graph_id = h.graph_id AND bad.p = 'attachment' AND bad.x = h.entity UNION SELECT o.graph_id, o.body FROM o JOIN bad ON bad.graph_id = o.graph_id AND bad.p = 'filler' AND bad.x = o.prop),
 arc AS (SELECT graph_id, entity, body, 'holder' AS arc FROM h UNION ALL SELECT graph_id, prop, body, 'property' FROM o UNION ALL SELECT graph_id, filler, body, 'filler' FROM f WHERE (graph_id, filler) IN (SELECT graph_id, s FROM t))
 SELECT graph_id, entity, arc, count(*) AS n FROM arc ANTI JOIN dead USING (graph_id, body) GROUP BY ALL""")
def restrictions(spark, sf_dir):
    """How many arcs of class expressions lead to each term, as holder, property or filler."""
    return S.Analysis(_expressions(spark, sf_dir)).expressions["arcs"].groupBy("graph_id", "entity", "arc").agg(F.count("*").alias("n"))


# Terms with a role that the graph says something of; their subsumption pairs both ways; components; what is anchored outside the taxonomy.
_TAXONOMY = f""", ro AS (SELECT graph_id, s AS term, 'p' AS k FROM t WHERE p = '{_T}' AND o IN {_IN(G.DECLARED_PROPERTY)} OR p IN ('{_D}', '{_R}', '{_P}') UNION SELECT graph_id, o, 'p' FROM t WHERE p = '{_P}' UNION SELECT graph_id, p, 'p' FROM t WHERE p NOT LIKE 'http://www.w3.org/%'
  UNION SELECT graph_id, x, 'c' FROM (SELECT graph_id, s AS x FROM t WHERE p = '{_S}' OR p = '{_T}' AND o IN {_IN(G.CLASS_TYPES)} UNION SELECT graph_id, o FROM t WHERE p IN ('{_S}', '{_D}', '{_R}') OR p = '{_T}') WHERE x NOT LIKE 'http://www.w3.org/%' AND (graph_id, x) IN (SELECT graph_id, s FROM t)),
 e AS MATERIALIZED (SELECT DISTINCT t.graph_id, s AS a, o AS b FROM t JOIN ro x ON x.graph_id = t.graph_id AND x.term = t.s JOIN ro y ON y.graph_id = t.graph_id AND y.term = t.o WHERE p IN ('{_S}', '{_P}') AND s <> o),
 w AS (SELECT * FROM e UNION SELECT w.graph_id, w.a, e.b FROM w JOIN e ON w.graph_id = e.graph_id AND w.b = e.a), pr AS MATERIALIZED (SELECT DISTINCT graph_id, least(a, b) AS a, greatest(a, b) AS b FROM w WHERE a <> b),
 u AS MATERIALIZED (SELECT graph_id, a, b FROM pr UNION SELECT graph_id, b, a FROM pr), cl AS (SELECT * FROM u UNION SELECT cl.graph_id, cl.a, u.b FROM cl JOIN u ON cl.graph_id = u.graph_id AND cl.b = u.a), cp AS (SELECT graph_id, a, least(a, min(b)) AS comp FROM cl GROUP BY graph_id, a),
 dg AS (SELECT u.graph_id, u.a, count(*) AS k FROM u GROUP BY ALL), sz AS (SELECT graph_id, comp, count(*) AS n, sum(k) / 2 AS m FROM dg JOIN cp USING (graph_id, a) GROUP BY ALL),
 an AS (SELECT graph_id, s AS a FROM t WHERE p = '{_T}' AND o NOT LIKE 'http://www.w3.org/%' UNION SELECT graph_id, s FROM t WHERE p NOT LIKE 'http://www.w3.org/%' UNION SELECT graph_id, o FROM t WHERE p NOT LIKE 'http://www.w3.org/%' UNION SELECT graph_id, p FROM t WHERE p NOT LIKE 'http://www.w3.org/%'
  UNION SELECT graph_id, o FROM t WHERE p = '{_T}' AND o NOT LIKE 'http://www.w3.org/%' UNION SELECT graph_id, s FROM t WHERE p IN ('{_D}', '{_R}') AND o IN (SELECT term FROM ro WHERE ro.graph_id = t.graph_id AND k = 'c') UNION SELECT graph_id, o FROM t WHERE p IN ('{_D}', '{_R}') AND o IN (SELECT term FROM ro WHERE ro.graph_id = t.graph_id AND k = 'c')),
 dr AS (SELECT dg.graph_id, dg.a FROM dg JOIN cp USING (graph_id, a) JOIN sz USING (graph_id, comp) WHERE n >= 3 AND (m = n * (n - 1) / 2 OR k = n - 1 AND NOT EXISTS (SELECT 1 FROM an WHERE an.graph_id = dg.graph_id AND an.a = dg.a)))"""


@_add("g_taxonomy", T + _TAXONOMY + " SELECT graph_id, a, b FROM pr WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.graph_id = pr.graph_id AND dr.a IN (pr.a, pr.b))")
def taxonomy(spark, sf_dir):
    """Pairs of terms of which one is above the other, without those that classify nothing."""
    return _analysis(spark, sf_dir).taxonomy.select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@_add("g_incidences", None)
def incidences(spark, sf_dir):
    """The anchors of every entity."""
    return _analysis(spark, sf_dir).roster


@_add("g_grounded", None)
def grounded(spark, sf_dir):
    """Entities with an anchor."""
    return _analysis(spark, sf_dir).roster.filter("d > 0").select("graph_id", "entity")


@_add("g_connectivity", None)
def connectivity(spark, sf_dir):
    """Scores by role and over all, with a pitfall report for every second region."""
    r = read(spark, sf_dir, "region").filter("r_regionkey % 2 = 0").select(F.concat(F.lit("g"), c("r_regionkey").cast("string")).alias("graph_id"), c("r_regionkey").alias("total"), F.lit(1).alias("critical"))
    s = _analysis(spark, sf_dir).scores(r)
    return s.select("graph_id", "vacuous", "evidence", "doubt", *[F.round(k, 9).alias(k) for k in ("property_connectivity", "class_connectivity", "individual_connectivity", "pitfall_freedom", "score")])


@_add("g_diagnostics", None)
def diagnostics(spark, sf_dir):
    """The counts of every graph."""
    return _analysis(spark, sf_dir).diagnostics()


@_add("g_reference_score", "SELECT 'g' || n_nationkey AS graph_id, true AS scored FROM nation UNION ALL SELECT 'd' || item_id, false FROM benchmark WHERE length(trim(text)) >= 20")
def reference_score(spark, sf_dir):
    """References of the nations are scored; texts that cannot be parsed are missing, not 0."""
    prose = read(spark, sf_dir, "benchmark").filter(F.length(F.trim("text")) >= 20).select(F.concat(F.lit("d"), c("item_id").cast("string")).alias("graph_id"), "text")
    texts = _written(spark, sf_dir).unionByName(prose)
    got = S.reference_scores(rdf.parse_status(texts), S.Analysis(rdf.triples(texts)).scores())
    return got.select("graph_id", c("score").isNotNull().alias("scored"))
