"""Verification of questions against schema graphs: can a graph's schema answer a question's signature?

A signature names slots (terms the question speaks of) and relations between them. Slots bind to terms by anchors and words;
a relation earns the credit of the best rung of a ladder of path evidence between the cones of its bound ends, discounted
by how widely its properties are spread; both make a question's score. Evidence is made once for each distinct pair of ends
and property, whatever the number of questions, and every rung is a join. No plan forms question times term.

Signatures are rows (graph_id, cq_id, cq, cq_type, source, slots, relations) with ``SLOTS`` and ``RELATIONS``.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flat, identifier_tokens
from ..session import materialize
from . import graph as G

SLOTS = "array<struct<id:string,kind:string,surface:array<string>,anchors:array<string>>>"
RELATIONS = "array<struct<from:string,to:string,surface:array<string>>>"
# Rungs of the ladder, best first, with their credit.
RUNGS = {"direct": 1.0, "external": 0.85, "external_uncertified": 0.60, "external_open": 0.40, "reified": 1.0, "indirect2": 0.85, "half": 0.75, "path3": 0.60, "floating": 0.15, "none": 0.0}
# Pairs of incomparable ends that cost nothing, and bounds of an answerable question.
FREE_ENDS, ANSWERABLE = 4, 0.75
# Fixed value: bytes of a side that Spark may broadcast by itself; tables that grow with the graphs are shuffled.
BROADCAST = 1 << 19
c = F.col


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _held(df: DataFrame) -> DataFrame:
    return materialize(df, BROADCAST)


class Schema:
    """What verification reads of some graphs' triples, each written to the shared folder once, when it is first asked for."""

    def __init__(self, t: DataFrame):
        self.triples = _held(t)

    @cached_property
    def view(self) -> DataFrame:
        return _held(G.schema_view(self.triples))

    @cached_property
    def index(self) -> DataFrame:
        return _held(G.index(self.triples).join(self.view.select("graph_id", "term"), ["graph_id", "term"], "left_semi"))

    @cached_property
    def up(self) -> DataFrame:
        return _held(G.ancestors(self.triples))

    @cached_property
    def down(self) -> DataFrame:
        return _held(G.descendants(self.triples))

    @cached_property
    def hubs(self) -> DataFrame:
        return _held(G.universal_hubs(self.triples, self.view, self.down))

    @cached_property
    def ends(self) -> DataFrame:
        return _held(G.endpoints(self.triples, self.hubs))

    @cached_property
    def edges(self) -> DataFrame:
        return _held(G.lift(self.triples, self.view, self.ends, self.hubs))


def _in_pool(kind: Column, role: Column) -> Column:
    return F.when(kind.isin("class", "objprop", "dataprop"), role == kind).when(kind == "prop", role != "class").otherwise(True)


def _word_score(want: Column, flat_: Column, tokens: Column, flats: Column) -> Column:
    """1 for an equal flat string, 0.85 if all words are found, 0.70 for half of them; else null."""
    hit = F.size(F.array_intersect(want, tokens))
    return F.when((flat_ != "") & F.array_contains(flats, flat_), 1.0).when((F.size(want) > 0) & (hit == F.size(want)), 0.85).when((hit > 0) & (2 * hit >= F.size(want)), 0.70)


def _by_word(idx: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Rows of ``surfaces`` (graph_id, surface, rank, x) with each term that shares a word or flat string, and its score."""
    w = surfaces.withColumn("want", identifier_tokens(c("x"))).withColumn("flat", flat(c("x")))
    left = w.withColumn("key", F.explode(F.array_distinct(F.concat("want", F.array("flat")))))
    right = idx.withColumn("key", F.explode(F.array_distinct(F.concat("tokens", "flats"))))
    pair = left.join(right, ["graph_id", "key"]).drop("key").distinct()
    return pair.withColumn("score", _word_score(c("want"), c("flat"), c("tokens"), c("flats"))).filter("score is not null")


def bind(idx: DataFrame, view: DataFrame, wanted: DataFrame) -> DataFrame:
    """(graph_id, kind, surface, anchors, term, score): the best term for each distinct wanted (graph_id, kind, surface, anchors).

    The first anchor that is a term of the kind wins; else the best score, then the earliest surface, then the smallest term.
    """
    key = ["graph_id", "kind", "surface", "anchors"]
    wanted = wanted.select(*key).distinct()
    anchored = wanted.select(*key, F.posexplode("anchors").alias("rank", "term")).join(view, ["graph_id", "term"]).filter(_in_pool(c("kind"), c("role")))
    anchored = anchored.select(*key, F.lit(1.0).alias("score"), (c("rank") - 1_000_000).alias("rank"), "term")  # before every surface
    words = _by_word(idx, wanted.select("graph_id", "surface").distinct().select("graph_id", "surface", F.posexplode("surface").alias("rank", "x"))).select("graph_id", "surface", "rank", "term", "score")
    spoken = wanted.join(words, ["graph_id", "surface"]).join(view, ["graph_id", "term"]).filter(_in_pool(c("kind"), c("role"))).select(*key, "score", "rank", "term")
    best = _union(anchored, spoken).groupBy(*key).agg(F.min(F.struct((-c("score")).alias("s"), c("rank"), c("term"))).alias("b"))
    return best.select(*key, c("b.term").alias("term"), (-c("b.s")).alias("score"))


def matched_properties(idx: DataFrame, view: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(graph_id, surface, p): properties whose names match one of the surfaces (graph_id, surface: array); no surface means all."""
    props = view.filter("role <> 'class'").select("graph_id", "term")
    surfaces = surfaces.select("graph_id", "surface").distinct()
    some = _by_word(idx.join(props, ["graph_id", "term"], "left_semi"), surfaces.select("graph_id", "surface", F.posexplode("surface").alias("rank", "x"))).select("graph_id", "surface", c("term").alias("p"))
    every = surfaces.filter(F.size("surface") == 0).join(props, "graph_id").select("graph_id", "surface", c("term").alias("p"))
    return _union(some, every).distinct()


def specificity(schema: Schema) -> DataFrame:
    """(graph_id, p, spec): 1, or 4 by the number of pairs of incomparable declared ends if that is over 4."""
    ends = schema.ends.filter(~c("end").isin(G.ANY, G.LITERAL)).select("graph_id", c("prop").alias("p"), "side", c("end").alias("x")).distinct()
    up = schema.up.select("graph_id", c("a").alias("x"), c("b").alias("y"))
    covered = ends.join(up, ["graph_id", "x"]).join(ends.withColumnRenamed("x", "y"), ["graph_id", "p", "side", "y"], "left_semi").select("graph_id", "p", "side", "x").distinct()
    fan = ends.join(covered, ["graph_id", "p", "side", "x"], "left_anti").groupBy("graph_id", "p").agg(F.greatest(F.count_if(c("side") == "domain"), F.lit(1)).alias("d"), F.greatest(F.count_if(c("side") == "range"), F.lit(1)).alias("r"))
    props = schema.view.filter("role <> 'class'").select("graph_id", c("term").alias("p"))
    pairs = F.coalesce(c("d") * c("r"), F.lit(1))
    return props.join(fan, ["graph_id", "p"], "left").select("graph_id", "p", F.round(F.when(pairs <= FREE_ENDS, 1.0).otherwise(FREE_ENDS / pairs), 6).alias("spec"))


def cones(schema: Schema, terms: DataFrame) -> DataFrame:
    """(graph_id, end, x): each wanted term (graph_id, end) with what is above and below it, without language terms and hubs."""
    own = terms.select("graph_id", "end", c("end").alias("x"))
    near = [terms.join(x.select("graph_id", c("a").alias("end"), c("b").alias("x")), ["graph_id", "end"]) for x in (schema.up, schema.down)]
    return _union(own, *near).distinct().filter(G.is_named(c("x"), F.lit("iri"))).join(schema.hubs.withColumnRenamed("term", "x"), ["graph_id", "x"], "left_anti")


def evidence(edges: DataFrame, cone: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """What connects ends, for distinct pairs (graph_id, a, b) of ends; a null b is an open end, ``LITERAL`` a literal one.

    direct, two: (graph_id, a, b, p); open: (graph_id, a, p, closed, half); mirror: (graph_id, b, p); hub: (graph_id, a, b, x);
    three: (graph_id, a, b); floating: (graph_id, p).
    """
    g, no = "graph_id", (G.ANY, G.LITERAL)
    e = edges.select(g, c("a").alias("u"), c("p"), c("b").alias("v"))
    left = pairs.select(g, "a").distinct().join(cone.select(g, c("end").alias("a"), c("x").alias("u")), [g, "a"])
    right = pairs.filter("b is not null").select(g, "b").distinct().join(cone.select(g, c("end").alias("b"), c("x").alias("v")), [g, "b"])
    literal = pairs.filter(c("b") == G.LITERAL).select(g, "b").distinct().withColumn("v", F.lit(G.LITERAL))
    right = _union(right, literal)
    known = pairs.filter("b is not null").select(g, "a", "b")
    out = _held(left.join(e, [g, "u"]).select(g, "a", "p", "v", (c("u") != c("v")).alias("moves")).distinct())  # a's cone -> v
    into = _held(right.join(e, [g, "v"]).select(g, "b", "p", "u", (c("u") != c("v")).alias("moves")).distinct())  # u -> b's cone
    direct = known.join(out.select(g, "a", "p", "v").distinct(), [g, "a"]).join(right, [g, "b", "v"], "left_semi").select(g, "a", "b", "p").distinct()
    opened = out.groupBy(g, "a", "p").agg(F.max(c("v") != G.ANY).alias("closed"), F.max(c("v") == G.ANY).alias("half"))
    mirror = into.filter(c("u") == G.ANY).select(g, "b", "p").distinct()
    # two steps over an inner node x, by either direction of the first or the second, never both backwards into one another
    a_out = out.filter(c("moves") & ~c("v").isin(*no)).select(g, "a", c("v").alias("x"), c("p").alias("p1")).distinct()
    a_in = left.join(e.withColumnRenamed("u", "w").withColumnRenamed("v", "u"), [g, "u"]).filter((c("w") != c("u")) & ~c("w").isin(*no)).select(g, "a", c("w").alias("x"), c("p").alias("p1")).distinct()
    b_in = into.filter(c("moves") & ~c("u").isin(*no)).select(g, "b", c("u").alias("x"), c("p").alias("p2")).distinct()
    b_out = right.join(e.withColumnRenamed("v", "w").withColumnRenamed("u", "v"), [g, "v"]).filter((c("w") != c("v")) & ~c("w").isin(*no)).select(g, "b", c("w").alias("x"), c("p").alias("p2")).distinct()
    shapes = [(_held(a_out), b_in), (_held(a_in), b_in), (a_out, b_out)]
    ways = [(known.join(x.select(g, "a", "x").distinct(), [g, "a"]).join(y.select(g, "b", "x").distinct(), [g, "b", "x"], "left_semi"), x, y) for x, y in shapes]
    hub = _union(*[w for w, _, _ in ways]).select(g, "a", "b", "x").distinct()
    two = _union(*[p for w, x, y in ways for p in (w.join(x, [g, "a", "x"]).select(g, "a", "b", c("p1").alias("p")), w.join(y, [g, "b", "x"]).select(g, "a", "b", c("p2").alias("p")))]).distinct()
    step = e.filter(~c("u").isin(*no) & ~c("v").isin(*no)).select(g, c("u").alias("x"), c("v").alias("y")).distinct()
    first = out.filter(~c("v").isin(*no)).select(g, "a", c("v").alias("x")).distinct()
    last = into.filter(~c("u").isin(*no)).select(g, "b", c("u").alias("y")).distinct()
    three = known.join(first.join(step, [g, "x"]).select(g, "a", "y").distinct(), [g, "a"]).join(last, [g, "b", "y"], "left_semi").select(g, "a", "b").distinct()
    floating = e.filter((c("u") == G.ANY) & (c("v") == G.ANY)).select(g, "p").distinct()
    return {"direct": direct, "open": opened, "mirror": mirror, "hub": hub, "two": two, "three": three, "floating": floating}


def relation_credits(schema: Schema, relations: DataFrame) -> DataFrame:
    """(rid, tier, credit) of relations (rid, graph_id, a, b, mode, surface, derived) between bound ends; mode: slot, literal or external.

    Properties are taken by specificity; the best product of a rung's credit and the specificity counts, ties to the higher
    specificity. Unbound ends and unmatched properties give none.
    """
    view, idx = schema.view, schema.index
    relations = _held(relations.withColumn("b", F.when(c("mode") == "literal", G.LITERAL).when(c("mode") == "slot", c("b"))))
    able = relations.filter("a is not null and (mode <> 'slot' or b is not null)")
    ends = _union(able.select("graph_id", c("a").alias("end")), able.filter("mode = 'slot'").select("graph_id", c("b").alias("end"))).distinct()
    cone = _held(cones(schema, ends))
    has = cone.select("graph_id", "end").distinct()  # an end whose cone is empty connects nothing
    able = able.join(has.withColumnRenamed("end", "a"), ["graph_id", "a"], "left_semi")
    able = _union(able.filter("mode <> 'slot'"), able.filter("mode = 'slot'").join(has.withColumnRenamed("end", "b"), ["graph_id", "b"], "left_semi"))
    spec = _held(specificity(schema))
    any_ = F.size("surface") == 0
    props = matched_properties(idx, view, able.filter(~any_)).join(spec, ["graph_id", "p"])
    x = _held(able.join(props, ["graph_id", "surface"]).select("rid", "graph_id", "a", "b", "mode", "derived", "surface", "p", "spec"))
    free = _held(able.filter(any_))  # these take every property, by what connects their ends and not by a row for each of its pairs
    ev = {k: _held(v) for k, v in evidence(schema.edges, cone, able.select("graph_id", "a", "b").distinct()).items()}
    key, external = ["rid", "spec"], c("mode") == "external"
    tier = lambda df, name: df.select(*key, F.lit(name).alias("tier"))
    every = free.join(spec.select("graph_id", "spec").distinct(), "graph_id")

    def hits(name, *ends):
        more = [k for k in ev[name].columns if k not in ("graph_id", "p", *ends)]
        at = ev[name].join(spec, ["graph_id", "p"]).select("graph_id", *ends, *more, "spec").distinct()
        cols = ["rid", "mode", "derived", "spec", *more]
        return _union(x.join(ev[name], ["graph_id", *ends, "p"]).select(*cols), free.join(at, ["graph_id", *ends]).select(*cols))

    opened = _held(hits("open", "a").distinct())
    classes = view.filter("role = 'class'").select("graph_id", "term").join(schema.hubs, ["graph_id", "term"], "left_anti")
    named = _by_word(idx.join(classes, ["graph_id", "term"], "left_semi"), able.filter("not mode = 'external'").select("graph_id", "surface").distinct().select("graph_id", "surface", F.posexplode("surface").alias("rank", "x"))).select("graph_id", "surface", c("term").alias("x")).distinct()
    each = _held(_union(*[df.filter(~external).select("rid", "graph_id", "a", "b", "surface", "spec") for df in (x, every)]).distinct())
    rungs = [
        tier(hits("direct", "a", "b").filter(~external), "direct"),
        tier(opened.filter(external & ~c("derived")), "external"),
        tier(opened.filter(external & c("derived") & c("closed")), "external_uncertified"),
        tier(opened.filter(external & c("derived")), "external_open"),
        tier(each.join(named, ["graph_id", "surface"]).join(ev["hub"], ["graph_id", "a", "b", "x"], "left_semi"), "reified"),
        tier(hits("two", "a", "b").filter(~external), "indirect2"),
        tier(opened.filter("half"), "half"),
        tier(hits("mirror", "b").filter(~external), "half"),
        tier(each.join(ev["three"], ["graph_id", "a", "b"], "left_semi"), "path3"),
        tier(hits("floating"), "floating"),
    ]
    order = F.array_position(F.array(*map(F.lit, RUNGS)), c("tier"))
    best = _union(*rungs).distinct().groupBy(*key).agg(F.min_by("tier", order).alias("tier"))
    value = F.element_at(F.create_map(*[F.lit(v) for kv in RUNGS.items() for v in kv]), c("tier"))
    best = best.withColumn("credit", value * c("spec")).groupBy("rid").agg(F.max_by(F.struct("tier", "credit"), F.struct(F.round("credit", 9), "spec")).alias("r"))
    return _held(relations.select("rid").join(best, "rid", "left").select("rid", F.coalesce("r.tier", F.lit("none")).alias("tier"), F.coalesce("r.credit", F.lit(0.0)).alias("credit")))


def verify(t: DataFrame, signatures: DataFrame) -> DataFrame:
    """A row (graph_id, cq_id, cq, cq_type, source, status, coverage, connectivity, score, label, answerable, tiers) for each signature.

    A graph without triples scores 0 on every question, and those stay in every mean.
    """
    schema = Schema(t)
    q = _held(signatures.withColumn("q", F.monotonically_increasing_id()))
    no_anchor = F.array().cast("array<string>")
    slots = q.select("q", "graph_id", F.explode("slots").alias("s")).select("q", "graph_id", "s.id", "s.kind", F.coalesce("s.surface", no_anchor).alias("surface"), F.coalesce("s.anchors", no_anchor).alias("anchors"))
    rels = q.select("q", "graph_id", (c("source") == "derived").alias("derived"), F.posexplode("relations").alias("k", "r")).select("q", "graph_id", "derived", "k", "r.from", "r.to", F.coalesce("r.surface", no_anchor).alias("surface"))
    rels = _held(rels.withColumn("rid", F.concat_ws(":", "q", "k")))
    by_name = rels.filter(F.size("surface") > 0).select("q", "graph_id", F.lit("prop").alias("kind"), "surface", no_anchor.alias("anchors"))
    key = ["graph_id", "kind", "surface", "anchors"]
    bound = _held(bind(schema.index, schema.view, _union(slots.select(*key), by_name.select(*key))))
    slots = _held(slots.join(bound, key, "left").select("q", "id", "term", F.coalesce("score", F.lit(0.0)).alias("score")))
    parts = _union(slots.select("q", "score"), by_name.join(bound, key, "left").select("q", F.coalesce("score", F.lit(0.0)).alias("score")))
    coverage = parts.groupBy("q").agg(F.avg("score").alias("coverage"))
    end = lambda side: slots.select("q", c("id").alias(side), c("term").alias(side[0] + "_term"), c("score").alias(side[0] + "_score"))
    mode = F.when(c("to").isin("literal", "external"), c("to")).otherwise("slot")
    tied = rels.join(end("from"), ["q", "from"], "left").join(end("to"), ["q", "to"], "left").withColumn("mode", mode)
    gate = F.coalesce("f_score", F.lit(0.0))
    gate = F.when(c("mode") == "slot", F.least(gate, F.coalesce("t_score", F.lit(0.0)))).otherwise(gate)
    tied = _held(tied.select("q", "rid", "graph_id", c("f_term").alias("a"), c("t_term").alias("b"), "mode", "surface", "derived", gate.alias("gate")))
    credit = relation_credits(schema, tied.drop("q", "gate")).join(tied.select("q", "rid", "gate"), "rid").withColumn("credit", c("credit") * c("gate"))
    tie = credit.groupBy("q").agg(F.avg("credit").alias("connectivity"), F.max("credit").alias("best"), F.array_sort(F.collect_list("tier")).alias("tiers"))
    alive = schema.triples.select("graph_id").distinct().withColumn("alive", F.lit(True))
    x = q.join(alive, "graph_id", "left").join(coverage, "q", "left").join(tie, "q", "left")
    ok = c("alive").isNotNull()
    l1, l2, best = (F.when(ok, F.coalesce(k, F.lit(0.0))).otherwise(0.0) for k in ("coverage", "connectivity", "best"))
    score = F.when(best <= 0.15 + 1e-9, 0.125).otherwise(0.25) * l1 + 0.75 * l2
    label = F.when(score < 0.05, "unsupported").when(score < 0.30, "lexical-only").when(score < 0.70, "partial").otherwise("supported")
    return _held(x.select(
        "graph_id", "cq_id", "cq", "cq_type", "source", F.when(ok, "ok").otherwise("empty").alias("status"), F.round(l1, 4).alias("coverage"), F.round(l2, 4).alias("connectivity"),
        F.round(score, 4).alias("score"), label.alias("label"), ((l1 >= ANSWERABLE) & (l2 >= ANSWERABLE)).alias("answerable"), F.when(ok, F.coalesce("tiers", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("tiers"),
    ))


def rolled_up(questions: DataFrame, *keys: str) -> DataFrame:
    """The headline of a verification for each ``keys``: totals, passes, means (also of authored and of structural questions) and counts of types and rungs."""
    mean = lambda x, cond=None: F.round(F.avg(c(x) if cond is None else F.when(cond, c(x))), 4)
    tiers = questions.select(*keys, F.explode("tiers").alias("k")).groupBy(*keys, "k").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("tier_histogram"))
    out = questions.groupBy(*keys).agg(
        F.count("*").alias("cqs_total"), F.count_if("answerable").alias("cqs_passed"), F.count_if(~c("answerable")).alias("cqs_failed"),
        F.round(F.avg(c("answerable").cast("double")), 4).alias("pass_rate"), mean("score").alias("sev_score"), mean("coverage").alias("sev_coverage"), mean("connectivity").alias("sev_connectivity"),
        mean("score", c("source") == "authored").alias("sev_score_authored"), mean("score", c("cq_type") == "structural").alias("sev_score_structural"),
        F.count_if(c("source") == "authored").alias("cqs_authored"), F.count_if(c("source") == "derived").alias("cqs_derived"),
        *[F.count_if(c("cq_type") == k).alias(f"cqs_{k}") for k in ("meta", "data_dependent", "structural")],
    )
    return out.join(tiers, list(keys), "left")


def calibration(questions: DataFrame, exempt: DataFrame, least: float = 0.85) -> DataFrame:
    """(graph_id, authored, failing, state) of reference graphs: calibrated if every authored question scores ``least``; exempt (graph_id) ones may fail."""
    g = questions.filter("source = 'authored'").groupBy("graph_id").agg(F.count("*").alias("authored"), F.count_if(c("score") < least).alias("failing"))
    free = exempt.select("graph_id").distinct().withColumn("free", F.lit(True))
    return g.join(free, "graph_id", "left").select("graph_id", "authored", "failing", F.when(c("failing") == 0, "calibrated").when(c("free"), "exempt").otherwise("failing").alias("state"))
