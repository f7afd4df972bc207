"""Entailment over triples: a semi-naive fixpoint of RDFS and OWL-RL rules, consistency and classes without possible members.

Every rule has one of three forms, kept as rows of a table for each graph, so that a round is a handful of joins whatever the
number of rules:

* a map rewrites a triple by its predicate (and object): sub-properties, inverses, domains, ranges, values of restrictions;
* a path joins (x p1 y) and (y p2 z): chains of classes and properties, types, transitive properties, property chains, some-values;
* a fork joins (x p1 y) and (x p2 z): all-values, functional properties, intersections.

Lists are read by pointer jumping; property chains and intersections are cut into steps over list nodes, whose helper
predicates and classes never leave this module. A round joins what is new with all, on both sides, and keeps what was not known
before. Terms that are the same are united (components of sameAs) and every triple is written with the smallest of them, until nothing is
united any more; the result names all of them.

Covered, by the names of the OWL 2 RL rules: eq-sym, eq-trans, eq-rep-*, prp-dom, prp-rng, prp-fp, prp-ifp, prp-symp,
prp-trp, prp-spo1, prp-spo2, prp-eqp1/2, prp-inv1/2, cls-int1/2, cls-uni, cls-oo, cls-svf1/2, cls-avf, cls-hv1/2, cax-sco, cax-eqc1/2,
scm-sco, scm-spo, scm-dom1/2, scm-rng1/2, scm-eqc1, scm-eqp1, scm-int, scm-uni; clashes by eq-diff1/2/3, prp-irp,
prp-asyp, prp-pdw, cls-nothing2, cls-com, cls-maxc1, cax-dw, cax-adc. Reflexive and axiomatic triples are not made, nor are cardinalities
over 0, keys and datatypes.

Edge cases: literals take part as objects only; lists that are cut off or circular end where they are cut, or are left out;
empty graphs are consistent and entail nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from ..sources.rdf import OWL, RDF
from . import graph as G
from .fixpoints import components

c, g = F.col, "graph_id"
KEY = [g, "s", "p", "o"]
FIRST, REST, NIL, SAME, NOTHING, THING = RDF + "first", RDF + "rest", RDF + "nil", OWL + "sameAs", OWL + "Nothing", OWL + "Thing"
EQUIVALENT_PROPERTY = OWL + "equivalentProperty"
#: Prefixes of helper terms.
CHAIN, BACK, PART, QUOTE = "urn:cv:chain:", "urn:cv:back:", "urn:cv:part:", '"'


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _none(x: str) -> Column:
    return F.lit(None).cast("string").alias(x)


def _resource(x: str) -> Column:
    return ~c(x).startswith(QUOTE)


def _of(t: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    return t.filter((c("p") == p) & _resource("o")).select(g, c("s").alias(s), c("o").alias(o))


def list_members(t: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(graph_id, list, member) of lists by their first node. Pointers to earlier nodes double, so rounds grow with the logarithm of a list's length."""
    rest = _of(t, REST, "node", "next").filter(c("next") != NIL)
    nodes = _of(t, FIRST, "node", "member")
    up = materialize(nodes.select(g, "node").distinct().join(rest.groupBy(g, c("next").alias("node")).agg(F.min("node").alias("up")), [g, "node"], "left").select(g, "node", F.coalesce("up", "node").alias("up")))
    for _ in range(most_rounds):
        after = materialize(up.join(up.select(g, c("node").alias("up"), c("up").alias("further")), [g, "up"], "left").select(g, "node", F.coalesce("further", "up").alias("up")))
        same = after.join(up, [g, "node", "up"], "left_anti").isEmpty()
        discard(up)
        up = after
        if same:
            break
    return nodes.join(up, [g, "node"]).select(g, c("up").alias("list"), "member").distinct()


#: What a graph must say for some rule to exist: predicates, and types of properties.
_SAYS = [G.SUBP, G.INVERSE, G.DOMAIN, G.RANGE, FIRST, *[OWL + x for x in ("onProperty", "propertyChainAxiom", "intersectionOf", "unionOf", "oneOf")]]
_FLAGS = [OWL + x for x in ("SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty")]


def _said(t: DataFrame) -> set[str]:
    """Which of the words that rules come from stand in the triples; at most a row for each."""
    word = F.when(c("p").isin(_SAYS), c("p")).when((c("p") == G.TYPE) & c("o").isin(_FLAGS), c("o"))
    return {r.w for r in t.select(word.alias("w")).filter("w is not null").distinct().collect()}


class _Rules:
    """The three tables of rules of some triples. Rules whose words no graph uses are not planned at all."""

    def __init__(self, t: DataFrame):
        said = _said(t)
        when = lambda word, *rows: list(rows) if word in said else []
        on = _of(t, OWL + "onProperty", "x", "q")
        some, every = _of(t, OWL + "someValuesFrom", "x", "y"), _of(t, OWL + "allValuesFrom", "x", "y")
        value = t.filter(c("p") == OWL + "hasValue").select(g, c("s").alias("x"), c("o").alias("v"))
        first, rest = _of(t, FIRST, "node", "item"), _of(t, REST, "node", "next")
        link = materialize(first.join(rest, [g, "node"])) if FIRST in said else None
        chain, both = _of(t, OWL + "propertyChainAxiom", "q", "node"), _of(t, OWL + "intersectionOf", "x", "node")
        flag = lambda k: t.filter((c("p") == G.TYPE) & (c("o") == OWL + k)).select(g, c("s").alias("q"))
        step = lambda prefix, x: F.concat(F.lit(prefix), c(x))
        graphs, lit = t.select(g).distinct(), F.lit
        ON, (symmetric, transitive, functional, inverse_functional) = OWL + "onProperty", _FLAGS
        # maps: (p, needs) -> kind, q, k
        row = lambda df, p, kind, q=None, k=None, needs=None: df.select(g, p.alias("p"), *[(_none(n) if v is None else v.alias(n)) for n, v in (("needs", needs), ("q", q), ("k", k))], F.lit(kind).alias("kind"))
        maps = [row(graphs, lit(a), kind, lit(b)) for a, b in ((G.EQUIVALENT, G.SUB), (EQUIVALENT_PROPERTY, G.SUBP)) for kind in ("sub", "turn")]
        maps += when(G.SUBP, row(_of(t, G.SUBP), c("s"), "sub", c("o"))) + when(G.INVERSE, row(_of(t, G.INVERSE), c("s"), "turn", c("o")), row(_of(t, G.INVERSE), c("o"), "turn", c("s")))
        maps += when(G.DOMAIN, row(_of(t, G.DOMAIN), c("s"), "subject", k=c("o"))) + when(G.RANGE, row(_of(t, G.RANGE), c("s"), "object", k=c("o")))
        maps += when(symmetric, row(flag("SymmetricProperty"), c("q"), "turn", c("q"))) + when(inverse_functional, row(flag("InverseFunctionalProperty"), c("q"), "turn", step(BACK, "q")))
        maps += when(ON, row(on.join(value, [g, "x"]), c("q"), "subject", k=c("x"), needs=c("v")), row(on.join(value, [g, "x"]), lit(G.TYPE), "value", c("q"), c("v"), c("x")), row(on.join(some.filter(c("y") == THING), [g, "x"]), c("q"), "subject", k=c("x")))
        # paths: (x p y), (y p2 z or needs) -> (x q z or k)
        path = lambda df, p, p2, q, needs=None, k=None: df.select(g, p.alias("p"), p2.alias("p2"), _none("needs") if needs is None else needs.alias("needs"), q.alias("q"), _none("k") if k is None else k.alias("k"))
        fixed = [(G.SUB, G.SUB, G.SUB), (G.SUBP, G.SUBP, G.SUBP), (G.TYPE, G.SUB, G.TYPE), (G.DOMAIN, G.SUB, G.DOMAIN), (G.RANGE, G.SUB, G.RANGE), (G.SUBP, G.DOMAIN, G.DOMAIN), (G.SUBP, G.RANGE, G.RANGE)]
        words = F.explode(F.array(*[F.struct(*[F.lit(w).alias(n) for n, w in zip(("p", "p2", "q"), f, strict=True)]) for f in fixed])).alias("w")
        paths = [path(graphs.select(g, words).select(g, "w.*"), c("p"), c("p2"), c("q"))] + when(transitive, path(flag("TransitiveProperty"), c("q"), c("q"), c("q"))) + when(ON, path(on.join(some, [g, "x"]), c("q"), lit(G.TYPE), lit(G.TYPE), c("y"), c("x")))
        # forks: (x p y or needs), (x p2 z or needs2) -> kind
        fork = lambda df, p, needs, p2, needs2, kind, k=None: df.select(g, *[(_none(n) if v is None else v.alias(n)) for n, v in (("p", p), ("needs", needs), ("p2", p2), ("needs2", needs2), ("k", k))], F.lit(kind).alias("kind"))
        forks = when(ON, fork(on.join(every, [g, "x"]), lit(G.TYPE), c("x"), c("q"), None, "object", c("y")))
        forks += when(functional, fork(flag("FunctionalProperty"), c("q"), None, c("q"), None, "same")) + when(inverse_functional, fork(flag("InverseFunctionalProperty"), step(BACK, "q"), None, step(BACK, "q"), None, "same"))
        if link is not None:
            last, inner = link.filter(c("next") == NIL), link.filter(c("next") != NIL)
            maps += when(OWL + "propertyChainAxiom", row(last, c("item"), "sub", step(CHAIN, "node")), row(chain, step(CHAIN, "node"), "sub", c("q")))
            paths += when(OWL + "propertyChainAxiom", path(inner, c("item"), step(CHAIN, "next"), step(CHAIN, "node")))
            maps += when(OWL + "intersectionOf", row(last, lit(G.TYPE), "value", lit(G.TYPE), step(PART, "node"), c("item")), row(both, lit(G.TYPE), "value", lit(G.TYPE), c("x"), step(PART, "node")))
            forks += when(OWL + "intersectionOf", fork(inner, lit(G.TYPE), c("item"), lit(G.TYPE), step(PART, "next"), "subject", step(PART, "node")))
        self.maps, self.paths = materialize(_union(*maps).distinct()), materialize(_union(*paths).distinct())
        self.forks = materialize(_union(*forks).distinct()) if forks else None
        if link is not None:
            discard(link)

    def without(self, old: _Rules) -> _Rules:
        """The rules that ``old`` does not have."""
        out = object.__new__(_Rules)
        for name in ("maps", "paths", "forks"):
            mine, theirs = getattr(self, name), getattr(old, name)
            setattr(out, name, None if mine is None else materialize(mine if theirs is None else mine.exceptAll(theirs)))
        return out

    def drop(self) -> None:
        discard(*[x for x in (self.maps, self.paths, self.forks) if x is not None])


def _triple(df: DataFrame, s: Column, p: Column, o: Column) -> DataFrame:
    return df.select(g, s.alias("s"), p.alias("p"), o.alias("o")).filter(_resource("s"))


def _mapped(t: DataFrame, maps: DataFrame) -> DataFrame:
    x = t.join(maps, [g, "p"]).filter("needs is null or needs = o")
    kind = c("kind")
    s = F.when(kind.isin("turn", "object"), c("o")).otherwise(c("s"))
    p = F.when(kind.isin("subject", "object"), G.TYPE).otherwise(c("q"))
    return _triple(x, s, p, F.when(kind == "sub", c("o")).when(kind == "turn", c("s")).otherwise(c("k")))


def _paths(left: DataFrame, right: DataFrame, paths: DataFrame) -> DataFrame:
    x = left.filter(_resource("o")).join(paths, [g, "p"]).select(g, c("s").alias("a"), c("o").alias("s"), c("p2").alias("p"), "needs", "q", "k")
    x = x.join(right, KEY[:3]).filter("needs is null or needs = o")
    return _triple(x, c("a"), c("q"), F.coalesce("k", "o"))


def _forks(left: DataFrame, right: DataFrame, forks: DataFrame | None) -> DataFrame:
    if forks is None:
        return left.limit(0)
    x = left.join(forks, [g, "p"]).filter("needs is null or needs = o").select(g, "s", c("o").alias("a"), c("p2").alias("p"), "needs2", "kind", "k")
    x = x.join(right, KEY[:3]).filter("needs2 is null or needs2 = o").filter((c("kind") != "same") | (c("a") != c("o")) & _resource("a") & _resource("o"))
    kind = c("kind")
    return _triple(x, F.when(kind == "object", c("o")).when(kind == "same", c("a")).otherwise(c("s")), F.when(kind == "same", SAME).otherwise(G.TYPE), F.when(kind == "same", c("o")).otherwise(c("k")))


def _structure(t: DataFrame) -> DataFrame:
    """Triples that lists state of classes: parts of an intersection, of a union, of an enumeration."""
    if not _said(t) & {OWL + x for x in ("intersectionOf", "unionOf", "oneOf")}:
        return t.limit(0)
    member = list_members(t)
    of = lambda p: _of(t, p, "x", "list").join(member, [g, "list"]).select(g, "x", "member")
    both, either, one = of(OWL + "intersectionOf"), of(OWL + "unionOf"), of(OWL + "oneOf")
    return _union(_triple(both, c("x"), F.lit(G.SUB), c("member")), _triple(either, c("member"), F.lit(G.SUB), c("x")), _triple(one, c("member"), F.lit(G.TYPE), c("x"))).distinct()


def _saturated(t: DataFrame, most_rounds: int) -> DataFrame:
    """The fixpoint of the rules, without uniting terms."""
    new = materialize(_union(t, _structure(t)).distinct())
    rules = _Rules(new)
    fresh, parts = rules, [new]
    for _ in range(most_rounds):
        every = _union(*parts)
        made = [_mapped(new, rules.maps), _paths(new, every, rules.paths), _paths(every, new, rules.paths), _forks(new, every, rules.forks), _forks(every, new, rules.forks)]
        if fresh is not rules:  # rules that the last round brought meet what was there before
            made += [_mapped(every, fresh.maps), _paths(every, every, fresh.paths), _forks(every, every, fresh.forks)]
        new = materialize(_union(*made).distinct().join(every, KEY, "left_anti"))
        if fresh is not rules:
            fresh.drop()
        if new.isEmpty():
            discard(new)
            out = materialize(every)
            discard(*parts)
            rules.drop()
            return out
        parts.append(new)
        fresh = rules
        if not new.filter(c("p").isin(G.SUBP, G.INVERSE, G.DOMAIN, G.RANGE) | (c("p") == G.TYPE) & c("o").startswith(OWL)).isEmpty():
            after = _Rules(_union(*parts))
            fresh = after.without(rules)
            rules.drop()
            rules = after
    raise RuntimeError("entailment did not settle")


def _renamed(t: DataFrame, root: DataFrame) -> DataFrame:
    for x in ("s", "p", "o"):
        t = t.join(root.select(g, c("node").alias(x), c("root").alias("r")), [g, x], "left").withColumn(x, F.coalesce("r", x)).drop("r")
    return t.select(*KEY).distinct()


def closed(t: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(graph_id, s, p, o, o_kind, inferred): the triples with what they entail; ``inferred`` is false for those that are given."""
    given = materialize(t.select(g, "s", "p", F.when(c("o_kind") == "literal", F.concat(F.lit(QUOTE), c("o"))).otherwise(c("o")).alias("o")).distinct())
    now, known = given, None
    for _ in range(most_rounds):
        full = _saturated(now, most_rounds)
        same = full.filter((c("p") == SAME) & (c("s") != c("o")) & _resource("o")).select(g, c("s").alias("a"), c("o").alias("b"))
        if known is not None:
            same = _union(same, known.filter("node <> root").select(g, c("node").alias("a"), c("root").alias("b")))
        root = materialize(components(same))
        settled = (root if known is None else root.join(known, [g, "node", "root"], "left_anti")).isEmpty()
        known = root
        if settled:
            break
        now = materialize(_renamed(full, root))
        discard(full)
    else:
        raise RuntimeError("entailment did not settle")
    out = full.filter(~c("p").startswith(CHAIN) & ~c("p").startswith(BACK) & ~c("o").startswith(PART))
    for x in ("s", "p", "o"):  # every name of what was united
        out = out.join(known.select(g, c("root").alias(x), c("node").alias("n")), [g, x], "left").withColumn(x, F.coalesce("n", x)).drop("n")
    pairs = known.join(known.select(g, "root", c("node").alias("o")), [g, "root"]).select(g, c("node").alias("s"), F.lit(SAME).alias("p"), "o")
    out = _union(out.select(*KEY), pairs).distinct().join(given.withColumn("is_given", F.lit(True)), KEY, "left")
    bnode = c("o").startswith("_:")
    out = out.select(g, "s", "p", F.when(_resource("o"), c("o")).otherwise(F.substring("o", 2, 2**31 - 1)).alias("o"), F.when(~_resource("o"), "literal").when(bnode, "bnode").otherwise("iri").alias("o_kind"), c("is_given").isNull().alias("inferred"))
    out = materialize(out)
    discard(given, full)
    return out


def clashes(full: DataFrame) -> DataFrame:
    """(graph_id, s, reason): what cannot be true of a term in closed triples (graph_id, s, p, o, o_kind)."""
    t = materialize(full.filter("o_kind <> 'literal'").select(*KEY))
    typed = t.filter(c("p") == G.TYPE).select(g, "s", c("o").alias("k"))
    member = list_members(t) if FIRST in _said(t) else t.limit(0).select(g, c("s").alias("list"), c("o").alias("member"))
    pairs = member.join(member.withColumnRenamed("member", "other"), [g, "list"]).filter("member <> other")
    lists = lambda kind, p: _of(t, p, "x", "list").join(t.filter((c("p") == G.TYPE) & (c("o") == OWL + kind)).select(g, c("s").alias("x")), [g, "x"], "left_semi").join(pairs, [g, "list"]).select(g, c("member").alias("a"), c("other").alias("b"))
    apart = _union(_of(t, G.DISJOINT, "a", "b"), _of(t, OWL + "complementOf", "a", "b"), lists("AllDisjointClasses", OWL + "members"))
    both = typed.join(apart.select(g, c("a").alias("k"), "b"), [g, "k"]).join(typed.select(g, "s", c("k").alias("b")), [g, "s", "b"], "left_semi").select(g, "s", F.lit("disjoint classes").alias("reason"))
    nothing = typed.filter(c("k") == NOTHING).select(g, "s", F.lit("member of nothing").alias("reason"))
    unlike = _union(_of(t, OWL + "differentFrom", "a", "b"), lists("AllDifferent", OWL + "members"), lists("AllDifferent", OWL + "distinctMembers"))
    unlike = _union(unlike, unlike.select(g, c("b").alias("a"), c("a").alias("b")))
    same = _of(t, SAME, "a", "b").join(unlike, [g, "a", "b"], "left_semi").select(g, c("a").alias("s"), F.lit("same and different").alias("reason"))
    flag = lambda k: t.filter((c("p") == G.TYPE) & (c("o") == OWL + k)).select(g, c("s").alias("p"))
    loop = t.filter("s = o").join(flag("IrreflexiveProperty"), [g, "p"], "left_semi").select(g, "s", F.lit("irreflexive property").alias("reason"))
    turned = t.join(flag("AsymmetricProperty"), [g, "p"], "left_semi")
    turned = turned.join(turned.select(g, c("o").alias("s"), "p", c("s").alias("o")), KEY, "left_semi").select(g, "s", F.lit("asymmetric property").alias("reason"))
    rival = _of(t, OWL + "propertyDisjointWith", "p", "q")
    rival = t.join(rival, [g, "p"]).join(t.select(g, "s", c("p").alias("q"), "o"), [g, "s", "q", "o"], "left_semi").select(g, "s", F.lit("disjoint properties").alias("reason"))
    zero = full.filter((c("p") == OWL + "maxCardinality") & (c("o_kind") == "literal") & F.regexp_extract("o", r"^[^0-9]*0+[^0-9]*$", 0).startswith("0")).select(g, c("s").alias("k"))
    zero = zero.join(_of(t, OWL + "onProperty", "k", "p"), [g, "k"])
    zero = typed.join(zero, [g, "k"]).select(g, "s", "p").join(full.select(g, "s", "p"), [g, "s", "p"], "left_semi").select(g, "s", F.lit("more than none").alias("reason"))
    out = materialize(_union(both, nothing, same, loop, turned, rival, zero).distinct())
    discard(t)
    return out


def reasoned(t: DataFrame) -> DataFrame:
    """(graph_id, triples_before, triples_after, inferred_triples, consistent, unsatisfiable_classes, reasons) of every graph."""
    full = closed(t)
    wrong = clashes(full).groupBy(g).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    empty = full.filter((c("p") == G.SUB) & (c("o") == NOTHING) & (c("s") != NOTHING)).groupBy(g).agg(F.array_sort(F.collect_set("s")).alias("unsatisfiable_classes"))
    size = full.groupBy(g).agg(F.count_if(~c("inferred")).alias("triples_before"), F.count("*").alias("triples_after"), F.count_if("inferred").alias("inferred_triples"))
    none = F.array().cast("array<string>")
    x = size.join(wrong, g, "left").join(empty, g, "left")
    return x.select(g, "triples_before", "triples_after", "inferred_triples", c("reasons").isNull().alias("consistent"), F.coalesce("unsatisfiable_classes", none).alias("unsatisfiable_classes"), F.coalesce("reasons", none).alias("reasons"))
