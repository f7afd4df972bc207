"""RDF text to triples: Turtle (with N-Triples), TriG, N3, RDF/XML, JSON-LD and OWL/XML declarations, read by our own small parsers.

A triple is (s, s_kind, p, o, o_kind, o_datatype, o_lang); kinds are iri, bnode and literal. Blank nodes are numbered per
artefact and carry its id, so graphs never share them. Triples of a graph are a set.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .jsonld import parse_jsonld

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<directive>@(?:prefix|base)\b|(?i:(?:prefix|base)\b(?=[ \t]*[<\w:])))|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))|(?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>a\b|true\b|false\b|(?i:graph)\b(?=\s*[<\w:\[]))|(?P<variable>\?\w+)|(?P<mark>\^\^|=>|<=|[.;,\[\](){}=])""",
    re.VERBOSE,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


class ParseError(ValueError):
    """The text is not of the syntax that was tried."""


def _unescape(x: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), x)


def _tokens(text: str, whole: bool = True) -> tuple[list[tuple[str, str]], list[int]]:
    """Tokens and where each ends; unless ``whole``, reading stops where no token can be read."""
    out, ends, at = [], [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if not whole:
                break
            raise ParseError(f"at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
            ends.append(at)
    return out, ends


class _Turtle:
    """One pass over the tokens; nested blank nodes are kept on an explicit depth count, not beyond 200.

    ``syntax`` may be ``turtle``, ``trig`` (blocks of named graphs, whose triples all count) or ``n3`` (formulas in braces, which are
    read and stand for a blank node, variables, and the signs ``=``, ``=>`` and ``<=``).
    """

    def __init__(self, text: str, graph: str, base: str = "", syntax: str = "turtle", whole: bool = True):
        self.tokens, self.ends = _tokens(text, whole)
        self.at, self.graph, self.base, self.syntax = 0, graph, base, syntax
        self.prefixes: dict[str, str] = {}
        self.names: dict[str, str] = {}
        self.made, self.depth = 0, 0
        self.triples: dict[tuple, None] = {}

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind and k != kind) or (value and v != value):
            raise ParseError(f"{value or kind} expected, {v!r} found")
        self.at += 1
        return v

    def fresh(self) -> tuple[str, str]:
        self.made += 1
        return f"_:{self.graph}/b{self.made}", "bnode"

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.triples[(s[0], s[1], p, *(o + (None, None))[:4])] = None

    def iri(self, v: str) -> str:
        return urljoin(self.base, _unescape(v[1:-1])) if self.base else _unescape(v[1:-1])

    def name(self, v: str) -> str:
        prefix, local = v.split(":", 1)
        if prefix not in self.prefixes:
            raise ParseError(f"prefix {prefix!r} is not declared")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            if self.peek()[0] == "directive":
                self.directive()
            else:
                self.statement()
        return list(self.triples)

    def parse_whole(self) -> int:
        """Read statement by statement; the end of the last whole one. What an unfinished one has begun is undone."""
        end = 0
        while self.peek()[0] != "end":
            before = len(self.triples)
            try:
                if self.peek()[0] == "directive":
                    self.directive()
                else:
                    self.statement()
            except (ParseError, RecursionError, ValueError):
                for t in list(self.triples)[before:]:
                    del self.triples[t]
                break
            end = self.ends[self.at - 1]
        return end

    def directive(self) -> None:
        v = self.take("directive")
        if v.lower().endswith("prefix"):
            k = self.take("pname")
            if not k.endswith(":"):
                raise ParseError("a prefix ends with a colon")
            self.prefixes[k[:-1]] = self.iri(self.take("iri"))
        else:
            self.base = self.iri(self.take("iri"))
        if v.startswith("@"):
            self.take("mark", ".")

    def block(self) -> None:
        """Statements in braces; the last may do without a full stop."""
        self.take("mark", "{")
        while self.peek() != ("mark", "}"):
            s = self.node()
            if self.peek() not in (("mark", "."), ("mark", "}")):
                self.predicates(s)
            if self.peek() != ("mark", "}"):
                self.take("mark", ".")
        self.take("mark", "}")

    def statement(self) -> None:
        if self.syntax == "trig":
            named = self.peek()[0] == "word" and self.peek()[1].lower() == "graph"
            if named:
                self.at += 1
            after = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else ("end", "")
            if named or after == ("mark", "{"):
                self.node()
            if named or self.peek() == ("mark", "{"):
                self.block()
                if self.peek() == ("mark", "."):
                    self.at += 1
                return
        if self.peek() == ("mark", "["):
            s = self.node()
            if self.peek() != ("mark", "."):
                self.predicates(s)
        else:
            s = self.node()
            if s[1] == "literal":
                raise ParseError("a literal cannot be a subject")
            self.predicates(s)
        self.take("mark", ".")

    def predicates(self, s: tuple) -> None:
        while True:
            k, v = self.peek()
            if k == "word" and v == "a":
                self.at += 1
                p = RDF + "type"
            elif k == "iri":
                p = self.iri(self.take())
            elif self.syntax == "n3" and (k, v) in SIGNS:
                self.at += 1
                p = SIGNS[k, v]
            else:
                p = self.name(self.take("pname"))
            self.emit(s, p, self.node())
            while self.peek() == ("mark", ","):
                self.at += 1
                self.emit(s, p, self.node())
            if self.peek() != ("mark", ";"):
                return
            while self.peek() == ("mark", ";"):
                self.at += 1
            if self.peek() in (("mark", "."), ("mark", "]"), ("mark", "}"), ("end", "")):
                return

    def node(self) -> tuple:
        k, v = self.peek()
        self.at += 1
        if k == "iri":
            return self.iri(v), "iri"
        if k == "pname":
            return self.name(v), "iri"
        if k == "bnode":
            return self.names.setdefault(v, f"_:{self.graph}/n{v[2:]}"), "bnode"
        if k in ("string", "long"):
            text = _unescape(v[3:-3] if k == "long" else v[1:-1])
            if self.peek()[0] == "lang":
                return text, "literal", RDF + "langString", self.take()[1:].lower()
            if self.peek() == ("mark", "^^"):
                self.at += 1
                return text, "literal", self.node()[0]
            return text, "literal", XSD + "string"
        if k == "number":
            return v, "literal", XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer")
        if k == "word" and v in ("true", "false"):
            return v, "literal", XSD + "boolean"
        if self.syntax == "n3" and k == "variable":
            return self.names.setdefault(v, f"_:{self.graph}/v{v[1:]}"), "bnode"
        if self.syntax == "n3" and (k, v) == ("mark", "{"):
            self.at -= 1
            asserted, self.triples = self.triples, {}
            self.block()
            self.triples = asserted
            return self.fresh()
        if (k, v) in (("mark", "["), ("mark", "(")):
            self.depth += 1
            if self.depth > 200:
                raise ParseError("nested too deeply")
            out = self.blank() if v == "[" else self.collection()
            self.depth -= 1
            return out
        raise ParseError(f"a term expected, {v!r} found")

    def blank(self) -> tuple:
        s = self.fresh()
        if self.peek() != ("mark", "]"):
            self.predicates(s)
        self.take("mark", "]")
        return s

    def collection(self) -> tuple:
        nil, items = (RDF + "nil", "iri"), []
        while self.peek() != ("mark", ")"):
            if self.peek()[0] == "end":
                raise ParseError("a list is not closed")
            items.append(self.node())
        self.take("mark", ")")
        head = nil
        for x in reversed(items):
            cell = self.fresh()
            self.emit(cell, RDF + "first", x)
            self.emit(cell, RDF + "rest", head)
            head = cell
        return head


#: Signs of N3 and what they stand for.
SIGNS = {("mark", "="): OWL + "sameAs", ("mark", "=>"): "http://www.w3.org/2000/10/swap/log#implies", ("mark", "<="): "http://www.w3.org/2000/10/swap/log#isImpliedBy"}


def parse_turtle(text: str, graph: str = "") -> list[tuple]:
    return _Turtle(text, graph).parse()


def parse_trig(text: str, graph: str = "") -> list[tuple]:
    return _Turtle(text, graph, syntax="trig").parse()


def parse_n3(text: str, graph: str = "") -> list[tuple]:
    return _Turtle(text, graph, syntax="n3").parse()


def whole_statements(text: str, graph: str = "") -> tuple[int, list[tuple]]:
    """Where the last whole statement of a text that breaks off ends, and the triples up to there."""
    t = _Turtle(text, graph, whole=False)
    end = t.parse_whole()
    return end, list(t.triples)


def parse_rdfxml(text: str, graph: str = "") -> list[tuple]:
    """RDF/XML: node and property elements, parse types, typed and plain literals, collections."""
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError as e:
        raise ParseError(str(e)) from e
    R, made, out = f"{{{RDF}}}", [0], {}
    xml = "{http://www.w3.org/XML/1998/namespace}"

    def fresh():
        made[0] += 1
        return f"_:{graph}/b{made[0]}", "bnode"

    def iri(tag):
        if not tag.startswith("{"):
            raise ParseError(f"{tag} has no namespace")
        return tag[1:].replace("}", "", 1)

    def emit(s, p, o):
        out[(s[0], s[1], p, *(o + (None, None))[:4])] = None

    def node(e, base, lang):
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        if e.get(R + "about") is not None:
            s = urljoin(base, e.get(R + "about")), "iri"
        elif e.get(R + "ID"):
            s = f"{base}#{e.get(R + 'ID')}", "iri"
        elif e.get(R + "nodeID"):
            s = f"_:{graph}/n{e.get(R + 'nodeID')}", "bnode"
        else:
            s = fresh()
        if e.tag != R + "Description":
            emit(s, RDF + "type", (iri(e.tag), "iri"))
        for k, v in e.attrib.items():
            if not k.startswith((R, xml)) and k.startswith("{"):
                emit(s, iri(k), (v, "literal", XSD + "string"))
        for child in e:
            prop(s, child, base, lang)
        return s

    def prop(s, e, base, lang):
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        p, kind = iri(e.tag), e.get(R + "parseType")
        if e.get(R + "resource") is not None:
            emit(s, p, (urljoin(base, e.get(R + "resource")), "iri"))
        elif e.get(R + "nodeID"):
            emit(s, p, (f"_:{graph}/n{e.get(R + 'nodeID')}", "bnode"))
        elif kind == "Resource":
            b = fresh()
            emit(s, p, b)
            for child in e:
                prop(b, child, base, lang)
        elif kind == "Collection":
            cells = [(fresh(), node(child, base, lang)) for child in e]
            emit(s, p, cells[0][0] if cells else (RDF + "nil", "iri"))
            for i, (cell, item) in enumerate(cells):
                emit(cell, RDF + "first", item)
                emit(cell, RDF + "rest", cells[i + 1][0] if i + 1 < len(cells) else (RDF + "nil", "iri"))
        elif len(e):
            for child in e:
                emit(s, p, node(child, base, lang))
        else:
            kind = e.get(R + "datatype")
            emit(s, p, (e.text or "", "literal", RDF + "langString", lang.lower()) if lang and not kind else (e.text or "", "literal", kind or XSD + "string"))

    if root.tag == R + "RDF":
        for child in root:
            node(child, root.get(xml + "base", ""), root.get(xml + "lang"))
    elif root.tag.startswith("{" + OWL) or not root.tag.startswith("{"):
        raise ParseError("not RDF/XML")
    else:
        node(root, "", None)
    return list(out)


def parse_owlxml(text: str, graph: str = "") -> list[tuple]:
    """Declarations, and labels and comments, of OWL/XML."""
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError as e:
        raise ParseError(str(e)) from e
    O, out = f"{{{OWL}}}", {}
    if root.tag != O + "Ontology":
        raise ParseError("not OWL/XML")
    names = {p.get("name"): p.get("IRI") for p in root.iter(O + "Prefix")}
    base = root.get("{http://www.w3.org/XML/1998/namespace}base") or root.get("ontologyIRI") or ""

    def iri(e):
        if e.get("IRI") is not None:
            return urljoin(base, e.get("IRI")) if not e.get("IRI").startswith("#") else base + e.get("IRI")
        prefix, _, local = (e.get("abbreviatedIRI") or "").partition(":")
        return names.get(prefix, "") + local

    kinds = {"Class": "Class", "ObjectProperty": "ObjectProperty", "DataProperty": "DatatypeProperty", "AnnotationProperty": "AnnotationProperty", "NamedIndividual": "NamedIndividual", "Datatype": "Datatype"}
    for d in root.iter(O + "Declaration"):
        for e in d:
            if (k := e.tag.replace(O, "")) in kinds:
                out[(iri(e), "iri", RDF + "type", OWL + kinds[k], "iri", None, None)] = None
    for a in root.iter(O + "AnnotationAssertion"):
        parts = list(a)
        if len(parts) == 3 and iri(parts[0]) in (RDFS + "label", RDFS + "comment", "rdfs:label", "rdfs:comment") and parts[2].tag == O + "Literal":
            p = RDFS + iri(parts[0]).replace(RDFS, "").replace("rdfs:", "")
            s = urljoin(base, parts[1].text or "") if not (parts[1].text or "").startswith("#") else base + parts[1].text
            out[(s, "iri", p, parts[2].text or "", "literal", XSD + "string", None)] = None
    return list(out)


PARSERS = {"turtle": parse_turtle, "xml": parse_rdfxml, "owlxml": parse_owlxml, "jsonld": parse_jsonld, "trig": parse_trig, "n3": parse_n3}


def sniff(text: str) -> list[str]:
    """Syntaxes to try, likeliest first; N-Triples are Turtle."""
    head = text.lstrip()[:4096]
    rest = ["n3", "jsonld", "trig"]
    if head.startswith("<") and re.search(r"<(\?xml|!DOCTYPE|!--|[\w:]*RDF\b|Ontology\b|owl:)", head):
        return ["owlxml", "xml", "turtle", *rest] if "<Ontology" in head else ["xml", "owlxml", "turtle", *rest]
    if head.startswith(("{", "[")):
        return ["jsonld", "turtle", "xml", "n3", "trig", "owlxml"]
    return ["turtle", "xml", *rest, "owlxml"]


def parse_any(text: str, graph: str = "", mode: str = "ladder") -> tuple[str, list[tuple]]:
    """(status, triples): parsed, empty or unparseable; never raises.

    ``ladder`` tries Turtle, then RDF/XML and takes the first success, be it empty; ``nonempty`` goes on until there is a
    triple, with OWL/XML last; ``sniff`` lets the text decide the order among all syntaxes, and reads a blank text as empty. Texts
    are read whole, whatever their size.
    """
    if text is None:
        return "unparseable", []
    if mode == "sniff" and not text.strip():
        return "empty", []
    order = {"ladder": ["turtle", "xml"], "nonempty": ["turtle", "xml", "owlxml"], "sniff": sniff(text)}[mode]
    seen_empty = False
    for name in order:
        try:
            got = PARSERS[name](text, graph)
        except (ParseError, RecursionError, ValueError):
            continue
        if got or mode == "ladder":
            return ("parsed" if got else "empty"), got
        seen_empty = True
    return ("empty" if seen_empty else "unparseable"), []


def triples(artefacts: DataFrame, mode: str = "ladder") -> DataFrame:
    """SCHEMA rows from (graph_id, text); artefacts without triples give none."""
    ship(artefacts.sparkSession)

    names, most = ["graph_id", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"], 20_000

    def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), most):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows[a : a + most], strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []  # of many small artefacts, as a batch of its own for each costs more than the parsing
        for batch in batches:
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(g, *r) for r in parse_any(text, g or "", mode)[1]]
                if len(rows) >= most:
                    yield from made(rows)
                    rows = []
        yield from made(rows)

    return artefacts.select("graph_id", "text").mapInArrow(run, SCHEMA)


def parse_status(artefacts: DataFrame, mode: str = "sniff", least: int = 20) -> DataFrame:
    """(graph_id, status, n_triples): no_ontology under ``least`` characters, else parsed, empty or unparseable."""
    ship(artefacts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = [("no_ontology", []) if len((t or "").strip()) < least else parse_any(t, g or "", mode) for g, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([s for s, _ in got]), pa.array([len(r) for _, r in got], pa.int64())], names=["graph_id", "status", "n_triples"])

    return artefacts.select("graph_id", "text").mapInArrow(run, "graph_id string, status string, n_triples long")


def scan_tree(spark: SparkSession, root: str, name: str = "ontology.ttl") -> DataFrame:
    """(model, config, id, rel_path, bytes, sha256, text) of all files ``name`` below ``root``; short paths are padded with <unknown>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.select(*path_key(F.col("path")), F.col("path").alias("rel_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def path_key(path):
    """Columns model, config and id from the tail of a path ``.../model/config/id/file``."""
    parts = F.split(path, "/")
    pick = lambda i: F.coalesce(F.get(parts, F.size(parts) + i), F.lit("<unknown>"))
    return [pick(-4).alias("model"), pick(-3).alias("config"), pick(-2).alias("id")]
