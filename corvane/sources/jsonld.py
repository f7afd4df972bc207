"""JSON-LD to triples: contexts, terms, containers, lists, sets, graphs, languages, reverse properties.

Values are expanded as they are met, against the context that holds there, so no expanded copy of the document is made. A context
is a small table of terms; only contexts inside the document are read, and one that is named by an address is an error, for nothing is fetched.
"""

from __future__ import annotations

import json
from typing import Any
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
NIL = (RDF + "nil", "iri")
KEYWORDS = {"@id", "@type", "@value", "@language", "@list", "@set", "@graph", "@reverse", "@context", "@index", "@included", "@nest", "@json", "@none", "@vocab", "@base"}


class JsonLdError(ValueError):
    """The document is not JSON-LD, or needs something from elsewhere."""


class _Context:
    """Terms (name to id, type, container, language, reverse), the vocabulary, the base and the default language."""

    def __init__(self, terms: dict[str, dict] | None = None, vocab: str | None = None, base: str = "", language: str | None = None):
        self.terms, self.vocab, self.base, self.language = terms or {}, vocab, base, language

    def under(self, local: Any) -> _Context:
        now = self
        for c in local if isinstance(local, list) else [local]:
            if c is None:
                now = _Context(base=self.base)
                continue
            if not isinstance(c, dict):
                raise JsonLdError("contexts elsewhere are not fetched")
            base = now.base if c.get("@base") is None else urljoin(now.base, c["@base"])
            now = _Context(dict(now.terms), c.get("@vocab", now.vocab), base, c.get("@language", now.language))
            now.raw = c  # terms may lean on each other
            for name in c:
                if not name.startswith("@"):
                    now.define(name, set())
        return now

    def define(self, name: str, busy: set[str]) -> None:
        value = self.raw[name]
        if name in busy:
            raise JsonLdError(f"the term {name!r} is defined by itself")
        busy = busy | {name}
        if value is None:
            self.terms[name] = {"id": None}
            return
        value = {"@id": value} if isinstance(value, str) else value
        if not isinstance(value, dict):
            raise JsonLdError(f"the term {name!r} has no definition")
        for x in (value.get("@id", name), value.get("@reverse"), value.get("@type")):
            for part in (x, x.split(":")[0]) if isinstance(x, str) else ():
                if part in self.raw and part != name and not part.startswith("@"):
                    self.define(part, busy)
        own = value.get("@reverse") or value.get("@id", name)
        box = value.get("@container")
        self.terms[name] = {
            "id": own if own in KEYWORDS else self.iri(own, skip=name), "type": None if value.get("@type") is None else self.iri(value["@type"]),
            "container": set(box if isinstance(box, list) else [box]), "language": value.get("@language", False), "reverse": "@reverse" in value,
        }

    def iri(self, x: str, vocab: bool = True, skip: str | None = None) -> str | None:
        """The full name of a term, a shortened or a relative one; null for a term that stands for nothing."""
        if x in KEYWORDS:
            return x
        if vocab and x != skip and x in self.terms:
            return self.terms[x]["id"]
        prefix, colon, rest = x.partition(":")
        if colon:
            if prefix == "_" or rest.startswith("//"):
                return x
            if prefix in self.terms and self.terms[prefix]["id"]:
                return self.terms[prefix]["id"] + rest
            return x
        if vocab:
            return None if self.vocab is None else self.vocab + x
        return urljoin(self.base, x) if self.base else x


class _Reader:
    def __init__(self, graph: str):
        self.graph, self.made, self.triples = graph, 0, {}
        self.depth = 0

    def fresh(self) -> tuple[str, str]:
        self.made += 1
        return f"_:{self.graph}/b{self.made}", "bnode"

    def name(self, x: str | None) -> tuple[str, str] | None:
        if x is None:
            return None
        return (f"_:{self.graph}/n{x[2:]}", "bnode") if x.startswith("_:") else (x, "iri")

    def emit(self, s: tuple | None, p: str | None, o: tuple | None) -> None:
        if s and o and p and s[1] != "literal" and not p.startswith("_:") and ":" in p and (s[1] == "bnode" or ":" in s[0]):
            self.triples[(s[0], s[1], p, *(o + (None, None))[:4])] = None

    def node(self, x: dict, c: _Context) -> tuple | None:
        """The subject of a node object, whose triples are made."""
        self.depth += 1
        if self.depth > 200:
            raise JsonLdError("nested too deeply")
        c = c.under(x["@context"]) if "@context" in x else c
        key = {k: c.iri(k) for k in x if k != "@context"}
        ids = [x[k] for k, full in key.items() if full == "@id"]
        s = self.name(c.iri(ids[0], vocab=False)) if ids and isinstance(ids[0], str) else self.fresh()
        for k, full in key.items():
            v = x[k]
            if full == "@type":
                for t in v if isinstance(v, list) else [v]:
                    if isinstance(t, str):
                        self.emit(s, RDF + "type", self.name(c.iri(t) or c.iri(t, vocab=False)))
            elif full in ("@graph", "@included"):
                self.nodes(v, c)
            elif full == "@nest":
                for part in v if isinstance(v, list) else [v]:
                    self.node({**part, "@id": s[0] if s[1] == "iri" else "_:" + s[0].split("/n")[-1]}, c)
            elif full == "@reverse":
                for p, others in v.items():
                    for o in others if isinstance(others, list) else [others]:
                        self.emit(self.value(o, c, {}), c.iri(p), s)
            elif full and full not in KEYWORDS:
                term = c.terms.get(k, {})
                for o in self.values(v, c, term):
                    if term.get("reverse"):
                        self.emit(o, full, s)
                    else:
                        self.emit(s, full, o)
        self.depth -= 1
        return s

    def values(self, v: Any, c: _Context, term: dict):
        box = term.get("container") or set()
        if "@list" in box and not (isinstance(v, dict) and "@list" in v):
            yield self.listed(v if isinstance(v, list) else [v], c, term)
        elif "@language" in box and isinstance(v, dict):
            for lang, texts in v.items():
                for t in texts if isinstance(texts, list) else [texts]:
                    if t is not None:
                        yield self.text(t, None if lang == "@none" else lang)
        elif "@index" in box and isinstance(v, dict) and not {"@id", "@value"} & v.keys():
            for each in v.values():
                yield from self.values(each, c, {**term, "container": box - {"@index"}})
        elif "@id" in box and isinstance(v, dict):
            for i, each in v.items():
                yield self.value({"@id": i, **each}, c, term)
        else:
            for each in v if isinstance(v, list) else [v]:
                if isinstance(each, dict) and "@set" in each:
                    yield from self.values(each["@set"], c, term)
                elif each is not None:
                    yield self.value(each, c, term)

    def listed(self, items: list, c: _Context, term: dict) -> tuple:
        head = NIL
        term = {**term, "container": (term.get("container") or set()) - {"@list"}}
        found = [self.listed(x, c, term) if isinstance(x, list) else self.value(x, c, term) for x in items if x is not None]
        for o in reversed([x for x in found if x]):
            cell = self.fresh()
            self.emit(cell, RDF + "first", o)
            self.emit(cell, RDF + "rest", head)
            head = cell
        return head

    @staticmethod
    def text(x: str, lang: str | None) -> tuple:
        return (x, "literal", RDF + "langString", lang.lower()) if lang else (x, "literal", XSD + "string")

    def value(self, x: Any, c: _Context, term: dict) -> tuple | None:
        kind = term.get("type")
        if isinstance(x, dict):
            c = c.under(x["@context"]) if "@context" in x else c
            by = {c.iri(k): v for k, v in x.items() if k != "@context"}
            if "@value" in by:
                v, own = by["@value"], by.get("@type")
                if v is None:
                    return None
                if own == "@json":
                    return json.dumps(v, sort_keys=True, separators=(",", ":")), "literal", RDF + "JSON"
                if own:
                    return self.scalar(v, c.iri(own))
                return self.text(v, by.get("@language", None if "@language" in by else None)) if isinstance(v, str) else self.scalar(v, None)
            if "@list" in by:
                return self.listed(by["@list"] if isinstance(by["@list"], list) else [by["@list"]], c, term)
            return self.node(x, c)
        if isinstance(x, str):
            if kind in ("@id", "@vocab"):
                full = c.iri(x, vocab=kind == "@vocab")
                return self.name(full if full is not None else c.iri(x, vocab=False))
            if kind and kind not in KEYWORDS:
                return x, "literal", kind
            lang = term.get("language", False)
            return self.text(x, c.language if lang is False else lang)
        return self.scalar(x, kind if kind and kind not in KEYWORDS else None)

    @staticmethod
    def scalar(v: Any, kind: str | None) -> tuple:
        if isinstance(v, bool):
            return str(v).lower(), "literal", kind or XSD + "boolean"
        if isinstance(v, float) and (kind == XSD + "double" or not v.is_integer()):
            return repr(v), "literal", kind or XSD + "double"
        if isinstance(v, int | float):
            return str(int(v)), "literal", kind or XSD + "integer"
        return str(v), "literal", kind or XSD + "string"

    def nodes(self, x: Any, c: _Context) -> None:
        for each in x if isinstance(x, list) else [x]:
            if isinstance(each, list):
                self.nodes(each, c)
            elif isinstance(each, dict):
                full = {c.iri(k) for k in each if k != "@context"}
                if "@graph" in full and full <= {"@graph", "@index"}:  # a graph without a name of its own
                    under = c.under(each["@context"]) if "@context" in each else c
                    self.nodes(next(v for k, v in each.items() if k != "@context" and under.iri(k) == "@graph"), under)
                elif "@value" not in full:
                    self.node(each, c)


def parse_jsonld(text: str, graph: str = "", base: str = "") -> list[tuple]:
    """Triples of all graphs of a document together."""
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise JsonLdError(str(e)) from e
    if not isinstance(doc, dict | list):
        raise JsonLdError("a document is an object or an array")
    r = _Reader(graph)
    try:
        r.nodes(doc, _Context(base=base))
    except (AttributeError, TypeError, KeyError) as e:
        raise JsonLdError(f"not JSON-LD: {e}") from e
    return list(r.triples)
