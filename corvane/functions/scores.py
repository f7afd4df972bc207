"""Scores and states of evaluation records as Column functions. Null is missing: never zero, unless a formula says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least triples of a graph that says something, and the cap of one that says less.
LEAST_TRIPLES, NEAR_EMPTY_CAP = 10, 0.5
# Weights of unsupported and of scenario-justified additions, their scale, and the mix of both scores.
UNSUPPORTED, JUSTIFIED, SCALE = 1.0, 0.3, 0.5
# Name parts of chat models.
CHAT_WORDS = ["chat", "instruct", "it", "-rl", "assistant", "tulu", "vicuna", "alpaca"]
# Families by name part, first match wins.
FAMILIES = [("gpt", "openai"), ("o1", "openai"), ("claude", "anthropic"), ("gemini", "google"), ("llama", "meta"), ("mistral", "mistral"), ("bloom", "bigscience")]
# Vocabularies that describe the language itself.
META_NAMESPACES = ["http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"]


def pitfall_component(formula: str, total: Column, important: Column, critical: Column) -> Column:
    """Four formulas: ``total``, ``weighted``, ``tenths`` and ``total_critical``."""
    if formula == "total":
        return 1 / (1 + total)
    if formula == "weighted":
        return 1 / (1 + important + 2 * critical)
    if formula == "tenths":
        return F.greatest(F.lit(0.0), 1 - (important + 2 * critical) / 10)
    if formula == "total_critical":
        return 1 / (1 + total + 2 * critical)
    raise ValueError(f"unknown formula {formula!r}")


def scan_state(present: Column, skipped: Column, error: Column, status: Column) -> Column:
    """``scanned``, ``failed`` or ``unavailable``."""
    return F.when(~present | F.coalesce(skipped, F.lit(False)), "unavailable").when(error.isNotNull(), "failed").when(status.isNull() | (status != 200), "unavailable").otherwise("scanned")


def scanned_component(state: Column, component: Column) -> Column:
    """A failed scan is 0; one that nobody made is missing."""
    return F.when(state == "scanned", component).when(state == "failed", 0.0)


def consistency_credit(consistent: Column, vacuous: Column) -> Column:
    """Missing without a verdict; 0 for a graph that says nothing."""
    return F.when(consistent.isNull(), F.lit(None).cast("double")).when(vacuous, 0.0).when(consistent, 1.0).otherwise(0.0)


def content_gate(parsed: Column, triples: Column, classes: Column, properties: Column) -> Column:
    """(gate, cap): what a graph may score at most, by what it says."""
    said = (triples >= LEAST_TRIPLES) & (classes > 0) & (properties > 0)
    gate = F.when(~parsed, "unparseable").when(triples == 0, "empty").when(said, "ok").otherwise("near_empty")
    return F.struct(gate.alias("gate"), F.when(gate.isin("unparseable", "empty"), 0.0).when(gate == "ok", 1.0).otherwise(NEAR_EMPTY_CAP).alias("cap"))


def available_mean(*parts: Column) -> Column:
    """The mean of the parts that are there, null if none is."""
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / n)


def structural_score(credit: Column, pitfalls: Column, cap: Column) -> Column:
    """The mean of what is available, at most the cap; 0 when nothing is."""
    mean = available_mean(credit, pitfalls)
    return F.when(mean.isNull(), 0.0).otherwise(F.least(mean, cap))


def functional_score(added: Column, unsupported: Column, pass_rate: Column) -> Column:
    """(penalty, manual, functional)."""
    penalty = UNSUPPORTED * unsupported + JUSTIFIED * (added - unsupported)
    manual = 1.0 / (1.0 + SCALE * penalty)
    return F.struct(penalty.alias("penalty"), manual.alias("manual"), (0.5 * manual + 0.5 * pass_rate).alias("functional"))


def record_status(present: Column, error: Column, parse_error: Column) -> Column:
    return F.when(~present, "missing").when(error.isNotNull(), "error").when(parse_error.isNotNull(), "parse_error").otherwise("ok")


def file_class(read_error: Column, size: Column, parsed: Column, triples: Column) -> Column:
    return F.when(read_error, "read_error").when(size == 0, "empty").when(~parsed, "unparseable").when(triples == 0, "empty_graph").otherwise("ok")


def damage_state(present: Column, size: Column, parsed: Column) -> Column:
    """Files under 50 bytes are too small to hold anything."""
    return F.when(~present, "missing").when(size == 0, "empty").when(size < 50, "too_small").when(~parsed, "unparseable").otherwise("ok")


def is_chat_model(name: Column) -> Column:
    out = F.lit(False)
    for w in CHAT_WORDS:
        out = out | F.lower(name).contains(w)
    return out


def family(name: Column) -> Column:
    out = F.lit("unknown")
    for part, value in reversed(FAMILIES):
        out = F.when(F.lower(name).contains(part), value).otherwise(out)
    return out


def independent(judge: Column, generator: Column) -> Column:
    """Whether two models are of different families; two unknown families conflict."""
    return family(judge) != family(generator)


def is_meta(iri: Column) -> Column:
    out = F.lit(False)
    for ns in META_NAMESPACES:
        out = out | iri.startswith(ns)
    return out


def suspicion(home: Column, flags: dict[str, Column], island: Column, siblings: Column) -> Column:
    """Additive weights in 0..1 for a misplaced question, less a discount for siblings that corroborate it."""
    # Weights by flag.
    weights = {"no_anchor": 0.25, "strong_better_fit": 0.20, "better_fit": 0.10, "boilerplate": 0.15, "duplicate_across": 0.10, "duplicate_within": 0.10, "generic_only": 0.05}
    total = (1 - home) * 0.5
    for k, w in weights.items():
        total = total + F.when(flags[k], w).otherwise(0.0)
    total = total + F.when(island >= 2, 0.15 + 0.05 * F.least(island - 2, F.lit(4))).otherwise(0.0) - F.least(F.lit(0.15), 0.05 * siblings)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def iso_date(c: Column) -> Column:
    """A strict Y-M-D date, with or without leading zeros, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), c.try_cast("date"))


def cell(c: Column, kind: str) -> Column:
    """Text of a table cell: True and False in words, missing blank."""
    text = F.when(c, "True").otherwise("False") if kind == "boolean" else c.cast("string")
    return F.when(c.isNull(), "").otherwise(text)
