"""Flat rows from nested evaluation records. Sections are structs with an ``error``; what a section does not know is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: The sections of a record that the rows read, with their fields.
SCHEMA = (
    "id string, model string, config string, rel_path string, source string, record_origin string, error string, truncated boolean, "
    "truncation struct<source:string,signals:array<string>,finish_reason:string>, "
    "ontometrics struct<triples_count:long,classes_count:long,object_properties_count:long,datatype_properties_count:long,annotation_properties_count:long,individuals_count:long,subclass_axioms:long,equivalence_axioms:long,disjoint_axioms:long,restriction_axioms:long,attribute_richness:double,relationship_richness:double,avg_subclass_per_class:double,error:string>, "
    "reasoner struct<consistent:boolean,vacuous:boolean,triples_before:long,triples_after:long,inferred_triples:long,unsatisfiable_classes:array<string>,error:string>, "
    "cq_verification struct<cqs_total:long,cqs_passed:long,cqs_failed:long,pass_rate:double,sev_score:double,skipped:boolean,error:string>, "
    "oops struct<pitfalls_total:long,important_count:long,critical_count:long,minor_pitfalls_skipped:long,pitfall_codes:array<string>,skipped:boolean,error:string>, "
    "structural struct<structural_score:double,gate:string>"
)
ONTOMETRICS = ["triples_count", "classes_count", "object_properties_count", "datatype_properties_count", "annotation_properties_count", "individuals_count", "subclass_axioms", "equivalence_axioms", "disjoint_axioms", "restriction_axioms", "attribute_richness", "relationship_richness", "avg_subclass_per_class"]
_MISSING = "ontology.ttl not found"


def status() -> Column:
    """missing, error, parse_error or ok."""
    return F.when(c("error") == _MISSING, "missing").when(c("error").isNotNull(), "error").when(c("ontometrics.error").isNotNull(), "parse_error").otherwise("ok")


def parseable() -> Column:
    return c("ontometrics").isNotNull() & c("ontometrics.error").isNull() & c("ontometrics.triples_count").isNotNull()


def _of(section: str, *fields: str) -> list[Column]:
    """Fields of a section, null where it failed."""
    return [F.when(c(f"{section}.error").isNull(), c(f"{section}.{f}")).alias(f) for f in fields]


def summary_row(records: DataFrame) -> DataFrame:
    """23 columns a record: identity, truncation, sizes, verdicts and scores."""
    return records.select(
        "model", "config", "id", "rel_path", "source", F.coalesce("record_origin", F.lit("this_run")).alias("record_origin"), status().alias("status"), "truncated", c("truncation.source").alias("truncation_source"),
        F.coalesce(F.array_join("truncation.signals", "; "), F.lit("")).alias("truncation_signals"), c("truncation.finish_reason").alias("finish_reason"),
        *_of("ontometrics", *ONTOMETRICS[:4]), *_of("reasoner", "consistent", "inferred_triples"), c("cq_verification.cqs_total").alias("cqs_total"), c("cq_verification.cqs_passed").alias("cqs_passed"), c("cq_verification.sev_score").alias("sev_score"),
        c("structural.structural_score").alias("structural_score"), c("structural.gate").alias("structural_gate"), c("oops.pitfalls_total").alias("oops_pitfalls_total"),
    )


def results_row(records: DataFrame) -> DataFrame:
    """35 columns a record; a section that failed gives nulls, counts of its lists are 0, and flags are never null."""
    sure = lambda x: F.coalesce(x, F.lit(False))
    scanned = c("oops").isNotNull() & c("oops.error").isNull() & ~sure(c("oops.skipped")) & c("oops.pitfalls_total").isNotNull()
    consistent = sure(c("reasoner.consistent") & c("reasoner.error").isNull() & ~sure(c("reasoner.vacuous")) & (c("ontometrics.triples_count") > 0))
    return records.select(
        "id", "model", "config", *_of("ontometrics", *ONTOMETRICS), *_of("reasoner", "consistent", "triples_before", "triples_after", "inferred_triples"),
        F.coalesce(F.when(c("reasoner.error").isNull(), F.size("reasoner.unsatisfiable_classes")), F.lit(0)).cast("long").alias("unsatisfiable_classes_count"),
        *_of("cq_verification", "cqs_total", "cqs_passed", "cqs_failed"), *[x.alias("cq_pass_rate") for x in _of("cq_verification", "pass_rate")], sure(c("cq_verification.skipped")).alias("cq_skipped"),
        scanned.alias("oops_scanned"), *[c(f"oops.{k}").alias(f"oops_{n}") for k, n in (("pitfalls_total", "pitfalls_total"), ("important_count", "important_count"), ("critical_count", "critical_count"), ("minor_pitfalls_skipped", "minor_skipped"))],
        F.coalesce(F.array_join("oops.pitfall_codes", "|"), F.lit("")).alias("oops_pitfall_codes"), F.coalesce("oops.error", F.lit("")).alias("oops_error"), parseable().alias("parseable"), consistent.cast("int").alias("consistency_score"),
    )


def manifest(records: DataFrame) -> DataFrame:
    """One row: files, those of this run and carried over, counts by status, of truncation and of its sources."""
    s = records.select(status().alias("s"), "truncated", F.coalesce("record_origin", F.lit("this_run")).alias("origin"), F.coalesce("truncation.source", F.lit("unavailable")).alias("t"))
    return s.agg(
        F.count("*").alias("n_files"), F.count_if(c("origin") == "this_run").alias("n_evaluated_this_run"), F.count_if(c("origin") != "this_run").alias("n_carried_over"),
        *[F.count_if(c("s") == k).alias(f"n_{k}") for k in ("ok", "missing", "error", "parse_error")], F.count_if("truncated").alias("n_truncated"), F.count_if(~c("truncated")).alias("n_complete"), F.count_if(c("truncated").isNull()).alias("n_truncation_unknown"),
        *[F.count_if(c("t") == k).alias(f"truncation_from_{k}") for k in ("metadata", "banner", "derived", "unavailable")],
    )
