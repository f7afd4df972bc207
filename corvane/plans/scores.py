"""Predicates, projections and scores of evaluation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as Q
from ..functions import scores as S
from ._bind import R, catalogue, read, records

QUERIES, ORACLES, _add = catalogue()
c = F.col
_CREDIT = "CASE WHEN consistent IS NULL THEN NULL WHEN triples = 0 THEN 0.0E0 WHEN consistent THEN 1.0E0 ELSE 0.0E0 END"
_PIT = "CASE WHEN state = 'scanned' THEN 1.0E0 / (1 + important + 2 * critical) WHEN state = 'failed' THEN 0.0E0 END"
_GATE = "CASE WHEN NOT parsed THEN 'unparseable' WHEN triples = 0 THEN 'empty' WHEN triples >= 10 AND classes > 0 AND properties > 0 THEN 'ok' ELSE 'near_empty' END"
_CAP = f"CASE {_GATE} WHEN 'ok' THEN 1.0E0 WHEN 'near_empty' THEN 0.5E0 ELSE 0.0E0 END"
_MEAN = f"CASE WHEN ({_CREDIT}) IS NULL AND ({_PIT}) IS NULL THEN NULL ELSE (coalesce({_CREDIT}, 0) + coalesce({_PIT}, 0)) / ((CASE WHEN ({_CREDIT}) IS NULL THEN 0 ELSE 1 END) + (CASE WHEN ({_PIT}) IS NULL THEN 0 ELSE 1 END)) END"
STRUCTURAL = f"coalesce(CASE WHEN ({_MEAN}) IS NULL THEN NULL ELSE least({_MEAN}, {_CAP}) END, 0.0E0)"


def credit():
    return S.consistency_credit(c("consistent"), c("triples") == 0)


def pitfalls():
    return S.scanned_component(c("state"), S.pitfall_component("weighted", c("total"), c("important"), c("critical")))


def structural():
    return S.structural_score(credit(), pitfalls(), S.content_gate(c("parsed"), c("triples"), c("classes"), c("properties"))["cap"])


@_add("math_oops_component", R + "SELECT id, 1.0E0 / (1 + total) AS a, 1.0E0 / (1 + important + 2 * critical) AS b, greatest(0.0E0, 1 - (important + 2 * critical) / 10.0E0) AS c, 1.0E0 / (1 + total + 2 * critical) AS d FROM r")
def oops_component(spark, sf_dir):
    names = {"a": "total", "b": "weighted", "c": "tenths", "d": "total_critical"}
    return records(spark, sf_dir).select("id", *[S.pitfall_component(f, c("total"), c("important"), c("critical")).alias(k) for k, f in names.items()])


@_add("math_consistency_credit", R + f"SELECT id, {_CREDIT} AS credit FROM r")
def consistency_credit(spark, sf_dir):
    return records(spark, sf_dir).select("id", credit().alias("credit"))


@_add("math_content_gate", R + f"SELECT id, {_GATE} AS gate, {_CAP} AS cap FROM r")
def content_gate(spark, sf_dir):
    return records(spark, sf_dir).select("id", S.content_gate(c("parsed"), c("triples"), c("classes"), c("properties")).alias("g")).select("id", "g.gate", "g.cap")


@_add("math_structural_score", R + f"SELECT id, round({STRUCTURAL}, 9) AS score FROM r")
def structural_score(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.round(structural(), 9).alias("score"))


@_add("math_structural_component", R + f"SELECT id, round(CASE WHEN id % 5 = 0 THEN 0.75E0 ELSE {STRUCTURAL} END, 9) AS score FROM r")
def structural_component(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.round(F.coalesce(F.when(c("id") % 5 == 0, 0.75), structural()), 9).alias("score"))


@_add("math_offline_scores", R + f"SELECT id, {_CREDIT} AS consistency, CAST(NULL AS DOUBLE) AS pitfalls, CASE WHEN ({_CREDIT}) IS NULL THEN NULL ELSE least({_CREDIT}, {_CAP}) END AS score FROM r")
def offline_scores(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("g", S.content_gate(c("parsed"), c("triples"), c("classes"), c("properties"))["cap"]).withColumn("k", credit())
    return r.select("id", c("k").alias("consistency"), F.lit(None).cast("double").alias("pitfalls"), F.when(c("k").isNotNull(), F.least("k", "g")).alias("score"))


@_add("math_offline_oops", R + "SELECT id, CAST(NULL AS INTEGER) AS status_code, CAST(NULL AS INTEGER) AS pitfalls_total, true AS skipped FROM r")
def offline_oops(spark, sf_dir):
    none = F.lit(None).cast("int")
    return records(spark, sf_dir).select("id", F.struct(none.alias("status_code"), none.alias("pitfalls_total"), F.lit(True).alias("skipped")).alias("o")).select("id", "o.*")


@_add("math_functional", R + "SELECT id, round(1.0E0 * important + 0.3E0 * (total - important), 9) AS penalty, round(1.0E0 / (1 + 0.5E0 * (important + 0.3E0 * (total - important))), 9) AS manual, round(0.5E0 / (1 + 0.5E0 * (important + 0.3E0 * (total - important))) + 0.5E0 * pass_rate, 9) AS functional FROM r")
def functional(spark, sf_dir):
    f = records(spark, sf_dir).select("id", S.functional_score(c("total"), c("important"), c("pass_rate")).alias("f"))
    return f.select("id", *[F.round(f"f.{k}", 9).alias(k) for k in ("penalty", "manual", "functional")])


_FLAGS = ["no_anchor", "strong_better_fit", "better_fit", "boilerplate", "duplicate_across", "duplicate_within", "generic_only"]


@_add("math_suspicion", R + """SELECT id, round(greatest(0.0E0, least(1.0E0, (1 - coalesce(pass_rate, 0)) * 0.5E0 + CASE WHEN id % 2 = 0 THEN 0.25E0 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.20E0 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 0.10E0 ELSE 0 END
  + CASE WHEN id % 5 = 0 THEN 0.15E0 ELSE 0 END + CASE WHEN id % 6 = 0 THEN 0.10E0 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 0.10E0 ELSE 0 END + CASE WHEN id % 8 = 0 THEN 0.05E0 ELSE 0 END
  + CASE WHEN triples % 9 >= 2 THEN 0.15E0 + 0.05E0 * least(triples % 9 - 2, 4) ELSE 0 END - least(0.15E0, 0.05E0 * (triples % 5)))), 6) AS suspicion FROM r""")
def suspicion(spark, sf_dir):
    flags = {k: c("id") % (i + 2) == 0 for i, k in enumerate(_FLAGS)}
    return records(spark, sf_dir).select("id", F.round(S.suspicion(F.coalesce("pass_rate", F.lit(0.0)), flags, c("triples") % 9, c("triples") % 5), 6).alias("suspicion"))


@_add("math_pair_debias", R + "SELECT id, (triples + classes) / 2.0E0 AS first, (properties + important) / 2.0E0 AS second FROM r")
def pair_debias(spark, sf_dir):
    return records(spark, sf_dir).select("id", ((c("triples") + c("classes")) / 2).alias("first"), ((c("properties") + c("important")) / 2).alias("second"))


@_add("math_audit_structural", R + f"SELECT id, ({_CREDIT} + {_PIT}) / 2 AS score FROM r")
def audit_structural(spark, sf_dir):
    return records(spark, sf_dir).select("id", ((credit() + pitfalls()) / 2).alias("score"))


@_add("math_cq_pass_rate", R + "SELECT id, CASE WHEN error IS NULL THEN pass_rate END AS pass_rate FROM r")
def cq_pass_rate(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.when(c("error").isNull(), c("pass_rate")).alias("pass_rate"))


@_add("math_mean_safe", R + "SELECT config, round(coalesce(avg(CASE WHEN id % 40 = 39 THEN pass_rate END), 0.0E0), 9) AS zero, round(avg(CASE WHEN id % 40 = 39 THEN pass_rate END), 9) AS missing FROM r GROUP BY config")
def mean_safe(spark, sf_dir):
    m = F.avg(F.when(c("id") % 40 == 39, c("pass_rate")))
    return records(spark, sf_dir).groupBy("config").agg(F.round(F.coalesce(m, F.lit(0.0)), 9).alias("zero"), F.round(m, 9).alias("missing"))


@_add("date_parse_iso", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_iso(spark, sf_dir):
    d = c("o_orderdate").cast("date")
    raw = F.when(c("o_orderkey") % 3 == 0, d.cast("string")).when(c("o_orderkey") % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.concat_ws("-", F.year(d), F.month(d), F.day(d)))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.iso_date(raw).alias("day"))


@_add("render_cell", R + "SELECT id, CASE WHEN consistent IS NULL THEN '' WHEN consistent THEN 'True' ELSE 'False' END AS a, coalesce(CAST(CASE WHEN pass_rate IS NULL THEN NULL ELSE triples END AS VARCHAR), '') AS b FROM r")
def render_cell(spark, sf_dir):
    return records(spark, sf_dir).select("id", S.cell(c("consistent"), "boolean").alias("a"), S.cell(F.when(c("pass_rate").isNotNull(), c("triples")), "number").alias("b"))


@_add("pred_status", R + "SELECT id, CASE WHEN id % 17 = 0 THEN 'missing' WHEN error IS NOT NULL THEN 'error' WHEN NOT parsed THEN 'parse_error' ELSE 'ok' END AS status FROM r")
def status(spark, sf_dir):
    return records(spark, sf_dir).select("id", S.record_status(c("id") % 17 != 0, c("error"), F.when(~c("parsed"), "syntax")).alias("status"))


@_add("pred_classify_file", R + "SELECT id, CASE WHEN error IS NOT NULL THEN 'read_error' WHEN triples % 11 = 3 THEN 'empty' WHEN NOT parsed THEN 'unparseable' WHEN triples = 0 THEN 'empty_graph' ELSE 'ok' END AS kind FROM r")
def classify_file(spark, sf_dir):
    return records(spark, sf_dir).select("id", S.file_class(c("error").isNotNull(), F.when(c("triples") % 11 == 3, 0).otherwise(1), c("parsed"), c("triples")).alias("kind"))


@_add("pred_damage_state", "SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'missing' WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 50 THEN 'too_small' WHEN doc_id % 9 = 0 THEN 'unparseable' ELSE 'ok' END AS state FROM documents")
def damage_state(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.damage_state(c("doc_id") % 19 != 0, c("n_chars"), c("doc_id") % 9 != 0).alias("state"))


@_add("pred_parseable", R + "SELECT id, parsed AS parseable, coalesce(consistent, false) AS consistent, triples = 0 AS vacuous FROM r")
def parseable(spark, sf_dir):
    return records(spark, sf_dir).select("id", c("parsed").alias("parseable"), F.coalesce("consistent", F.lit(False)).alias("consistent"), (c("triples") == 0).alias("vacuous"))


@_add("pred_oops_state", R + "SELECT state, count(*) AS n FROM r GROUP BY state")
def oops_state(spark, sf_dir):
    k = c("id") % 10
    s = S.scan_state(F.lit(True), k == 0, F.when(k == 1, "no response"), F.when(k > 1, 200))
    return records(spark, sf_dir).groupBy(s.alias("state")).agg(F.count("*").alias("n"))


@_add("pred_parsed_nonempty", R + "SELECT id FROM r WHERE parsed AND triples > 0")
def parsed_nonempty(spark, sf_dir):
    return records(spark, sf_dir).filter("parsed and triples > 0").select("id")


@_add("pred_is_meta", "SELECT page_id, page_id % 4 < 2 AS is_meta FROM pages")
def is_meta(spark, sf_dir):
    iri = F.when(c("page_id") % 4 == 0, F.concat(F.lit(S.META_NAMESPACES[2]), F.lit("Class"))).when(c("page_id") % 4 == 1, F.concat(F.lit(S.META_NAMESPACES[0]), F.lit("type"))).otherwise(c("url"))
    return read(spark, sf_dir, "pages").select("page_id", S.is_meta(iri).alias("is_meta"))


_NAMES = ["gpt-4o", "Llama-3.1-8B-Instruct", "bloomz-7b1", "gemini-pro", "Mistral-7B", "other", "claude-x"]
_PICK = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "][{} % 7 + 1]"


@_add("pred_chat_model", f"SELECT event_id, regexp_matches(lower({_PICK.format('event_id')}), 'chat|instruct|it|-rl|assistant|tulu|vicuna|alpaca') AS chat FROM events")
def chat_model(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, _NAMES)), (c("event_id") % 7).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", S.is_chat_model(name).alias("chat"))


_FAM = "CASE [0, 1, 2, 3, 4, 5, 6][{} % 7 + 1] WHEN 0 THEN 'openai' WHEN 1 THEN 'meta' WHEN 2 THEN 'bigscience' WHEN 3 THEN 'google' WHEN 4 THEN 'mistral' WHEN 5 THEN 'unknown' ELSE 'anthropic' END"


@_add("pred_judge_independence", f"SELECT event_id, {_FAM.format('event_id')} <> {_FAM.format('user_id')} AS independent FROM events")
def judge_independence(spark, sf_dir):
    pick = lambda k: F.get(F.array(*map(F.lit, _NAMES)), (c(k) % 7).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", S.independent(pick("event_id"), pick("user_id")).alias("independent"))


@_add("filter_date_window", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-30 00:00:00'")
def date_window(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderdate > timestamp_ntz'1997-06-30 00:00:00'").select("o_orderkey", "o_orderdate")


@_add("filter_in_lists", R + "SELECT id, model, config FROM r WHERE model IN ('en', 'fr') AND config IN ('src0', 'src1', 'src2') AND NOT (id % 100 IN (7, 8)) AND model || ':' || config <> 'fr:src2'")
def in_lists(spark, sf_dir):
    r = records(spark, sf_dir).filter(c("model").isin("en", "fr") & c("config").isin("src0", "src1", "src2") & ~(c("id") % 100).isin(7, 8))
    return r.filter(F.concat_ws(":", "model", "config") != "fr:src2").select("id", "model", "config")


@_add("filter_genuine", "SELECT event_id, user_id % 3 = 0 AS own FROM events WHERE value * 1000 >= 30000")
def genuine(spark, sf_dir):
    return read(spark, sf_dir, "events").filter(c("value") * 1000 >= 30000).select("event_id", (c("user_id") % 3 == 0).alias("own"))


@_add("filter_needs_oops", R + "SELECT id, error IS NOT NULL OR id % 17 = 0 AS failed, state <> 'scanned' AS needs_scan FROM r WHERE error IS NOT NULL OR id % 17 = 0 OR state <> 'scanned'")
def needs_oops(spark, sf_dir):
    failed, needs = c("error").isNotNull() | (c("id") % 17 == 0), c("state") != "scanned"
    return records(spark, sf_dir).filter(failed | needs).select("id", failed.alias("failed"), needs.alias("needs_scan"))


@_add("filter_gt_size", "SELECT doc_id, CASE WHEN n_chars <= 2000 THEN n_chars END AS size FROM documents")
def gt_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.when(c("n_chars") <= 2000, c("n_chars")).alias("size"))


# Nested records from documents and labels; the same in SQL, as one expression a field.
_NESTED = {
    "id": "CAST(d.doc_id AS {V})", "model": "d.lang", "config": "d.source", "rel_path": "concat(d.lang, '/', CAST(d.doc_id AS {V}))", "source": "'local'", "record_origin": "CASE WHEN d.doc_id % 8 = 0 THEN 'carried' END",
    "error": "CASE WHEN d.doc_id % 13 = 0 THEN 'ontology.ttl not found' WHEN d.doc_id % 17 = 0 THEN 'timeout' END", "truncated": "CASE WHEN l.toxic IS NOT NULL THEN l.toxic = 1 END", "t_source": "CASE d.doc_id % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'banner' WHEN 2 THEN 'derived' END",
    "finish_reason": "CASE WHEN d.doc_id % 4 = 0 THEN 'stop' END", "o_error": "CASE WHEN d.doc_id % 9 = 0 THEN 'bad syntax' END", "triples_count": "CAST(d.n_chars % 40 AS BIGINT)", "classes_count": "CAST(d.n_chars % 7 AS BIGINT)", "object_properties_count": "CAST(d.n_chars % 5 AS BIGINT)",
    "consistent": "CASE WHEN l.quality IS NOT NULL THEN l.quality = 1 END", "r_error": "CASE WHEN d.doc_id % 19 = 0 THEN 'reasoner' END", "vacuous": "d.n_chars % 11 = 0", "inferred": "CAST(d.n_chars % 23 AS BIGINT)", "n_bad": "CAST(d.doc_id % 4 AS BIGINT)",
    "cqs_total": "CAST(d.doc_id % 12 AS BIGINT)", "cqs_passed": "CAST(d.doc_id % 5 AS BIGINT)", "c_error": "CASE WHEN d.doc_id % 29 = 0 THEN 'cq' END", "skipped": "CASE WHEN d.doc_id % 3 > 0 THEN d.doc_id % 6 = 1 END",
    "total": "CAST(d.doc_id % 6 AS BIGINT)", "p_error": "CASE WHEN d.doc_id % 31 = 0 THEN 'scan' END", "gate": "CASE WHEN d.n_chars % 40 < 10 THEN 'near_empty' ELSE 'ok' END",
}


def _flat(text: str) -> str:
    return "SELECT " + ", ".join(f"{v.replace('{V}', text)} AS {k}" for k, v in _NESTED.items()) + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def nested(spark, sf_dir):
    """Records with their sections, from documents and labels."""
    for x in ("documents", "labels"):
        read(spark, sf_dir, x).createOrReplaceTempView(x)
    x = spark.sql(_flat("STRING"))
    many = lambda prefix, n: F.transform(F.slice(F.array(*map(F.lit, range(5))), 1, n.cast("int")), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    zero, half = F.lit(0).cast("long"), F.lit(0.5)
    sections = {
        "truncation": F.struct(c("t_source").alias("source"), F.when(c("t_source") == "derived", F.array(F.lit("open fence"), F.lit("length"))).alias("signals"), "finish_reason"),
        "ontometrics": F.struct("triples_count", "classes_count", "object_properties_count", *[zero.alias(k) for k in Q.ONTOMETRICS[3:10]], *[half.alias(k) for k in Q.ONTOMETRICS[10:]], c("o_error").alias("error")),
        "reasoner": F.struct("consistent", "vacuous", c("triples_count").alias("triples_before"), (c("triples_count") + c("inferred")).alias("triples_after"), c("inferred").alias("inferred_triples"), many("C", c("n_bad")).alias("unsatisfiable_classes"), c("r_error").alias("error")),
        "cq_verification": F.struct("cqs_total", "cqs_passed", (c("cqs_total") - c("cqs_passed")).alias("cqs_failed"), F.try_divide("cqs_passed", "cqs_total").alias("pass_rate"), half.alias("sev_score"), "skipped", c("c_error").alias("error")),
        "oops": F.struct(c("total").alias("pitfalls_total"), c("total").alias("important_count"), zero.alias("critical_count"), zero.alias("minor_pitfalls_skipped"), many("P0", c("n_bad")).alias("pitfall_codes"), F.lit(False).alias("skipped"), c("p_error").alias("error")),
        "structural": F.struct(half.alias("structural_score"), "gate"),
    }
    return x.select("id", "model", "config", "rel_path", "source", "record_origin", "error", "truncated", *[v.alias(k) for k, v in sections.items()])


_N = f"WITH r AS ({_flat('VARCHAR')}) "
_STATUS = "CASE WHEN error = 'ontology.ttl not found' THEN 'missing' WHEN error IS NOT NULL THEN 'error' WHEN o_error IS NOT NULL THEN 'parse_error' ELSE 'ok' END"
_if = lambda error, field, name=None: f"CASE WHEN {error} IS NULL THEN {field} END AS {name or field}"


@_add("proj_summary_row", _N + f"SELECT model, config, id, rel_path, source, coalesce(record_origin, 'this_run') AS record_origin, {_STATUS} AS status, truncated, t_source AS truncation_source, CASE WHEN t_source = 'derived' THEN 'open fence; length' ELSE '' END AS truncation_signals, finish_reason, {_if('o_error', 'triples_count')}, {_if('o_error', 'classes_count')}, {_if('o_error', 'object_properties_count')}, {_if('o_error', '0', 'datatype_properties_count')}, {_if('r_error', 'consistent')}, {_if('r_error', 'inferred', 'inferred_triples')}, cqs_total, cqs_passed, 0.5::DOUBLE AS sev_score, 0.5::DOUBLE AS structural_score, gate AS structural_gate, total AS oops_pitfalls_total FROM r")
def summary_row(spark, sf_dir):
    return Q.summary_row(nested(spark, sf_dir))


_ZEROS = ", ".join(_if("o_error", "0", k) for k in Q.ONTOMETRICS[3:10]) + ", " + ", ".join(_if("o_error", "0.5::DOUBLE", k) for k in Q.ONTOMETRICS[10:])


@_add("proj_results_row", _N + f"SELECT id, model, config, {_if('o_error', 'triples_count')}, {_if('o_error', 'classes_count')}, {_if('o_error', 'object_properties_count')}, {_ZEROS}, {_if('r_error', 'consistent')}, {_if('r_error', 'triples_count', 'triples_before')}, {_if('r_error', 'triples_count + inferred', 'triples_after')}, {_if('r_error', 'inferred', 'inferred_triples')}, CASE WHEN r_error IS NULL THEN n_bad ELSE 0 END AS unsatisfiable_classes_count, {_if('c_error', 'cqs_total')}, {_if('c_error', 'cqs_passed')}, {_if('c_error', 'cqs_total - cqs_passed', 'cqs_failed')}, CASE WHEN c_error IS NULL AND cqs_total > 0 THEN cqs_passed::DOUBLE / cqs_total END AS cq_pass_rate, coalesce(skipped, false) AS cq_skipped, p_error IS NULL AS oops_scanned, total AS oops_pitfalls_total, total AS oops_important_count, 0 AS oops_critical_count, 0 AS oops_minor_skipped, array_to_string(list_transform(range(0, n_bad), lambda i: 'P0' || i), '|') AS oops_pitfall_codes, coalesce(p_error, '') AS oops_error, o_error IS NULL AS parseable, CASE WHEN consistent AND r_error IS NULL AND NOT vacuous AND triples_count > 0 THEN 1 ELSE 0 END AS consistency_score FROM r")
def results_row(spark, sf_dir):
    return Q.results_row(nested(spark, sf_dir))


@_add("sink_manifest", _N + f", s AS (SELECT *, {_STATUS} AS st, coalesce(t_source, 'unavailable') AS ts FROM r) SELECT count(*) AS n_files, count(*) FILTER (WHERE record_origin IS NULL) AS n_evaluated_this_run, count(record_origin) AS n_carried_over, " + ", ".join(f"count(*) FILTER (WHERE st = '{k}') AS n_{k}" for k in ("ok", "missing", "error", "parse_error")) + ", count(*) FILTER (WHERE truncated) AS n_truncated, count(*) FILTER (WHERE NOT truncated) AS n_complete, count(*) FILTER (WHERE truncated IS NULL) AS n_truncation_unknown, " + ", ".join(f"count(*) FILTER (WHERE ts = '{k}') AS truncation_from_{k}" for k in ("metadata", "banner", "derived", "unavailable")) + " FROM s")
def manifest(spark, sf_dir):
    return Q.manifest(nested(spark, sf_dir))
