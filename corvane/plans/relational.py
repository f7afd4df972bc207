"""Roll-ups, rankings, joins, diffs and survey statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import rollups as U
from ..operators import survey as V
from ._bind import R, catalogue, read, records
from .scores import STRUCTURAL, pitfalls, structural

QUERIES, ORACLES, _add = catalogue()
c = F.col
r9 = lambda x: F.round(x, 9)
_PIT = "CASE WHEN state = 'scanned' THEN 1.0E0 / (1 + important + 2 * critical) WHEN state = 'failed' THEN 0.0E0 END"


@_add("agg_model_config", R + f"""SELECT model, config, count(*) AS n, count(*) FILTER (WHERE truncated) AS n_truncated, count(*) FILTER (WHERE NOT truncated) AS n_not_truncated, count(*) FILTER (WHERE truncated IS NULL) AS n_truncated_unknown,
 count(error) AS n_errors, round(avg({STRUCTURAL}), 9) AS mean_all, round(avg(CASE WHEN NOT truncated THEN {STRUCTURAL} END), 9) AS mean_complete FROM r GROUP BY model, config""")
def model_config(spark, sf_dir):
    s = structural()
    return records(spark, sf_dir).groupBy("model", "config").agg(F.count("*").alias("n"), *U.three_valued(c("truncated"), "truncated"), F.count("error").alias("n_errors"), r9(F.avg(s)).alias("mean_all"), r9(F.avg(F.when(~c("truncated"), s))).alias("mean_complete"))


@_add("agg_model_config_offline", R + "SELECT model, config, count(*) AS n, count(*) FILTER (WHERE error IS NULL AND parsed) AS n_ok, count(*) FILTER (WHERE error IS NOT NULL) AS n_error, count(*) FILTER (WHERE NOT parsed) AS n_unparseable, round(avg(pass_rate), 9) AS mean_rate, count(pass_rate) AS n_rate FROM r GROUP BY model, config")
def model_config_offline(spark, sf_dir):
    ok = c("error").isNull() & c("parsed")
    return records(spark, sf_dir).groupBy("model", "config").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count("error").alias("n_error"), F.count_if(~c("parsed")).alias("n_unparseable"), r9(F.avg("pass_rate")).alias("mean_rate"), F.count("pass_rate").alias("n_rate"))


_SUM = f"""count(*) AS n_total, count(*) FILTER (WHERE parsed) AS n_parseable, round(avg(CASE WHEN parsed THEN 1.0E0 ELSE 0 END), 9) AS parse_rate, round(avg(CASE WHEN consistent THEN 1.0E0 ELSE 0 END), 9) AS consistency_rate,
 round(avg({_PIT}), 9) AS avg_pitfalls, round(avg({STRUCTURAL}), 9) AS structural, round(avg(pass_rate), 9) AS avg_rate, count(*) FILTER (WHERE state = 'unavailable') AS n_unavailable"""


def _summary():
    rate = lambda x: r9(F.avg(F.when(x, 1.0).otherwise(0.0)))
    return [F.count("*").alias("n_total"), F.count_if("parsed").alias("n_parseable"), rate(c("parsed")).alias("parse_rate"), rate(c("consistent")).alias("consistency_rate"), r9(F.avg(pitfalls())).alias("avg_pitfalls"), r9(F.avg(structural())).alias("structural"), r9(F.avg("pass_rate")).alias("avg_rate"), F.count_if(c("state") == "unavailable").alias("n_unavailable")]


@_add("agg_summarise", R + f"SELECT model, {_SUM} FROM r GROUP BY model")
def summarise(spark, sf_dir):
    return records(spark, sf_dir).groupBy("model").agg(*_summary())


@_add("agg_table", R + f"SELECT coalesce(config, 'ALL') AS config, model, {_SUM} FROM r GROUP BY GROUPING SETS ((model), (model, config))")
def table(spark, sf_dir):
    return records(spark, sf_dir).groupingSets([["model"], ["model", "config"]], "model", "config").agg(*_summary()).withColumn("config", F.coalesce("config", F.lit("ALL")))


@_add("agg_functional", R + "SELECT model, config, count(*) AS n, round(avg(total), 9) AS avg_added, round(avg(1.0E0 / (1 + 0.5E0 * (important + 0.3E0 * (total - important)))), 9) AS avg_manual, round(avg(0.5E0 / (1 + 0.5E0 * (important + 0.3E0 * (total - important))) + 0.5E0 * pass_rate), 9) AS avg_functional FROM r GROUP BY model, config")
def functional(spark, sf_dir):
    from ..functions.scores import functional_score

    f = functional_score(c("total"), c("important"), c("pass_rate"))
    return records(spark, sf_dir).groupBy("model", "config").agg(F.count("*").alias("n"), r9(F.avg("total")).alias("avg_added"), r9(F.avg(f["manual"])).alias("avg_manual"), r9(F.avg(f["functional"])).alias("avg_functional"))


# Five scores of a judged event: its value and four digits that its keys give.
_SCORES = {"overall": "value", "accuracy": "CAST(event_id % 10 + 1 AS DOUBLE)", "coverage": "CAST((event_id + user_id) % 10 + 1 AS DOUBLE)", "clarity": "CASE WHEN event_id % 11 > 0 THEN CAST(user_id % 7 + 1 AS DOUBLE) END", "usefulness": "CASE WHEN user_id % 13 > 0 THEN CAST(event_id % 4 + 1 AS DOUBLE) END"}


@_add("agg_judge_group", "SELECT user_id, count(*) AS n, " + ", ".join(f"round(avg({k}), 9) AS mean_{k}, round(CASE WHEN count({k}) = 1 THEN 0.0E0 ELSE stddev_samp({k}) END, 6) AS sd_{k}" for k in _SCORES) + " FROM (SELECT user_id, " + ", ".join(f"{v} AS {k}" for k, v in _SCORES.items()) + " FROM events) GROUP BY user_id")
def judge_group(spark, sf_dir):
    """Mean and sample deviation of five scores for each user (0 of one score, null of none)."""
    e = read(spark, sf_dir, "events").select("user_id", *[F.expr(v).alias(k) for k, v in _SCORES.items()])
    return e.groupBy("user_id").agg(F.count("*").alias("n"), *[x for k in _SCORES for x in (r9(F.avg(k)).alias(f"mean_{k}"), F.round(U.sample_spread(c(k)), 6).alias(f"sd_{k}"))])


@_add("agg_crosstab", R + "SELECT config, round(avg(triples) FILTER (WHERE model = 'de'), 9) AS de, round(avg(triples) FILTER (WHERE model = 'en'), 9) AS en, round(avg(triples) FILTER (WHERE model = 'es'), 9) AS es, round(avg(triples) FILTER (WHERE model = 'fr'), 9) AS fr FROM r GROUP BY config")
def crosstab(spark, sf_dir):
    t = U.crosstab(records(spark, sf_dir), "config", "model", "triples", ["de", "en", "es", "fr"])
    return t.select("config", *[r9(k).alias(k) for k in ("de", "en", "es", "fr")])


@_add("agg_likert", "SELECT event_type, count(value) AS n, round(avg(value), 9) AS mean, round(median(value), 9) AS median, round(stddev_samp(value), 6) AS sd FROM events GROUP BY event_type")
def likert(spark, sf_dir):
    return V.likert(read(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", r9("mean").alias("mean"), r9("median").alias("median"), F.round("sd", 6).alias("sd"))


_ANS = "['Yes', 'Maybe', 'No', ''][event_id % 4 + 1]"
_SAVED = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE [0.0, 13.0, 38.0][event_id % 3 + 1]::DOUBLE END"
_AD = f"""count(*) AS total, count(*) FILTER (WHERE a = 'Yes') AS yes, count(*) FILTER (WHERE a = 'Maybe') AS maybe, count(*) FILTER (WHERE a = 'No') AS no, round(100.0E0 * count(*) FILTER (WHERE a = 'Yes') / greatest(1, count(*)), 9) AS yes_pct,
 round(100.0E0 * count(*) FILTER (WHERE a = 'Maybe') / greatest(1, count(*)), 9) AS maybe_pct, round(100.0E0 * count(*) FILTER (WHERE a = 'No') / greatest(1, count(*)), 9) AS no_pct, round(avg(s), 9) AS mean_time_saved, count(s) AS n_time_saved,
 round(CASE WHEN count(s) > 0 THEN 100.0E0 * count(*) FILTER (WHERE s = 0) / count(s) END, 9) AS zero_time_pct"""


@_add("agg_adoption", f"SELECT event_type, {_AD} FROM (SELECT *, {_ANS} AS a, {_SAVED} AS s FROM events) GROUP BY GROUPING SETS ((event_type), ())")
def adoption(spark, sf_dir):
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (c("event_id") % k).cast("int"))
    e = read(spark, sf_dir, "events").withColumn("a", pick(["Yes", "Maybe", "No", ""], 4)).withColumn("s", F.when(c("event_id") % 5 != 0, pick([0.0, 13.0, 38.0], 3)))
    out = V.adoption(e, "event_type", "a", "s")
    return out.select("event_type", "total", "yes", "maybe", "no", *[r9(k).alias(k) for k in ("yes_pct", "maybe_pct", "no_pct", "mean_time_saved")], "n_time_saved", r9("zero_time_pct").alias("zero_time_pct"))


@_add("agg_student_track", "SELECT coalesce(event_type, 'Overall') AS track, round(avg(value), 9) AS clarity, round(100.0E0 * count(*) FILTER (WHERE value > 50) / greatest(1, count(*)), 9) AS high_pct FROM events GROUP BY GROUPING SETS ((event_type), ())")
def student_track(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupingSets([["event_type"], []], "event_type")
    return g.agg(r9(F.avg("value")).alias("clarity"), r9(100.0 * F.count_if(c("value") > 50) / F.greatest(F.lit(1), F.count("*"))).alias("high_pct")).select(F.coalesce("event_type", F.lit("Overall")).alias("track"), "clarity", "high_pct")


_TRACKS = ["click", "error", "purchase", "signup", "view"]


@_add("agg_per_pattern", "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{k}'), 9) AS {k}" for k in _TRACKS) + " FROM events GROUP BY user_id")
def per_pattern(spark, sf_dir):
    t = U.crosstab(read(spark, sf_dir, "events"), "user_id", "event_type", "value", _TRACKS)
    return t.select("user_id", *[r9(k).alias(k) for k in _TRACKS])


@_add("agg_by_level", "SELECT CASE WHEN user_id % 2 = 0 THEN 'MSc' ELSE 'PhD' END AS level, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY 1")
def by_level(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.when(c("user_id") % 2 == 0, "MSc").otherwise("PhD").alias("level")).agg(F.count("*").alias("n"), r9(F.avg("value")).alias("mean"))


@_add("agg_own_pattern", "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean FROM events WHERE user_id % 3 = 0 GROUP BY event_type")
def own_pattern(spark, sf_dir):
    return read(spark, sf_dir, "events").filter("user_id % 3 = 0").groupBy("event_type").agg(F.count("*").alias("n"), r9(F.avg("value")).alias("mean"))


@_add("agg_coverage", "WITH f AS (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 5 <> 0 OR event_type <> 'view') SELECT a.user_id, b.event_type FROM (SELECT DISTINCT user_id FROM f) a CROSS JOIN (SELECT DISTINCT event_type FROM f) b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = a.user_id AND f.event_type = b.event_type)")
def coverage(spark, sf_dir):
    return U.missing_cells(read(spark, sf_dir, "events").filter("user_id % 5 <> 0 or event_type <> 'view'"), "user_id", "event_type")


@_add("agg_weighted_mean", "WITH g AS (SELECT event_type, user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, round(sum(m * n) / greatest(1, sum(n)), 6) AS mean FROM g GROUP BY event_type")
def weighted_mean(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return g.groupBy("event_type").agg(F.round(U.weighted_mean(c("m"), c("n")), 6).alias("mean"))


_RAT = "SELECT user_id AS u, CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 5 + 1 END AS DOUBLE) AS v FROM events"


def _alpha_sql(distance):
    return f"""
WITH r0 AS ({_RAT}), s AS (SELECT u, v, count(*) AS k FROM r0 WHERE v IS NOT NULL GROUP BY u, v), m AS (SELECT *, sum(k) OVER (PARTITION BY u) AS m FROM s), z AS (SELECT * FROM m WHERE m >= 2),
f AS (SELECT v, sum(k) AS f FROM z GROUP BY v), p AS (SELECT a.v AS a, b.v AS b, a.f AS fa, b.f AS fb, (SELECT sum(f) FROM f WHERE f.v BETWEEN least(a.v, b.v) AND greatest(a.v, b.v)) AS g FROM f a JOIN f b ON a.v <> b.v),
d AS (SELECT *, {distance} AS d FROM p)
SELECT round(1 - (SELECT sum(x.k * y.k * d.d / (x.m - 1)) FROM z x JOIN z y ON x.u = y.u AND x.v <> y.v JOIN d ON d.a = x.v AND d.b = y.v) / ((SELECT sum(fa * fb * d) FROM d) / ((SELECT sum(f) FROM f) - 1)), 9)::DOUBLE AS alpha, (SELECT count(DISTINCT u) FROM z) AS n_units"""


def _ratings(spark, sf_dir):
    return read(spark, sf_dir, "events").select(c("user_id").alias("u"), F.when(c("event_id") % 7 != 0, F.floor("value") % 5 + 1).cast("double").alias("v"))


@_add("agg_krippendorff", _alpha_sql("power(g - (fa + fb) / 2.0E0, 2)"))
def krippendorff(spark, sf_dir):
    return V.krippendorff(_ratings(spark, sf_dir), "u", "v").select(r9("alpha").alias("alpha"), "n_units")


@_add("agg_krippendorff_nominal", _alpha_sql("1.0E0"))
def krippendorff_nominal(spark, sf_dir):
    return V.krippendorff(_ratings(spark, sf_dir), "u", "v", "nominal").select(r9("alpha").alias("alpha"), "n_units")


_PAIRS = "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 0) AS a, round(avg(value) FILTER (WHERE event_type = 'view'), 0) AS b FROM events GROUP BY user_id"


@_add("agg_wilcoxon", f"""
WITH p AS ({_PAIRS}), d AS (SELECT b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0E0 AS r FROM d WHERE d <> 0),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0.0E0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0.0E0 END) AS wm FROM k)
SELECT (SELECT count(*) FROM d) AS n_pairs, n, least(wp, wm) AS w, round((wp - wm) / (wp + wm), 9) AS r_rb FROM s""")
def wilcoxon(spark, sf_dir):
    p = U.crosstab(read(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view"]).select(F.lit(1).alias("g"), F.round("click", 0).alias("a"), F.round("view", 0).alias("b"))
    return V.signed_ranks(p, "a", "b", ["g"]).select("n_pairs", "n", "w", r9("r_rb").alias("r_rb"))


@_add("agg_wilcoxon_p", None)
def wilcoxon_p(spark, sf_dir):
    """Paired rank test with its p value (checked against known values in the tests)."""
    p = U.crosstab(read(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view"]).select(F.lit(1).alias("g"), c("click").alias("a"), c("view").alias("b"))
    return V.with_wilcoxon_p(V.signed_ranks(p, "a", "b", ["g"]))


@_add("agg_audit_empty", R + "SELECT model, config, count(*) AS n, count(*) FILTER (WHERE triples = 0) AS n_empty, count(*) FILTER (WHERE triples = 0 AND consistent) AS n_vacuous FROM r GROUP BY GROUPING SETS ((model), (model, config), ())")
def audit_empty(spark, sf_dir):
    g = records(spark, sf_dir).groupingSets([["model"], ["model", "config"], []], "model", "config")
    return g.agg(F.count("*").alias("n"), F.count_if(c("triples") == 0).alias("n_empty"), F.count_if((c("triples") == 0) & c("consistent")).alias("n_vacuous"))


@_add("agg_audit_contamination", """
WITH w AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)),
 o AS (SELECT source, line, count(*) AS n FROM w ANTI JOIN b USING (line) GROUP BY ALL), k AS (SELECT source, string_agg(sha256(line), ',' ORDER BY n DESC, sha256(line)) AS top FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, sha256(line)) AS i FROM o) WHERE i <= 3 GROUP BY source)
SELECT source, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_real, count(*) FILTER (WHERE b.line IS NULL) AS n_other, CASE WHEN count(b.line) = 0 THEN 'clean' WHEN count(b.line) < 5 THEN 'suspicious' ELSE 'contaminated' END AS verdict, any_value(k.top) AS top FROM w LEFT JOIN b USING (line) LEFT JOIN k USING (source) GROUP BY source""")
def audit_contamination(spark, sf_dir):
    """Lines of the benchmark and others in each source, and the three commonest others; lines are counted by their hashes before they meet a source."""
    w = read(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).select("source", F.sha2("line", 256).alias("h")).groupBy("source", "h").agg(F.count("*").alias("n"))
    b = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).select(F.sha2("line", 256).alias("h")).distinct().withColumn("real", F.lit(True))
    each = w.join(b, "h", "left")
    g = each.groupBy("source").agg(F.sum(F.when(c("real"), c("n")).otherwise(0)).alias("n_real"), F.sum(F.when(c("real").isNull(), c("n")).otherwise(0)).alias("n_other"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "h"))
    top = each.filter("real is null").withColumn("i", place).filter("i <= 3").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), ",").alias("top"))
    verdict = F.when(c("n_real") == 0, "clean").when(c("n_real") < 5, "suspicious").otherwise("contaminated")
    return g.join(top, "source", "left").withColumn("verdict", verdict)


@_add("agg_dr_census", R + "SELECT model, CAST(sum(properties) AS BIGINT) AS stored, CAST(sum(greatest(properties, CASE WHEN parsed THEN classes ELSE 0 END)) AS BIGINT) AS recovered FROM r GROUP BY model")
def dr_census(spark, sf_dir):
    out = records(spark, sf_dir).groupBy("model").agg(F.sum("properties").alias("stored"), F.sum(F.greatest(c("properties"), F.when(c("parsed"), c("classes")).otherwise(0))).alias("recovered"))
    return out


@_add("agg_degenerate", R + f"SELECT model, count(*) FILTER (WHERE triples < 10 AND ({STRUCTURAL}) >= 0.5) AS n_suspicious, min(triples) FILTER (WHERE ({STRUCTURAL}) = 1) AS smallest_perfect FROM r GROUP BY model")
def degenerate(spark, sf_dir):
    s = structural()
    return records(spark, sf_dir).groupBy("model").agg(F.count_if((c("triples") < 10) & (s >= 0.5)).alias("n_suspicious"), F.min(F.when(s == 1, c("triples"))).alias("smallest_perfect"))


@_add("agg_faithfulness", """
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS q FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(w, q))::DOUBLE / greatest(1, len(q)), 9) AS recall, len(list_intersect(w, q)) >= 0.4 * len(q) AS covered, round((len(w) - len(list_intersect(w, q)))::DOUBLE / greatest(1, len(w)), 9) AS extra FROM t CROSS JOIN b""")
def faithfulness(spark, sf_dir):
    """Recall and share of extra words of all documents against all items; pairs that share no word have a row, too.

    Shared words are counted by an equi-join and folded into one map a document, in which each item finds its count; so pairs are made once and never shuffled.
    """
    toks = lambda k: F.array_distinct(F.regexp_extract_all(F.lower(k), F.lit("[a-z]{3,}"), F.lit(0)))
    t = read(spark, sf_dir, "documents").select("doc_id", toks("text").alias("w"))
    t = t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # all below goes by document; a number, as few bytes become many rows
    b = read(spark, sf_dir, "benchmark").select("item_id", toks("text").alias("q"))
    shared = t.select("doc_id", F.explode("w").alias("x")).join(b.filter("item_id is not null").select("item_id", F.explode("q").alias("x")), "x").groupBy("doc_id", "item_id").agg(F.count("*").alias("i"))
    shared = shared.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "i"))).alias("m"))
    x = t.select("doc_id", F.size("w").alias("nw")).join(shared, "doc_id", "left").crossJoin(b.select("item_id", F.size("q").alias("nq")))
    x = x.withColumn("i", F.coalesce(c("m")[c("item_id")], F.lit(0)))
    return x.select("doc_id", "item_id", r9(c("i") / F.greatest(F.lit(1), c("nq"))).alias("recall"), (c("i") >= 0.4 * c("nq")).alias("covered"), r9((c("nw") - c("i")) / F.greatest(F.lit(1), c("nw"))).alias("extra"))


@_add("agg_theme_counts", "SELECT source, theme, count(*) AS n FROM (SELECT source, unnest(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'scope' END, CASE WHEN contains(lower(text), 'und') THEN 'naming' END], lambda x: x IS NOT NULL)) AS theme FROM documents) GROUP BY ALL")
def theme_counts(spark, sf_dir):
    from ..functions.text import tags

    return read(spark, sf_dir, "documents").select("source", F.explode(tags(F.lower("text"), {"scope": ["the"], "naming": ["und"]})).alias("theme")).groupBy("source", "theme").agg(F.count("*").alias("n"))


@_add("agg_audit_run", R + "SELECT *, 1 AS exit_code FROM (SELECT 'empty' AS check_name, count(*) AS n_bad, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM r WHERE triples = 0 UNION ALL SELECT 'degenerate', count(*), CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM r WHERE triples < 10 AND consistent AND pass_rate >= 0.9"
     " UNION ALL SELECT 'negative', count(*), CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM r WHERE triples < 0 UNION ALL SELECT 'duplicate keys', count(*), CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'judge indexes', NULL, 'SKIP')")
def audit_run(spark, sf_dir):
    """Five checks of records and what they come to; the judges' indexes are not there, so that check is skipped."""
    from ..operators.audits import run_checks

    r = records(spark, sf_dir)
    return run_checks({"empty": r.filter("triples = 0"), "degenerate": r.filter("triples < 10 and consistent and pass_rate >= 0.9"), "negative": r.filter("triples < 0"), "duplicate keys": J.duplicates(r.select("id"), ["id"]), "judge indexes": None})


@_add("sink_flatten", "SELECT lang, to_json(list_sort(list(DISTINCT source)))::VARCHAR AS sources FROM documents GROUP BY lang")
def flatten(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.to_json(F.array_sort(F.collect_set("source"))).alias("sources"))


@_add("win_rank", R.rstrip() + f", g AS (SELECT model, config, avg({STRUCTURAL}) AS s FROM r GROUP BY model, config) SELECT model, config, round(s, 9) AS s, row_number() OVER (PARTITION BY config ORDER BY round(s, 4) DESC, model) AS rk FROM g")
def rank(spark, sf_dir):
    g = records(spark, sf_dir).groupBy("model", "config").agg(F.avg(structural()).alias("s"))
    return U.ranked(g, "s", ["config"], "model").select("model", "config", r9("s").alias("s"), "rk")


@_add("win_avg_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_orderkey, l_tax) - 1) / 2.0E0 AS avg_rank FROM lineitem")
def avg_rank(spark, sf_dir):
    return U.average_rank(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_tax").select("l_orderkey", "l_linenumber", "avg_rank")


@_add("win_argmax_binding", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_tax, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def argmax_binding(spark, sf_dir):
    return U.top_k(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [c("l_quantity").desc(), c("l_tax"), c("l_linenumber")], 1).select("l_orderkey", "l_linenumber")


@_add("win_first_duplicate", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents")
def first_duplicate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first")), "h").select("doc_id", "first")


@_add("win_best_worst", "SELECT p_brand, arg_max(p_partkey, p_retailprice * 100000 + p_partkey % 100000) AS best, arg_min(p_partkey, p_retailprice * 100000 + p_partkey % 100000) AS worst FROM part GROUP BY p_brand")
def best_worst(spark, sf_dir):
    """The best and the worst part of a brand; of equal ones the smallest key, which is the first row that the SQL meets on one thread. A part without a price is neither."""
    k = c("p_retailprice") * 100000 + c("p_partkey") % 100000
    by = lambda tie: F.when(k.isNotNull(), F.struct(k, tie))
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", by(-c("p_partkey"))).alias("best"), F.min_by("p_partkey", by(c("p_partkey"))).alias("worst"))


@_add("sort_table", R + "SELECT model, config, row_number() OVER (ORDER BY config, coalesce(pass, cons / 2) DESC, model) AS pos FROM (SELECT model, config, avg(CASE WHEN config <> 'src3' THEN pass_rate END) AS pass, avg(CASE WHEN consistent THEN 1.0E0 ELSE 0 END) AS cons FROM r GROUP BY model, config)")
def sort_table(spark, sf_dir):
    g = records(spark, sf_dir).groupBy("model", "config").agg(F.avg(F.when(c("config") != "src3", c("pass_rate"))).alias("pass"), F.avg(F.when(c("consistent"), 1.0).otherwise(0.0)).alias("cons"))
    w = Window.orderBy("config", F.coalesce(c("pass"), c("cons") / 2).desc(), "model")  # one row a model and configuration
    return g.select("model", "config", F.row_number().over(w).cast("long").alias("pos"))


@_add("sort_functional", R + "SELECT model, config, row_number() OVER (ORDER BY round(avg(triples), 4) DESC, min(id)) AS pos FROM r GROUP BY model, config")
def sort_functional(spark, sf_dir):
    g = records(spark, sf_dir).groupBy("model", "config").agg(F.avg("triples").alias("s"), F.min("id").alias("first"))
    return g.select("model", "config", F.row_number().over(Window.orderBy(F.round("s", 4).desc(), "first")).cast("long").alias("pos"))


@_add("sort_suspicion", R + "SELECT id, row_number() OVER (PARTITION BY config ORDER BY triples DESC, CASE WHEN triples % 3 = 0 THEN 0 ELSE 1 END, model, id) AS pos FROM r")
def sort_suspicion(spark, sf_dir):
    w = Window.partitionBy("config").orderBy(c("triples").desc(), F.when(c("triples") % 3 == 0, 0).otherwise(1), "model", "id")
    return records(spark, sf_dir).select("id", F.row_number().over(w).cast("long").alias("pos"))


@_add("topk", "SELECT o_custkey, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk(spark, sf_dir):
    return U.top_k(read(spark, sf_dir, "orders"), ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")], 3).select("o_custkey", "o_orderkey", "k")


@_add("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(25)


@_add("limit_files", "SELECT url FROM pages ORDER BY url, page_id LIMIT 10")
def limit_files(spark, sf_dir):
    return read(spark, sf_dir, "pages").orderBy("url", "page_id").limit(10).select("url")


@_add("set_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(c("o_custkey").alias("k")).union(read(spark, sf_dir, "customer").select("c_custkey")).distinct()


@_add("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def set_intersect(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(c("o_custkey").alias("k")).intersect(read(spark, sf_dir, "customer").filter("c_nationkey < 10").select("c_custkey"))


@_add("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(c("c_custkey").alias("k")).subtract(read(spark, sf_dir, "orders").select("o_custkey"))


@_add("join_authentic_guard", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def authentic_guard(spark, sf_dir):
    return J.outsiders(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@_add("join_signatures", "SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars % 2) AS q, CASE WHEN l.doc_id IS NULL THEN 'derived' ELSE 'authored' END AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def signatures(spark, sf_dir):
    base = read(spark, sf_dir, "documents").select("doc_id", (c("n_chars") % 2).alias("q"))
    return J.preferred(base, read(spark, sf_dir, "labels").select("doc_id", c("quality").cast("long").alias("q")), ["doc_id"], ["q"])


@_add("join_scenario", "SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1")
def scenario(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_regionkey = 1")
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    return o.join(n, c("c_nationkey") == c("n_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


_L = "SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0"
_RR = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0"


def _sides(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), c("o_orderkey")
    left = o.filter(k % 5 != 0).select(k.alias("k"), c("o_totalprice").alias("v"), c("o_orderstatus").alias("s"))
    v = F.when(k % 7 == 0, c("o_totalprice") + 1).when(k % 11 != 0, c("o_totalprice"))
    return left, o.filter(k % 3 != 0).select(k.alias("k"), v.alias("v"), c("o_orderstatus").alias("s"))


@_add("join_full_outer_diff", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v IS NOT DISTINCT FROM b.v AND a.s IS NOT DISTINCT FROM b.s THEN 'equal' ELSE 'conflict' END AS verdict FROM ({_L}) a FULL JOIN ({_RR}) b ON a.k = b.k")
def full_outer_diff(spark, sf_dir):
    return J.diff_rows(*_sides(spark, sf_dir), ["k"], ["v", "s"])


@_add("join_cell_diff", f"SELECT coalesce(a.k, b.k) AS k, 'v' AS cell, a.v AS was, b.v AS now FROM ({_L}) a FULL JOIN ({_RR}) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v AND NOT coalesce(abs(a.v - b.v) <= 0.5, false)")
def cell_diff(spark, sf_dir):
    return J.diff_cells(*_sides(spark, sf_dir), ["k"], ["v"], 0.5)


@_add("join_left_lookup_drift", f"SELECT count(*) AS n, count(*) FILTER (WHERE b.k IS NULL) AS missing, count(*) FILTER (WHERE b.k IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS drifted FROM ({_L}) a LEFT JOIN ({_RR}) b ON a.k = b.k")
def lookup_drift(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    x = a.join(b.select("k", c("v").alias("w"), F.lit(True).alias("hit")), "k", "left")
    return x.agg(F.count("*").alias("n"), F.count_if(c("hit").isNull()).alias("missing"), F.count_if(c("hit") & ~c("v").eqNullSafe(c("w"))).alias("drifted"))


@_add("join_pairwise_inner", R + "SELECT a.id AS a, b.id AS b, a.config FROM r a JOIN r b ON a.config = b.config AND a.triples = b.triples AND a.n_ = b.n_ WHERE a.model = 'en' AND b.model = 'fr'".replace(" AND a.n_ = b.n_", " AND a.classes = b.classes AND a.properties = b.properties"))
def pairwise_inner(spark, sf_dir):
    r = records(spark, sf_dir)
    keys = ["config", "triples", "classes", "properties"]
    return r.filter("model = 'en'").select(c("id").alias("a"), *keys).join(r.filter("model = 'fr'").select(c("id").alias("b"), *keys), keys).select("a", "b", "config")


@_add("join_carry_over", f"SELECT k, v, s, 'this_run' AS record_origin FROM ({_L}) UNION ALL SELECT k, v, s, 'carried_over' FROM ({_RR}) x WHERE k NOT IN (SELECT k FROM ({_L}))")
def carry_over(spark, sf_dir):
    return J.carry_over(*_sides(spark, sf_dir), ["k"])


@_add("join_stale_cache", f"SELECT a.k FROM ({_L}) a LEFT JOIN ({_RR}) b ON a.k = b.k WHERE b.k IS NULL OR coalesce(b.v, a.v) <> a.v")
def stale_cache(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return J.stale(a, b, ["k"], "v").select("k")


@_add("join_self_jaccard", """
WITH d AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents), e AS (SELECT doc_id, source, len(w) AS n, unnest(w) AS x FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.source <> b.source AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(i::DOUBLE / (na + nb - i), 9) AS j, i::DOUBLE / (na + nb - i) >= 0.8 AS flagged FROM p WHERE i::DOUBLE / (na + nb - i) >= 0.4""")
def self_jaccard(spark, sf_dir):
    """Pairs of documents of different sources that share at least 0.4 of their words; those of 0.8 are flagged."""
    t = read(spark, sf_dir, "documents").select("doc_id", "source", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    return J.sketch_jaccard(t, "doc_id", "source", "w", 0.4).select("a", "b", r9("j").alias("j"), (c("j") >= 0.8).alias("flagged"))


@_add("join_best_elsewhere", "SELECT s_suppkey, n_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY (s_suppkey * 7 + n_nationkey * 13) % 10 DESC, n_nationkey) AS k FROM supplier, nation WHERE s_nationkey <> n_nationkey) WHERE k = 1")
def best_elsewhere(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey")  # a fixed list of 25
    x = read(spark, sf_dir, "supplier").join(F.broadcast(n), c("s_nationkey") != c("n_nationkey")).withColumn("score", (c("s_suppkey") * 7 + c("n_nationkey") * 13) % 10)
    return J.best_elsewhere(x, "s_suppkey", "score", "n_nationkey").select("s_suppkey", "n_nationkey")


@_add("join_greedy_match", None)
def greedy_match(spark, sf_dir):
    """Greedy one-to-one matching of order lines to lines of the same order."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    x = l.alias("a").join(l.alias("b"), (c("a.l_orderkey") == c("b.l_orderkey")) & (c("a.l_linenumber") != c("b.l_linenumber")))
    x = x.select(c("a.l_orderkey"), c("a.l_linenumber").alias("left"), c("b.l_linenumber").alias("right"), (1 - F.abs(c("a.l_discount") - c("b.l_discount")) * 10).alias("score"))
    return J.greedy_match(x, "l_orderkey", "left", "right", "score", 0.5)
