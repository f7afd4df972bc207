"""Readers of trees, records and reports, over files that are written from the test tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..sources import files, rdf
from ._bind import catalogue, read
from .graph import _written

QUERIES, ORACLES, _add = catalogue()
c = F.col


def _name(prefix, key):
    return F.concat(F.lit(prefix), key.cast("string"))


def _spread(df, *keys):
    """``df`` in a fixed number of partitions by ``keys``, for a write of a file a row: costly files of few bytes, which adaptive execution would leave to one task."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _tree(spark, sf_dir):
    """A tree ``model=/config=/id=`` with a text for each item of the benchmark, and a JSON sidecar for every second one."""
    path = scratch_path(spark)
    b = read(spark, sf_dir, "benchmark")
    keys = [_name("m", c("item_id") % 3).alias("model"), _name("c", c("item_id") % 2).alias("config"), _name("s", c("item_id")).alias("id")]
    rows = _spread(b.select("item_id", *keys, "text"), "model", "config", "id")
    rows.select("model", "config", "id", "text").write.partitionBy("model", "config", "id").option("lineSep", "\u0003").text(path)
    rows.filter("item_id % 2 = 0").select("model", "config", "id", _name("r", c("item_id")).alias("response_hash"), (c("item_id") % 4 == 0).alias("truncated")).write.mode("append").partitionBy("model", "config", "id").json(path)
    return path


def _plain(k):
    return F.regexp_replace(k, "^[a-z]+=", "")


def _texts(spark, path):
    got = rdf.scan_tree(spark, path, "*.txt")
    return got.select(*[_plain(k).alias(k) for k in ("model", "config", "id")], "rel_path", F.regexp_replace("text", "\u0003$", "").alias("text"), "bytes")


_ITEM = "'m' || (item_id % 3) AS model, 'c' || (item_id % 2) AS config, 's' || item_id AS id"


@_add("scan_local_tree", f"SELECT {_ITEM}, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM benchmark")
def local_tree(spark, sf_dir):
    return _texts(spark, _tree(spark, sf_dir)).select("model", "config", "id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@_add("scan_filtered_tree", f"SELECT {_ITEM} FROM benchmark WHERE item_id % 3 IN (0, 2) AND item_id % 2 = 0")
def filtered_tree(spark, sf_dir):
    """The files of two models in one configuration."""
    return files.filtered_tree(_texts(spark, _tree(spark, sf_dir)), ["m0", "m2"], ["c0"]).select("model", "config", "id")


@_add("scan_glob3", f"SELECT {_ITEM} FROM benchmark")
def glob3(spark, sf_dir):
    """Files exactly three folders down."""
    got = spark.read.format("binaryFile").load(f"{_tree(spark, sf_dir)}/*/*/*/*.txt")
    return got.select(*rdf.path_key(c("path"))).select(*[_plain(k).alias(k) for k in ("model", "config", "id")])


@_add("scan_bytes", f"SELECT {_ITEM}, sha256(text || chr(3)) AS sha256, (strlen(text) + 1)::BIGINT AS bytes, left(sha256(text || chr(3)), 12) AS short FROM benchmark")
def scan_bytes(spark, sf_dir):
    """Size and digest of the files as they lie, the separator at their end included."""
    got = rdf.scan_tree(spark, _tree(spark, sf_dir), "*.txt")
    return got.select(*[_plain(k).alias(k) for k in ("model", "config", "id")], "sha256", "bytes", F.substring("sha256", 1, 12).alias("short"))


@_add("scan_sidecar", f"SELECT {_ITEM}, CASE WHEN item_id % 2 = 0 THEN 'r' || item_id END AS response_hash, CASE WHEN item_id % 2 = 0 THEN item_id % 4 = 0 END AS truncated FROM benchmark")
def sidecar(spark, sf_dir):
    """Every text with the metadata beside it; without a sidecar nothing is known, which is not false."""
    path = _tree(spark, sf_dir)
    side = files.json_files(spark, path, "response_hash string, truncated boolean")
    text = _texts(spark, path).withColumn("rel_path", F.regexp_replace("rel_path", "^file:/+", "/"))
    return files.with_sidecar(text, side.withColumn("rel_path", F.regexp_replace("rel_path", "^file:/+", "/"))).select("model", "config", "id", "response_hash", "truncated")


def _scenarios(spark, sf_dir):
    """Conversations as scenarios in ten files, half of them lists and half objects by id."""
    path = scratch_path(spark)
    g = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    s = g.select((c("conv_id") % 10).alias("k"), F.struct(_name("s", c("conv_id")).alias("scenario_id"), F.get("t", 0)["text"].alias("scenario_text"), F.transform("t", lambda x: x["text"]).alias("cq_list")).alias("r"))
    listed = s.filter("k % 2 = 0").groupBy("k").agg(F.to_json(F.collect_list("r")).alias("value"))
    keyed = s.filter("k % 2 = 1").groupBy("k").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r.scenario_id", "r")))).alias("value"))
    listed.unionByName(keyed).repartition("k").write.partitionBy("k").text(path)
    return files.scenarios(spark, path)


@_add("scan_scenarios", "SELECT 's' || conv_id AS scenario_id, turn - (min(turn) OVER (PARTITION BY conv_id)) AS idx, text AS cq FROM conversations")
def scenarios(spark, sf_dir):
    return files.questions(_scenarios(spark, sf_dir)).select("scenario_id", c("idx").cast("long").alias("idx"), "cq")


@_add("scan_cq_list", "SELECT turn - (SELECT min(turn) FROM conversations WHERE conv_id = 1) AS idx, text AS cq FROM conversations WHERE conv_id = 1")
def cq_list(spark, sf_dir):
    return files.questions_of(_scenarios(spark, sf_dir), "s1").select(c("idx").cast("long").alias("idx"), "cq")


def _catalogue(spark, rows):
    path = scratch_path(spark)
    record = F.struct(c("cq"), F.lit("structural").alias("cq_type"), F.create_map(F.lit("A"), F.struct(F.lit("class").alias("kind"), F.array("cq").alias("surface"))).alias("slots"))
    g = rows.groupBy("scenario").agg(F.collect_list(record).alias("r"))
    g.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("scenario", "r")))).alias("value")).coalesce(1).write.text(path)
    return path


@_add("scan_signatures", "SELECT 's' || p_size AS scenario_id, CASE WHEN p_size % 5 = 0 THEN 'override' ELSE 'catalogue' END AS origin, count(*) FILTER (WHERE p_size % 5 > 0 OR p_partkey % 2 = 0) AS n, min(CASE WHEN p_size % 5 > 0 THEN p_name WHEN p_partkey % 2 = 0 THEN 'new ' || p_name END) AS first FROM part GROUP BY p_size HAVING count(*) FILTER (WHERE p_size % 5 > 0 OR p_partkey % 2 = 0) > 0")
def signatures(spark, sf_dir):
    """A catalogue with a signature for every part by size; an override replaces every fifth size by its even parts."""
    p = read(spark, sf_dir, "part")
    base = _catalogue(spark, p.filter("p_size % 5 > 0").unionByName(p.filter("p_size % 5 = 0 and p_partkey % 2 = 0")).select(_name("s", c("p_size")).alias("scenario"), c("p_name").alias("cq")))
    new = _catalogue(spark, p.filter("p_size % 5 = 0 and p_partkey % 2 = 0").select(_name("s", c("p_size")).alias("scenario"), F.concat(F.lit("new "), "p_name").alias("cq")))
    s = files.signatures(spark, base, new)
    return s.select("scenario_id", "origin", F.size("records").cast("long").alias("n"), F.array_min(F.transform("records", lambda r: r["cq"])).alias("first"))


@_add("scan_judge_records", "SELECT event_type AS judge, 'm' || (user_id % 4) AS model, 'c' || (user_id % 2) AS config, 's' || user_id AS scenario_id, CAST(max(event_id % 10 + 1) AS INTEGER) AS s1_score FROM events GROUP BY ALL")
def judge_records(spark, sf_dir):
    """Records of several judges, each below a folder of its own."""
    path = scratch_path(spark)
    e = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max(c("event_id") % 10 + 1).cast("int").alias("s1_score"))
    e = e.select("event_type", _name("m", c("user_id") % 4).alias("model"), _name("c", c("user_id") % 2).alias("config"), _name("s", c("user_id")).alias("scenario_id"), "s1_score")
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]  # one folder a judge: a few names
    for kind in kinds:
        e.filter(c("event_type") == kind).select("model", "config", "scenario_id", "s1_score", c("model").alias("m"), c("config").alias("k")).write.partitionBy("m", "k").json(f"{path}/{kind}/single")
    return files.judge_records(spark, path).select("judge", "model", "config", "scenario_id", "s1_score")


@_add("scan_survey_pools", "SELECT CASE c_custkey % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'author' ELSE 'extra' END AS origin, c_custkey::VARCHAR AS k, c_mktsegment AS answer, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS paper FROM customer UNION ALL SELECT 'student', s_suppkey::VARCHAR, s_name, NULL FROM supplier")
def survey_pools(spark, sf_dir):
    """Students, and experts of three files with different columns."""
    x = read(spark, sf_dir, "customer").select("c_custkey", c("c_custkey").cast("string").alias("k"), c("c_mktsegment").alias("answer"), c("c_name").alias("paper"))

    def stored(df, columns):
        path = scratch_path(spark)
        files.write_csv(df, path, columns)
        return files.csv_table(spark, path, columns)

    pools = [stored(x.filter(c("c_custkey") % 3 == i), ["k", "answer", "paper"] if i == 1 else ["k", "answer"]) for i in range(3)]
    students = stored(read(spark, sf_dir, "supplier").select(c("s_suppkey").cast("string").alias("k"), c("s_name").alias("answer")), ["k", "answer"])
    return files.expert_pool(*pools).unionByName(students.withColumn("origin", F.lit("student")), allowMissingColumns=True).select("origin", "k", "answer", "paper")


@_add("scan_eval_indexes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'parsed' WHEN 2 THEN 'not parsed' ELSE 'unknown' END AS flag FROM events")
def eval_indexes(spark, sf_dir):
    """Parse flags of stored results: three outcomes, and lines that cannot be read."""
    path = scratch_path(spark)
    k = c("event_id") % 4
    line = F.concat(F.lit('{"event_id": '), c("event_id").cast("string"), F.when(k == 1, ', "parsed": true}').when(k == 2, ', "parsed": false}').when(k == 3, "}").otherwise(', "parsed": fal'))
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    got = spark.read.schema("event_id long, parsed boolean, bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    key = F.coalesce("event_id", F.regexp_extract("bad", "([0-9]+)", 1).cast("long"))
    return got.select(key.alias("event_id"), F.when(c("bad").isNotNull(), "unreadable").when(c("parsed"), "parsed").when(~c("parsed"), "not parsed").otherwise("unknown").alias("flag"))


@_add("scan_gt_graphs", "SELECT r_regionkey, CAST(sum(CASE WHEN n_nationkey % 2 = 0 THEN 6 END) AS BIGINT) AS n_triples FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def gt_graphs(spark, sf_dir):
    """The size of the reference graphs of every region, null where it has none."""
    n = read(spark, sf_dir, "nation").select(_name("g", c("n_nationkey")).alias("graph_id"), c("n_nationkey").alias("k"), c("n_regionkey").alias("r_regionkey"))
    t = rdf.triples(_written(spark, sf_dir)).groupBy("graph_id").agg(F.count("*").alias("m"))
    got = n.filter("k % 2 = 0").join(t, "graph_id").groupBy("r_regionkey").agg(F.sum("m").alias("n_triples"))
    return read(spark, sf_dir, "region").select("r_regionkey").join(got, "r_regionkey", "left")


_LEVEL = "CASE l_returnflag WHEN 'N' THEN 'Minor' WHEN 'R' THEN 'Important' ELSE 'Critical' END"


def _reports(spark, sf_dir):
    """A pitfall report in RDF/XML for every order, a pitfall for every line."""
    level = F.expr(_LEVEL)
    pitfall = F.concat(
        F.lit('"><rdf:type rdf:resource="http://oops.linkeddata.es/def#pitfall"/><o:hasCode>P'), F.lpad(c("l_linenumber").cast("string"), 2, "0"),
        F.lit("</o:hasCode><o:hasImportanceLevel>"), level, F.lit("</o:hasImportanceLevel>"), F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("<o:hasNumberAffectedElements>"), c("l_quantity").cast("long").cast("string"), F.lit("</o:hasNumberAffectedElements>"))).otherwise(""),
        F.lit("<o:hasAffectedElement>e"), c("l_suppkey").cast("string"), F.lit("</o:hasAffectedElement></rdf:Description>"),
    )
    g = read(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").cast("string").alias("graph_id")).agg(F.array_join(F.transform(F.collect_list(pitfall), lambda x, i: F.concat(F.lit('<rdf:Description rdf:nodeID="b'), i.cast("string"), x)), "").alias("p"))
    head = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://oops.linkeddata.es/def#">'
    return g.select("graph_id", F.concat(F.lit(head), "p", F.lit("</rdf:RDF>")).alias("text"))


@_add("parse_oops_rdfxml", f"""WITH x AS (SELECT l_orderkey, 'P' || lpad(l_linenumber::VARCHAR, 2, '0') AS code, {_LEVEL} AS level, CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_quantity) AS BIGINT) ELSE 1 END AS affected FROM lineitem)
 SELECT l_orderkey::VARCHAR AS report, count(*) FILTER (WHERE level <> 'Minor') AS total, count(*) FILTER (WHERE level = 'Important') AS important, count(*) FILTER (WHERE level = 'Critical') AS critical, count(*) FILTER (WHERE level = 'Minor') AS minor,
 coalesce(string_agg(DISTINCT code, '|' ORDER BY code) FILTER (WHERE level <> 'Minor'), '') AS codes, CAST(coalesce(sum(affected) FILTER (WHERE level <> 'Minor'), 0) AS BIGINT) AS affected FROM x GROUP BY l_orderkey""")
def oops_rdfxml(spark, sf_dir):
    """Totals of every report: minor pitfalls are counted and left out."""
    p = materialize(files.pitfalls_of(rdf.triples(_reports(spark, sf_dir), "sniff")))  # reports are parsed once
    affected = files.pitfalls(p).groupBy("report").agg(F.sum("affected").alias("affected"))
    t = files.pitfall_totals(p).withColumn("codes", F.array_join("codes", "|"))
    return t.join(affected, "report", "left").withColumn("affected", F.coalesce("affected", F.lit(0)))


@_add("parse_oops_html", f"SELECT l_orderkey, l_linenumber, 'P' || lpad(l_linenumber::VARCHAR, 2, '0') AS code, 'Line of ' || l_returnflag AS name, {_LEVEL} AS importance FROM lineitem")
def oops_html(spark, sf_dir):
    """The results on every order's page of the web form."""
    part = F.concat(F.lit("<h3>Results for P"), F.lpad(c("l_linenumber").cast("string"), 2, "0"), F.lit(":  Line of\n "), "l_returnflag", F.lit('. <span id="x" class="badge label">\n'), F.expr(_LEVEL), F.lit("</span></h3>"))
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("<html>Evaluation results"), F.array_join(F.collect_list(part), "<br/>"), F.lit("</html>")).alias("html"))
    x = g.select("l_orderkey", F.explode(files.pitfalls_in_page(c("html"))).alias("p"))
    return x.select("l_orderkey", F.substring("p.code", 2, 9).cast("int").alias("l_linenumber"), "p.code", "p.name", "p.importance")


def _record_tree(spark, sf_dir, flat):
    """A file for each supplier below ``model/config``: records, some without a model of their own, JSON of another kind, and text that is none.

    Unless ``flat``, every tenth record stands a second time in another folder.
    """
    path = scratch_path(spark)
    k = c("s_suppkey")
    n = lambda x: x.cast("string")
    own = lambda *rest: F.concat(F.lit('{"id": "s'), n(k), *[x if not isinstance(x, str) else F.lit(x) for x in rest])
    keys = (F.lit('", "model": "m'), n(k % 3), F.lit('", "config": "c'), n(k % 2))
    text = (
        F.when(k % 7 == 5, F.concat(F.lit('{"id": "s'), n(k))).when(k % 7 == 6, own(*keys, '", "note": 1}')).when(k % 7 == 4, F.concat(F.lit("["), n(k), F.lit("]")))
        .when(k % 11 == 0, own('", "config": "c', n(k % 2), '", "oops": {"pitfalls_total": 1}}')).otherwise(own(*keys, '", "ontometrics": {"triples_count": ', n(k), "}}"))
    )
    x = read(spark, sf_dir, "supplier").select(_name("m", k % 3).alias("a"), _name("c", k % 2).alias("b"), text.alias("text"), k)
    _spread(x, "s_suppkey").select("a", "b", "text").write.partitionBy("a", "b").option("maxRecordsPerFile", 1).text(path)
    if not flat:
        again = _spread(x.filter(k % 10 == 3), "s_suppkey").select(F.lit("again").alias("a"), "b", "text")
        again.write.mode("append").partitionBy("a", "b").option("maxRecordsPerFile", 1).text(path)
    return path


_STATE = "CASE WHEN s_suppkey % 7 = 5 THEN 'corrupt' WHEN s_suppkey % 7 IN (4, 6) OR s_suppkey % 11 = 0 THEN 'foreign' ELSE 'record' END"


@_add("scan_json_records", f"""WITH f AS (SELECT {_STATE} AS state, s_suppkey AS k FROM supplier UNION ALL SELECT {_STATE}, s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)
 SELECT state, CASE WHEN state = 'record' THEN 's' || k END AS id, count(*) AS files, CASE WHEN state = 'record' THEN max(k) ELSE 0 END AS triples, state = 'record' AND count(*) > 1 AS twice FROM f GROUP BY state, CASE WHEN state = 'record' THEN 's' || k END""")
def json_records(spark, sf_dir):
    """How many files hold each record, which stand twice, and how many hold something else or nothing that can be read."""
    r = files.record_files(spark, _record_tree(spark, sf_dir, False), "*.txt")
    r = r.withColumns({"id": F.when(c("state") == "record", c("id")), "triples": F.when(c("state") == "record", c("record.ontometrics.triples_count")).otherwise(0).cast("long")})
    r = materialize(r.drop("text", "record"))  # the files are opened once
    twice = files.duplicate_records(r).select("id", F.lit(True).alias("t"))
    out = r.groupBy("state", "id").agg(F.count("*").alias("files"), F.max("triples").alias("triples")).join(twice, "id", "left")
    return out.select("state", "id", "files", "triples", F.coalesce("t", F.lit(False)).alias("twice"))


@_add("scan_existing", """SELECT CASE WHEN s_suppkey % 7 IN (4, 5) THEN 'unreadable' ELSE 's' || s_suppkey END AS id, CASE WHEN s_suppkey % 7 IN (4, 5) THEN NULL WHEN s_suppkey % 7 <> 6 AND s_suppkey % 11 = 0 THEN 'a=m' || (s_suppkey % 3) ELSE 'm' || (s_suppkey % 3) END AS model,
 CASE WHEN s_suppkey % 7 IN (4, 5) THEN NULL ELSE 'carried_over' END AS record_origin, count(*) AS n FROM supplier WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey % 3 = 1 AND s_suppkey % 7 NOT IN (4, 5) AND (s_suppkey % 7 = 6 OR s_suppkey % 11 <> 0)) GROUP BY ALL""")
def existing(spark, sf_dir):
    """What a run before left, without one model and configuration that are scored anew; unreadable files are counted and not lost."""
    k = c("s_suppkey")
    done = read(spark, sf_dir, "supplier").filter((k % 3 == 1) & (k % 2 == 0)).select(_name("m", k % 3).alias("model"), _name("c", k % 2).alias("config"), _name("s", k).alias("id"))
    x = files.existing_records(spark, _record_tree(spark, sf_dir, True), done, "*.txt")
    bad = c("unreadable")
    return x.groupBy(F.when(bad, "unreadable").otherwise(c("id")).alias("id"), F.when(~bad, c("model")).alias("model"), "record_origin").agg(F.count("*").alias("n"))


_STUB = "@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . "


def _artefacts(spark, sf_dir):
    """What should be there and the files that are: for each supplier a graph of a class tree, one that cannot be true, directives only, prose, or no file."""
    path, k = scratch_path(spark), c("s_suppkey")
    n = lambda x: F.concat(F.lit(":S"), x.cast("string"))
    tree = F.concat(F.lit(_STUB), n(k), F.lit(" a owl:Class ; rdfs:subClassOf "), n(k + 1), F.lit(" . "), n(k + 1), F.lit(" a owl:Class ; rdfs:subClassOf "), n(k + 2), F.lit(" . "), n(k + 2), F.lit(" a owl:Class ; rdfs:label 'top' . :p a owl:ObjectProperty ; rdfs:domain "), n(k), F.lit(" ; rdfs:range "), n(k + 2), F.lit(" . :q rdfs:subPropertyOf :p ."))
    clash = F.concat(tree, F.lit(" "), n(k), F.lit(" owl:disjointWith "), n(k + 2), F.lit(" . :x a "), n(k), F.lit(" ."))
    text = F.element_at(F.array(tree, clash, F.lit(_STUB + "# nothing more"), F.lit("I am sorry, but there is no graph in this text.")), (k % 5 + 1).cast("int"))
    x = read(spark, sf_dir, "supplier").select(_name("m", k % 3).alias("model"), _name("c", k % 2).alias("config"), _name("s", k).alias("id"), k, k.alias("k"))
    _spread(x.filter(k % 5 < 4), "id").select("model", "config", "id", text.alias("text")).write.partitionBy("model", "config", "id").option("lineSep", "\u0003").text(path)
    return x.select("model", "config", "id"), _texts(spark, path)


_ART = "'m' || (s_suppkey % 3) || '/c' || (s_suppkey % 2) || '/s' || s_suppkey AS graph_id"


@_add("udf_artifact_eval", f"""SELECT {_ART}, ['parsed', 'parsed', 'empty', 'unparseable', 'missing'][s_suppkey % 5 + 1] AS status, ['', '', '', 'cannot be read', 'not found'][s_suppkey % 5 + 1] AS note, [10, 12, 0, 0, 0][s_suppkey % 5 + 1]::BIGINT AS triples,
 CASE s_suppkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE 'none' END AS consistent, [false, false, true, true, true][s_suppkey % 5 + 1] AS vacuous, ['ok', 'ok', 'empty', 'unparseable', 'unparseable'][s_suppkey % 5 + 1] AS gate,
 CASE WHEN s_suppkey % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, 'oops' AS failed FROM supplier""")
def artifact_eval(spark, sf_dir):
    """Records of all artefacts that should be there, read from files; the pitfall section is given a table that it cannot use, and fails alone."""
    from ..operators.evaluation import evaluate, from_files

    texts = materialize(_spread(from_files(*_artefacts(spark, sf_dir)), "graph_id"))  # the files are opened once, and many tasks parse
    e = evaluate(texts, pitfalls=read(spark, sf_dir, "region"))
    verdict = F.coalesce(c("consistent").cast("string"), F.lit("none")).alias("consistent")
    return e.select("graph_id", "status", F.coalesce("note", F.lit("")).alias("note"), c("triples").cast("long").alias("triples"), verdict, "vacuous", "gate", "score", F.array_join(F.map_keys("errors"), ",").alias("failed"))


@_add("g_evaluate_path", f"""SELECT {_ART}, ['parsed', 'parsed', 'empty', 'unparseable', 'missing'][s_suppkey % 5 + 1] AS status, [10, 12, 0, 0, 0][s_suppkey % 5 + 1]::BIGINT AS n_triples, s_suppkey % 5 < 2 AS measured FROM supplier""")
def evaluate_path(spark, sf_dir):
    """The structural score of every file that should be there; one that is missing or cannot be read has its status and no score."""
    from ..operators import structure
    from ..operators.evaluation import from_files

    texts = materialize(_spread(from_files(*_artefacts(spark, sf_dir)), "graph_id"))  # the files are opened once, and many tasks parse
    status = rdf.parse_status(texts, "sniff", 0)
    scores = structure.reference_scores(status, structure.Analysis(rdf.triples(texts, "sniff")).scores())
    absent = texts.select("graph_id", c("text").isNull().alias("absent"))
    x = absent.join(status, "graph_id").join(scores, "graph_id")
    return x.select("graph_id", F.when(c("absent"), "missing").otherwise(c("status")).alias("status"), "n_triples", (F.coalesce("score", F.lit(0.0)) > 0).alias("measured"))
