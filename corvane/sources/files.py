"""Readers and writers of records, tables and sidecar files. Schemas are explicit; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = "model string, backend string, config string, scenario_id string, timestamp string, temperature double, max_new_tokens int, finish_reason string, truncated boolean, truncation_signals array<string>, response_hash string, ontology_hash string, quantize string, thinking_budget string"
RECORD = "id string, model string, config string, error string, ontometrics struct<triples_count:int,classes_count:int,error:string>, reasoner struct<consistent:boolean,vacuous:boolean,consistency_credit:double,error:string>, oops struct<status_code:int,pitfalls_total:int,important_count:int,critical_count:int,skipped:boolean,error:string>, cq_verification struct<pass_rate:double,skipped:boolean,error:string>"
SCENARIO = "scenario_id string, scenario_text string, cq_list array<string>, ontology string"
JUDGE = "model string, config string, scenario_id string, judge_model string, timestamp string, candidate_sha256 string, " + ", ".join(f"s{i}_score int" for i in range(1, 6))
# Order in which a reference file is preferred.
REFERENCE_ORDER = [".ttl", ".owl", ".rdf", ".xml", ".n3"]


def json_records(spark: SparkSession, root: str, schema: str = RECORD, corrupt: str = "_corrupt") -> DataFrame:
    """One record a file below ``root``; unreadable files keep their text in ``corrupt``."""
    full = T.StructType.fromDDL(schema).add(corrupt, "string")
    return spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)


#: Sections of which an evaluation record has one at least.
SECTIONS = ["ontometrics", "reasoner", "cq_verification", "oops", "error"]


def record_files(spark: SparkSession, root: str, name: str = "*.json", schema: str = RECORD, recursive: bool = True) -> DataFrame:
    """(rel_path, text, state, model, config, id, record) of every file ``name`` below ``root``, each read as one JSON value.

    ``state``: ``corrupt`` (no JSON), ``foreign`` (JSON of another kind: no object, a key that is no string, or no section of an
    evaluation), or ``record``. Nothing is dropped; a foreign or corrupt file keeps its text, and its keys as far as they are strings.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", name)
    files = (files.option("recursiveFileLookup", True).text(root) if recursive else files.text(root)).select(F.col("_metadata.file_path").alias("rel_path"), F.col("value").alias("text"))
    v = F.try_parse_json("text")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    keys = {k: F.when(kind(f"$.{k}") == "STRING", F.try_variant_get(v, f"$.{k}", "string")).alias(k) for k in ("model", "config", "id")}
    has = F.arrays_overlap(F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")), F.array(*map(F.lit, SECTIONS)))
    x = files.withColumns({"__v": v, "__has": has}).select("rel_path", "text", F.col("__v").isNull().alias("__bad"), F.col("__has"), *keys.values(), F.from_json("text", schema).alias("record"))
    whole = F.col("model").isNotNull() & F.col("config").isNotNull() & F.col("id").isNotNull() & F.col("__has")
    return x.select("rel_path", "text", F.when(F.col("__bad"), "corrupt").when(whole, "record").otherwise("foreign").alias("state"), "model", "config", "id", "record")


def duplicate_records(records: DataFrame, keys: tuple[str, ...] = ("model", "config", "id")) -> DataFrame:
    """(keys, n, files): keys that several record files share, with the first ten of those files."""
    return records.filter("state = 'record'").groupBy(*keys).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("rel_path")), 1, 10).alias("files")).filter("n > 1")


def loaded_records(records: DataFrame, keys: tuple[str, ...] = ("model", "config", "id")) -> DataFrame:
    """The records of ``record_files``; an error names a key that stands twice, and both files."""
    twice = duplicate_records(records, keys).orderBy(*keys).first()
    if twice:
        raise ValueError(f"duplicate evaluation record for {tuple(twice[k] for k in keys)}: {' and '.join(twice.files[:2])}")
    return records.filter("state = 'record'")


def existing_records(spark: SparkSession, root: str, done: DataFrame | None = None, name: str = "*.json") -> DataFrame:
    """(rel_path, model, config, id, record_origin, unreadable, text) of what a run before left in ``root/model/config/``, without the keys in ``done``.

    A key that a record lacks is taken from its path. A file that is no JSON object is not left out: it has ``unreadable`` set and no
    origin, so that a manifest can name it. The manifest itself is no record.
    """
    x = record_files(spark, f"{root}/*/*/", name, recursive=False)
    parts = F.split("rel_path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    bad = F.coalesce(~F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(True))
    x = x.filter(F.element_at(parts, -1) != "run_manifest.json").withColumn("unreadable", bad)
    x = x.withColumns({"model": F.coalesce("model", F.element_at(parts, -3)), "config": F.coalesce("config", F.element_at(parts, -2)), "id": F.coalesce("id", stem)})
    x = x.select("rel_path", "model", "config", "id", F.when(~F.col("unreadable"), "carried_over").alias("record_origin"), "unreadable", "text")
    if done is None:
        return x
    keys = ["model", "config", "id"]
    x = x.join(done.select(*keys).distinct().withColumn("__done", F.lit(True)), keys, "left")  # one pass over the files
    return x.filter(F.col("unreadable") | F.col("__done").isNull()).select("rel_path", *keys, "record_origin", "unreadable", "text")


def real_records(df: DataFrame, keys: tuple[str, ...] = ("model", "config", "id")) -> DataFrame:
    """Records that carry their whole key."""
    out = df
    for k in keys:
        out = out.filter(F.col(k).isNotNull())
    return out


def unique_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` if no key stands twice, else an error that names one; the count is an aggregate of its own."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"duplicate record {twice.asDict()}")
    return df


def csv_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string columns by name; a byte-order mark is taken off the first name, what is missing becomes ''."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def pooled(pools: dict[str, DataFrame]) -> DataFrame:
    """Survey pools under one another, with their name; columns that a pool lacks are null."""
    out = None
    for name, df in pools.items():
        df = df.withColumn("pool", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_sidecar(files: DataFrame, sidecars: DataFrame, path: str = "rel_path") -> DataFrame:
    """Files with the sidecar of their own directory, or nulls."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    side = sidecars.withColumn("__dir", folder(F.col(path))).drop(path)
    return files.withColumn("__dir", folder(F.col(path))).join(side, "__dir", "left").drop("__dir")


def json_files(spark: SparkSession, root: str, schema: str, name: str = "*.json") -> DataFrame:
    """(rel_path, columns of ``schema``) of every JSON file ``name`` below ``root``, one object a file; unreadable ones are all null."""
    got = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return got.select(F.col("_metadata.file_path").alias("rel_path"), *got.columns)


def filtered_tree(files: DataFrame, models: list[str] | None = None, configs: list[str] | None = None, scenarios: list[str] | None = None) -> DataFrame:
    """Files of a scanned tree whose model, config and id are in the lists; None leaves all."""
    for key, wanted in (("model", models), ("config", configs), ("id", scenarios)):
        files = files if wanted is None else files.filter(F.col(key).isin(wanted))
    return files


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios from JSON files that hold a list of records, or an object of records by id."""
    text = spark.read.option("wholetext", True).text(path)
    row = f"struct<{', '.join(c.replace(' ', ':', 1) for c in SCENARIO.split(', '))}>"
    listed = F.from_json("value", f"array<{row}>", {"mode": "PERMISSIVE"})
    keyed = F.map_values(F.from_json("value", f"map<string,{row}>"))
    rows = F.when(F.trim("value").startswith("["), listed).otherwise(keyed)
    return text.select(F.explode(rows).alias("r")).select("r.*").filter("scenario_id is not null")


SIGNATURE = "struct<cq:string,cq_type:string,slots:map<string,struct<kind:string,surface:array<string>,anchors:array<string>>>,relations:array<struct<`from`:string,`to`:string,surface:array<string>>>>"


def signatures(spark: SparkSession, path: str, override: str | None = None) -> DataFrame:
    """(scenario_id, records, origin) of a catalogue of signatures, a JSON object by scenario; scenarios of ``override`` replace theirs whole.

    A file that is no object of lists, or a signature without a question, is an error.
    """

    def catalogue(p: str, origin: str) -> DataFrame:
        text = spark.read.option("wholetext", True).text(p).withColumn("m", F.from_json("value", f"map<string,array<{SIGNATURE}>>", {"mode": "PERMISSIVE"}))
        if text.filter("m is null or not startswith(trim(value), '{')").limit(1).count():
            raise ValueError(f"{p}: signatures must be an object by scenario")
        rows = text.select(F.explode("m").alias("scenario_id", "records")).withColumn("origin", F.lit(origin))
        wrong = rows.filter(F.col("records").isNull() | F.exists("records", lambda r: r.isNull() | r["cq"].isNull())).select("scenario_id").first()
        if wrong:
            raise ValueError(f"{p}: a signature of {wrong[0]!r} has no question")
        return rows

    base = catalogue(path, "catalogue")
    if override is None:
        return base
    new = catalogue(override, "override")
    return new.unionByName(base.join(new.select("scenario_id"), "scenario_id", "left_anti"))


def catalogue_digest(catalogue: DataFrame) -> DataFrame:
    """One row (digest): 16 hexadecimal digits of the whole catalogue, whatever the order of its rows."""
    each = catalogue.select(F.sha2(F.to_json(F.struct("scenario_id", "records")), 256).alias("h"))
    return each.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256), 1, 16).alias("digest"))


def judge_records(spark: SparkSession, root: str, schema: str = JUDGE) -> DataFrame:
    """Judges' records of files ``<judge>/single/<model>/<config>/*.json`` below ``root``; the judge is the name of its folder."""
    got = spark.read.schema(schema).json(f"{root}/*/single/*/*/*.json")
    return got.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/single/[^/]+/[^/]+/[^/]+$", 1).alias("judge"), *got.columns)


def expert_pool(external: DataFrame, authors: DataFrame, extra: DataFrame) -> DataFrame:
    """The expert survey: external experts, paper authors and the authors' extra answers, with their ``origin``."""
    return pooled({"external": external, "author": authors, "extra": extra}).withColumnRenamed("pool", "origin")


def reference_rank(path: Column) -> Column:
    """The place of a file's suffix in the order of preference, null if it has none."""
    out = F.lit(None).cast("int")
    for i, suffix in reversed(list(enumerate(REFERENCE_ORDER))):
        out = F.when(F.lower(path).endswith(suffix), i).otherwise(out)
    return out


def ground_truth(files: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path): the preferred file of each scenario."""
    return files.withColumn("__r", reference_rank(F.col(path))).filter("__r is not null").groupBy(key).agg(F.min_by(path, F.struct("__r", path)).alias(path))


def questions(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, idx, cq) of all questions, in order."""
    return scenarios.select("scenario_id", F.posexplode("cq_list").alias("idx", "cq"))


def questions_of(scenarios: DataFrame, scenario: str) -> DataFrame:
    """The questions of one scenario; an unknown one is an error."""
    one = scenarios.filter(F.col("scenario_id") == scenario)
    if one.isEmpty():
        raise ValueError(f"unknown scenario {scenario!r}")
    return questions(one)


def judge_scores(raw: Column, names: list[str]) -> Column:
    """Scores from a judge's reply: as JSON; without its fence; from the first to the last brace; with what a cut left open closed. Else nulls."""
    bare = F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*|\s*```$", "")
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    opened = F.regexp_extract(raw, r"(?s)\{.*", 0)
    schema = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    tries = [raw, bare, body, *[F.concat(opened, F.lit(end)) for end in ('"}', "}", '"]}', "]}", "null}")]]
    usable = [F.when(F.get_json_object(t, "$").isNotNull(), t) for t in tries]
    return F.from_json(F.coalesce(*usable, F.lit("{}")), schema)


#: Namespace and levels of pitfall reports.
PITFALL, LEVELS = "http://oops.linkeddata.es/def#", ["Important", "Critical"]


def pitfalls_of(triples: DataFrame) -> DataFrame:
    """(report, node, code, importance, affected, elements) of every pitfall with a code in reports read as triples (graph_id, s, p, o)."""
    kind, names = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", ["hasCode", "hasImportanceLevel", "hasNumberAffectedElements", "hasAffectedElement"]
    told = triples.filter(F.col("p").isin(kind, *[PITFALL + k for k in names]) & F.col("graph_id").isNotNull())  # one pass: the triples may have to be parsed
    of = lambda k: F.min(F.when(F.col("p") == PITFALL + k, F.trim("o")))
    elements = F.array_sort(F.collect_set(F.when(F.col("p") == PITFALL + "hasAffectedElement", F.col("o"))))
    named = F.bool_or((F.col("p") == kind) & (F.col("o") == PITFALL + "pitfall"))
    rows = told.groupBy("graph_id", "s").agg(named.alias("named"), of("hasCode").alias("code"), of("hasImportanceLevel").alias("importance"), of("hasNumberAffectedElements").try_cast("long").alias("reported"), elements.alias("elements")).filter("named")
    return rows.filter("code is not null").select(F.col("graph_id").alias("report"), F.col("s").alias("node"), "code", "importance", F.coalesce("reported", F.size("elements").cast("long")).alias("affected"), "elements")


def pitfalls_in_page(html: Column) -> Column:
    """array<struct<code, name, importance>> of the results in a page of the web form."""
    pattern = r"(?s)Results for (P[0-9]+):\s*(.*?)\s*<span[^>]*class=\"badge[^\"]*\"[^>]*>\s*(Critical|Important|Minor)\s*</span>"
    got = [F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[g.alias(k) for g, k in zip(got, "abc", strict=True)]), lambda x: F.struct(x["a"].alias("code"), F.regexp_replace(F.regexp_replace(x["b"], r"\s+", " "), r"\.+$", "").alias("name"), x["c"].alias("importance")))


def pitfalls(reports: DataFrame, most: int = 50) -> DataFrame:
    """(report, code, importance, n, affected, sample) from (report, code, importance, affected, elements); minor ones are left out, samples capped."""
    kept = reports.filter(F.col("importance").isNull() | F.col("importance").isin(LEVELS))
    return kept.groupBy("report", "code", "importance").agg(F.count("*").alias("n"), F.sum("affected").alias("affected"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("elements")))), 1, most).alias("sample"))


def pitfall_totals(reports: DataFrame) -> DataFrame:
    """(report, total, important, critical, minor, codes) from (report, code, importance): minor ones are counted apart."""
    level, minor = F.col("importance"), F.col("importance").isNotNull() & ~F.col("importance").isin(LEVELS)
    return reports.groupBy("report").agg(
        F.count_if(~minor).alias("total"), F.count_if(level == "Important").alias("important"), F.count_if(level == "Critical").alias("critical"), F.count_if(minor).alias("minor"),
        F.array_sort(F.collect_set(F.when(~minor, F.col("code")))).alias("codes"),
    )


def refuse_evidence(path: str, kept: list[str]) -> None:
    """Raise if a sink would write into a folder of evidence."""
    norm = lambda p: p.rstrip("/") + "/"
    for k in kept:
        if norm(path).startswith(norm(k)):
            raise ValueError(f"{path} is inside the evidence folder {k}")


def write_records(df: DataFrame, path: str, by: tuple[str, ...] = ("model", "config"), kept: list[str] | None = None) -> None:
    """Records as JSON in folders by key; an existing target is an error."""
    refuse_evidence(path, kept or [])
    df.write.mode("errorifexists").partitionBy(*by).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], null: str = "", kept: list[str] | None = None) -> None:
    """Fixed columns in order, further ones left out, those missing blank; ``null`` is the text of a missing cell."""
    refuse_evidence(path, kept or [])
    out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    out.write.mode("errorifexists").option("header", True).option("nullValue", null).csv(path)


def rendered_table(df: DataFrame, style: str = "markdown", most: int = 1000) -> str:
    """A small result as a Markdown or LaTeX table; a report of over ``most`` rows is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    show = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    if style == "latex":
        escape = lambda x: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(ch, ch) for ch in x)
        lines = [" & ".join(escape(c) for c in df.columns) + r" \\ \midrule"] + [" & ".join(escape(show(v)) for v in r) + r" \\" for r in rows]
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *lines, r"\end{tabular}"])
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)] + ["| " + " | ".join(show(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(lines)
