"""Text scalars over the whole texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X

QUERIES, ORACLES = {}, {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name, sql):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def _sorted(c):
    return F.array_join(F.array_sort(c), " ")


_CAMEL = r"regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_STRIP = "CASE " + " ".join(f"WHEN length({{0}}) > {len(s) + 2} AND ends_with({{0}}, '{s}') THEN left({{0}}, length({{0}}) - {k})" for s, k in X.SUFFIXES) + " ELSE {0} END"
_STEM = (
    "CASE WHEN length({0}) > 5 AND ends_with({0}, 'ies') THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) > 5 AND regexp_matches({0}, '(ches|shes|sses|xes)$') THEN left({0}, length({0}) - 2) "
    "WHEN length({0}) >= 5 AND ends_with({0}, 'ing') THEN left({0}, length({0}) - 3) WHEN length({0}) >= 5 AND ends_with({0}, 'ed') AND NOT ends_with({0}, 'eed') THEN left({0}, length({0}) - 2) "
    "WHEN length({0}) >= 4 AND ends_with({0}, 's') AND NOT regexp_matches({0}, '(ss|us|is|as)$') THEN left({0}, length({0}) - 1) ELSE {0} END"
)


@_add("str_sev_tokens", f"""
WITH t AS (SELECT p_partkey, list_filter(string_split(lower(regexp_replace({_CAMEL.format("p_name || ' hasPartOf ' || p_type")}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {_LIST(X.TOKEN_STOP)}) AS k FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(k, list_transform(k, lambda w: {_STRIP.format("w")})))), ' ') AS tokens FROM t""")
def sev_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", _sorted(X.identifier_tokens(F.concat("p_name", F.lit(" hasPartOf "), "p_type"))).alias("tokens"))


@_add("str_suffix_strip", f"SELECT p_partkey, {_STRIP.format('lower(p_name)')} AS stripped FROM part")
def suffix_strip(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", X.suffix_strip(F.lower("p_name")).alias("stripped"))


@_add("str_sev_flat", "SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS flat FROM documents")
def sev_flat(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.flat(F.col("text")), 256).alias("flat"))


@_add("str_local_name", r"""
SELECT page_id, CASE WHEN contains(url, '#') THEN string_split(url, '#')[-1] ELSE string_split(url, '/')[-1] END AS local_name,
       CASE WHEN contains(url, '#') THEN string_split(url, '#')[-1] ELSE string_split(regexp_replace(url, '/+$', ''), '/')[-1] END AS local_name_legacy FROM pages""")
def local_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.local_name(F.col("url")).alias("local_name"), X.local_name(F.col("url"), True).alias("local_name_legacy"))


@_add("str_split_camel", f"SELECT p_partkey, trim(lower({_CAMEL.format("regexp_replace(replace(p_name, ' ', 'X'), '[_-]+', ' ', 'g')")})) AS words FROM part")
def split_camel(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", X.name_words(F.concat(F.lit("http://example.org/m#"), F.replace("p_name", F.lit(" "), F.lit("X")))).alias("words"))


@_add("str_stem", f"SELECT w, count(*) AS n, any_value({_STEM.format('w')}) AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w")
def stem(spark, sf_dir):
    w = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n")).select("w", "n", X.stem(F.col("w")).alias("stem"))


@_add("str_content_tokens", f"""
WITH a AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), lambda w: length(w) >= 3 AND w NOT IN {_LIST(X.PROSE_STOP)}) AS p FROM documents)
SELECT doc_id, CAST(len(list_distinct(p)) AS BIGINT) AS n_plain, sha256(array_to_string(list_sort(list_distinct(p)), ' ')) AS plain,
       CAST(len(list_distinct(list_filter(list_transform(p, lambda w: {_STEM.format("w")}), lambda w: length(w) >= 3 AND w NOT IN {_LIST(X.PROSE_STOP)}))) AS BIGINT) AS n_stems FROM a""")
def content_tokens(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", X.prose_tokens(F.col("text")).alias("p"), X.stemmed_tokens(F.lower("text")).alias("s"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_plain"), F.sha2(_sorted(F.col("p")), 256).alias("plain"), F.size("s").cast("long").alias("n_stems"))


@_add("str_norm_cq", r"""
WITH s AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS q FROM conversations)
SELECT conv_id, turn, regexp_replace(q, '[ ?.!]+$', '') AS guard, regexp_replace(trim(replace(q, '`', ''), ' '), '[ ?.!,;:]+$', '') AS audit,
       trim(regexp_replace(lower(text), '[^a-zA-Z0-9_]+', ' ', 'g'), ' ') AS key FROM s""")
def norm_cq(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", *[X.norm_question(t, k).alias(k) for k in ("guard", "audit", "key")])


@_add("str_jaccard", """
WITH a AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS x FROM benchmark), b AS (SELECT item_id + 1 AS item_id, x AS y FROM a)
SELECT item_id, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 9) AS j, 1.0::DOUBLE AS both_empty_first, 0.0::DOUBLE AS both_empty_second FROM a JOIN b USING (item_id)""")
def jaccard(spark, sf_dir):
    a = _table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("x"))
    b = a.select((F.col("item_id") + 1).alias("item_id"), F.col("x").alias("y"))
    none = F.array().cast("array<string>")
    return a.join(b, "item_id").select("item_id", F.round(X.jaccard(F.col("x"), F.col("y"), 1.0), 9).alias("j"), X.jaccard(none, none, 1.0).alias("both_empty_first"), X.jaccard(none, none, 0.0).alias("both_empty_second"))


@_add("str_bigrams", """
WITH a AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
b AS (SELECT item_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM a),
c AS (SELECT item_id, v, min(i) AS i FROM (SELECT item_id, unnest(p) AS v, unnest(range(1, len(p) + 1)) AS i FROM b) GROUP BY item_id, v),
d AS (SELECT item_id, v, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM c)
SELECT item_id, string_agg(v, '|' ORDER BY k) AS phrases FROM d WHERE k <= 12 GROUP BY item_id""")
def bigrams(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.bigram_phrases(F.split(F.lower("text"), " ")), "|").alias("phrases"))


_THEMES = {"naming": [r"\bthe\s+\w+ing\b", r"\bnam(e|ing)\b"], "scope": [r"\bspecific\b", r"\bof\s+the\b"], "documentation": [r"\bno\s+label", r" und "], "redundancy": [r" de [a-z]+ de "], "reuse": [r"\balign", r"\bmatch(es|ing)?\b"], "size": [r"\btoo\s+\w+", r"\b(large|small)\b"], "language": [r"\benglish\b"], "logic": [r"\binconsisten", r"\bdisjoint"]}


@_add("str_lexicon_tag", """
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '\\bthe\\s+\\w+ing\\b|\\bnam(e|ing)\\b') THEN 'naming' END, CASE WHEN regexp_matches(lower(text), '\\bspecific\\b|\\bof\\s+the\\b') THEN 'scope' END,
    CASE WHEN regexp_matches(lower(text), '\\bno\\s+label| und ') THEN 'documentation' END, CASE WHEN regexp_matches(lower(text), ' de [a-z]+ de ') THEN 'redundancy' END,
    CASE WHEN regexp_matches(lower(text), '\\balign|\\bmatch(es|ing)?\\b') THEN 'reuse' END, CASE WHEN regexp_matches(lower(text), '\\btoo\\s+\\w+|\\b(large|small)\\b') THEN 'size' END, CASE WHEN regexp_matches(lower(text), '\\benglish\\b') THEN 'language' END, CASE WHEN regexp_matches(lower(text), '\\binconsisten|\\bdisjoint') THEN 'logic' END], lambda x: x IS NOT NULL), ' ') AS themes FROM documents""")
def lexicon_tag(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.tags(F.lower("text"), _THEMES), " ").alias("themes"))


@_add("str_boilerplate", "SELECT conv_id, turn, CASE " + " ".join("WHEN regexp_matches(text, '(?i){}') THEN '{}'".format(p, r) for p, r in X.BOILERPLATE) + " END AS reason FROM conversations")
def boilerplate(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_reason(F.col("text"), X.BOILERPLATE).alias("reason"))


@_add("str_format_cqs", r"SELECT conv_id, string_agg(CAST(k AS VARCHAR) || '. ' || text, chr(10) ORDER BY k) AS listed FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def format_cqs(spark, sf_dir):
    g = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", X.numbered(F.transform("t", lambda x: x["text"])).alias("listed"))


@_add("str_render_prompt", r"SELECT item_id, 'Scenario: ' || trim(text) || chr(10) || 'Questions: - q' || CAST(item_id AS VARCHAR) AS prompt FROM benchmark")
def render_prompt(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", X.rendered(F.lit("Scenario: {scenario}\nQuestions: {cqs}"), {"scenario": F.trim("text"), "cqs": F.concat(F.lit("- q"), F.col("item_id").cast("string"))}).alias("prompt"))


@_add("str_parse_url", "SELECT page_id, string_split(url, '/')[4] AS first, string_split(url, '/')[5] AS second FROM pages")
def parse_url(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", X.path_parts_after(F.concat(F.lit("outputs/"), F.regexp_replace("url", "^[^/]*//[^/]*/", "")), "outputs", 2).alias("p"))
    return p.select("page_id", F.get("p", 0).alias("first"), F.get("p", 1).alias("second"))


#: Answers as they are found, and the midpoint that each stands for.
_ANSWERS = [("0%", 0.0), ("1–25%", 13.0), ("26-50%", 38.0), ("51?75%", 63.0), ("７６－１００％", 88.0), ("n/a", None), ("①-²⁵%", 13.0), ("１－２５﹪", 13.0), (" 51—75%\u00a0", 63.0), ("２⑥-５０%", 38.0), ("76\u2212100%", 88.0), ("𝟐𝟔‒𝟓𝟎%", 38.0), ("", None)]


@_add("str_time_saved", f"""WITH a AS (SELECT event_id, [{', '.join("'" + a + "'" for a, _ in _ANSWERS)}][event_id % {len(_ANSWERS)} + 1] AS raw FROM events)
SELECT event_id, raw, CASE event_id % {len(_ANSWERS)} {' '.join(f'WHEN {i} THEN {m}' for i, (_, m) in enumerate(_ANSWERS) if m is not None)} END::DOUBLE AS midpoint FROM a""")
def time_saved(spark, sf_dir):
    """The midpoint of every answer, in whatever characters it was written."""
    raw = F.get(F.array(*[F.lit(x) for x, _ in _ANSWERS]), (F.col("event_id") % len(_ANSWERS)).cast("int"))
    e = X.folded(_table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "plain")
    return e.select("event_id", "raw", X.time_saved(F.col("plain")).alias("midpoint"))


@_add("str_lead_number", r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '^\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS number FROM documents")
def lead_number(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.lead_number(F.col("text")).alias("number"))


@_add("str_parse_int", r"SELECT event_id, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN try_cast(trim(v) AS BIGINT) END AS parsed FROM (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events)")
def parse_int(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", X.strict_int(F.get_json_object("props", "$.k")).alias("parsed"))


@_add("str_safe_int", "SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE greatest(1, least(10, CAST(trunc(value) AS INTEGER))) END AS BIGINT) AS score FROM events")
def safe_int(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", X.clamped_score(F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("value").cast("string"))).cast("long").alias("score"))


@_add("str_path_sanitise", "SELECT page_id, translate(url, '/:', '__') AS safe FROM pages")
def path_sanitise(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.file_safe(F.col("url")).alias("safe"))


@_add("str_banner", r"SELECT item_id, sha256('# truncated' || chr(10) || '# see metadata' || chr(10) || text) AS with_banner, text AS without_banner FROM benchmark")
def banner(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select("item_id", X.with_banner(F.col("text"), ["truncated", "see metadata"]).alias("b"))
    return b.select("item_id", F.sha2("b", 256).alias("with_banner"), X.without_banner(F.col("b")).alias("without_banner"))


_REPLY = "concat('reply ```turtle\n@prefix a: <x> .\n', CASE WHEN turn % 3 = 0 THEN '' ELSE 'a:b a owl:Class .\n' END, replace(text, '`', ' '), CASE WHEN turn % 2 = 0 THEN '\n```' ELSE '' END)"


def _replies(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_REPLY.replace("\n", "\\n")).alias("r"), F.when(F.col("turn") % 4 == 0, "MAX_TOKENS").otherwise("stop").alias("finish"))


_REPLY_SQL = _REPLY.replace("\n", "' || chr(10) || '")


@_add("str_fences", f"SELECT conv_id, turn, 1::BIGINT AS n, 'turtle' AS info, turn % 2 = 0 AS closed, sha256(regexp_extract({_REPLY_SQL}, '(?s)^reply ```turtle.(.*?)(```)?$', 1)) AS body FROM conversations")
def fences(spark, sf_dir):
    r = _replies(spark, sf_dir).select("conv_id", "turn", X.fences(F.col("r")).alias("f"))
    first = F.get("f", 0)
    return r.select("conv_id", "turn", F.size("f").cast("long").alias("n"), first["info"].alias("info"), first["closed"].alias("closed"), F.sha2(first["body"], 256).alias("body"))


@_add("str_truncation_signals", """
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND turn % 2 <> 0 THEN 'finish_reason open_fence' WHEN turn % 4 = 0 THEN 'finish_reason' WHEN turn % 2 <> 0 THEN 'open_fence' ELSE '' END AS signals,
       CASE WHEN turn % 5 = 0 THEN NULL ELSE (turn % 4 = 0 OR turn % 2 <> 0) END AS truncated, CASE WHEN turn % 5 = 0 THEN 'unknown' WHEN turn % 5 = 1 THEN 'metadata' ELSE 'derived' END AS source FROM conversations""")
def truncation_signals(spark, sf_dir):
    r = _replies(spark, sf_dir).withColumn("s", X.truncation_signals(F.col("finish"), F.col("r")))
    known = F.size("s") > 0
    v = X.truncation_verdict(F.when(F.col("turn") % 5 == 1, known), F.lit(None).cast("boolean"), F.when(F.col("turn") % 5 != 0, known))
    return r.select("conv_id", "turn", F.array_join("s", " ").alias("signals"), v["truncated"].alias("truncated"), v["source"].alias("source"))


@_add("str_turtle_tests", """
SELECT conv_id, turn, true AS signature, true AS statement, turn % 2 <> 0 AS open_fence FROM conversations""")
def turtle_tests(spark, sf_dir):
    r = F.col("r")
    return _replies(spark, sf_dir).select("conv_id", "turn", X.looks_like_turtle(r).alias("signature"), X.has_statement(r).alias("statement"), X.has_open_fence(r).alias("open_fence"))


#: Replies of twelve kinds by conv_id + turn, around the turn's text, and what is taken for the artefact.
_TTL = "@prefix : <http://e/> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n:A a owl:Class ."
_ONLY, _TAB = "@prefix : <http://e/> .\n# only this", "| what | :A a owl:Class and much more of it |\n" * 5
_FORMS = [
    ("Sure.\n```turtle\n" + _TTL + "\n```\nDone.", _TTL), ("Wrapped in ```turtle ... ``` as asked.\n```turtle\n" + _TTL + "\n```", _TTL), ("```turtle\n" + _ONLY + "\n```\n```turtle\n" + _TTL + "\n```", _TTL), ("```turtle\n" + _TTL + "\n```\n```\n" + _TAB + "```", _TTL),
    ("```turtle\n" + _ONLY + "\n```", _ONLY), ("```python\n" + _TTL + "\n```", _TTL), ("```turtle\n" + _TTL + "\n:B a", _TTL + "\n:B a"), ("Classes:\n:Foo a owl:Class .", ":Foo a owl:Class ."),
    ("So:\n  <http://e/a> a <http://e/B> .", "<http://e/a> a <http://e/B> ."), ("Here:\n" + _TTL + "\n```", _TTL), ("```sparql\nASK { ?x ?p ?y }\n```\n" + _TTL, _TTL), ("- :Foo is a class\n```\n...\n```", None),
]
#: Those whose artefact is not in a block.
_UNFENCED = (7, 8, 9, 10, 11)


def _formed(spark, sf_dir):
    reply = F.element_at(F.array(*[F.lit(r) for r, _ in _FORMS]), ((F.col("conv_id") + F.col("turn")) % 12 + 1).cast("int"))
    words = F.regexp_replace("text", r"[`@\r\n:<]", " ")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("As for: "), words, F.lit("\n"), reply).alias("r"))


def _formed_sql(skip=()) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("\n", "' || chr(10) || '") + "'"
    return "CASE (conv_id + turn) % 12 " + " ".join(f"WHEN {i} THEN {quoted(None if i in skip else x)}" for i, (_, x) in enumerate(_FORMS)) + " END"


@_add("win_first_or_longest_block", f"SELECT conv_id, turn, {_formed_sql(_UNFENCED)} AS block FROM conversations")
def chosen_block(spark, sf_dir):
    """The fenced block that is taken for the artefact in every reply."""
    return _formed(spark, sf_dir).select("conv_id", "turn", X.chosen_block(F.col("r")).alias("block"))


@_add("pred_classify_cq", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(can|does|is)\s+(the\s+)?(ontology|pattern|model|odp)\b|\bcan\s+(the\s+)?ontology\s+represent\b') THEN 'meta'
  WHEN regexp_matches(text, '(?i)^\s*how\s+many\b|\bmost\s+common\b|\bthe\s+most\b|\baverage\b|\btotal\s+number\b|\bhow\s+much\s+\w+\s+(is|are|was|were)\b') THEN 'data_dependent' ELSE 'structural' END AS kind FROM conversations""")
def classify_cq(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.question_kind(F.col("text")).alias("kind"))


@_add("set_dedup_ordered", """
WITH w AS (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w, unnest(range(len(string_split(lower(text), ' ')))) AS i FROM benchmark) GROUP BY item_id, w)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM w GROUP BY item_id""")
def dedup_ordered(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@_add("str_extract_turtle", f"SELECT conv_id, turn, {_formed_sql()} AS block FROM conversations")
def extract_turtle(spark, sf_dir):
    """What is taken for the artefact in every reply: the chosen block, or without one the text from the first line that begins like it."""
    return _formed(spark, sf_dir).select("conv_id", "turn", X.extracted_turtle(F.col("r")).alias("block"))


@_add("str_truncation_verdict", """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN turn % 3 = 0 END AS truncated, CASE turn % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'banner' WHEN 2 THEN 'derived' ELSE 'unknown' END AS source FROM conversations""")
def truncation_verdict(spark, sf_dir):
    """Truncation by the first source that knows: metadata, banner, reply."""
    k = F.col("turn") % 4
    v = X.truncation_verdict(F.when(k == 0, True), F.when(k <= 1, True), F.when(k <= 2, F.col("turn") % 3 == 0))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", v["truncated"].alias("truncated"), v["source"].alias("source"))
