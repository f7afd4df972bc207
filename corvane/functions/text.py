"""Text scalars as Column functions: identifiers, tokens, normal forms, tags and fenced blocks. Null in, null out unless said."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no meaning in identifiers, and suffixes with what of them is cut.
TOKEN_STOP = ["has", "is", "the", "a", "an", "of", "in", "on", "to", "for", "by", "with", "and", "or", "was", "were", "be"]
SUFFIXES = [("ies", 3), ("ses", 2), ("es", 2), ("s", 1), ("ing", 3), ("ed", 2), ("ation", 5), ("tion", 4)]
# Stop words of prose compared with vocabularies.
PROSE_STOP = [
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "be", "as", "by", "it", "this", "that", "from", "at",
    "if", "then", "than", "into", "about", "what", "which", "when", "where", "how", "who", "can", "does", "have", "has", "been", "used", "given",
    "type", "types", "list", "show", "each", "any", "all", "not", "no", "its", "their", "was", "were", "do", "did", "will", "would", "could",
    "should", "shall", "may", "might", "use", "using", "per", "via",
]
# Time-saved answers and their midpoints in percent.
TIME_SAVED = {"0%": 0.0, "1-25%": 13.0, "26-50%": 38.0, "51-75%": 63.0, "76-100%": 88.0}
# Patterns of data questions and of questions about the model itself.
META_QUESTION = r"(?i)\b(can|does|is)\s+(the\s+)?(ontology|pattern|model|odp)\b|\bcan\s+(the\s+)?ontology\s+represent\b"
DATA_QUESTION = r"(?i)^\s*how\s+many\b|\bmost\s+common\b|\bthe\s+most\b|\baverage\b|\btotal\s+number\b|\bhow\s+much\s+\w+\s+(is|are|was|were)\b"
# Names of a block's language, and names that do not contradict it.
STRICT_NAMES, LOOSE_NAMES = ["turtle", "ttl", "rdf", "n3", "trig", "owl"], ["", "text", "txt", "plaintext"]
# Marks of a reply that ran out of its budget.
LENGTH_MARKS = ["length", "max_tokens", "max_output_tokens", "maxtokens", "incomplete"]
# Instructions that pass for questions, with the reason given.
BOILERPLATE = [
    (r"```", "contains a markdown code fence"),
    (r"\bturtle\b", "mentions the Turtle serialisation"),
    (r"\bowl\s*:", "contains an OWL qname"),
    (r"\brdfs?\s*:", "contains an RDF(S) qname"),
    (r"@prefix", "contains a Turtle prefix declaration"),
    (r"\bcompetency question", "refers to competency questions themselves"),
    (r"\bmodeling constraint|\bmodelling constraint", "is a modelling-constraint bullet"),
    (r"\boutput (only|the|a)\b", "is an output-format instruction"),
    (r"\bdo not\b.*\b(explain|output|include|add)\b", "is a prohibition instruction"),
    (r"\byou are\b|\bas an ai\b|\byour task\b", "is prompt persona text"),
    (r"\bscenario\b.*\bfollow", "is prompt framing text"),
    (r"^\s*(generate|produce|write|create|return)\b.*\b(ontology|owl|rdf|ttl)\b", "instructs the model to emit an ontology"),
]


def words(c: Column, pattern: str = "[^A-Za-z0-9]+") -> Column:
    """Pieces between matches of ``pattern``, without empty ones."""
    return F.filter(F.split(F.regexp_replace(c, pattern, " "), " "), lambda w: w != "")


def camel_split(c: Column) -> Column:
    """Blanks where lower case or a digit meets upper case, and before the last capital of a run that a word follows."""
    return F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def suffix_strip(c: Column) -> Column:
    """The first suffix of the table that ends a word at least three letters longer than it is cut."""
    out = c
    for suffix, cut in reversed(SUFFIXES):
        out = F.when((F.length(c) > len(suffix) + 2) & c.endswith(suffix), F.substring(c, 1, F.length(c) - cut)).otherwise(out)
    return out


def identifier_tokens(c: Column) -> Column:
    """Distinct lower-case words of an identifier without stop words, and the same words without suffixes."""
    kept = F.filter(words(F.lower(F.regexp_replace(camel_split(c), "[^A-Za-z0-9]+", " ")), " +"), lambda w: ~w.isin(TOKEN_STOP))
    return F.array_union(kept, F.transform(kept, suffix_strip))


def flat(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def local_name(c: Column, strip_slash: bool = False) -> Column:
    """What follows the last ``#``, or else the last ``/``."""
    base = F.regexp_replace(c, "/+$", "") if strip_slash else c
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(F.substring_index(base, "/", -1))


def name_words(c: Column) -> Column:
    """Lower-case, space-separated words of a local name."""
    return F.trim(F.lower(camel_split(F.regexp_replace(local_name(c, True), "[_-]+", " "))))


def stem(c: Column) -> Column:
    """Ordered suffix rules; the first that holds decides."""
    raw = F.lower(c)
    w = F.when(raw.endswith("'s"), F.substring(raw, 1, F.length(raw) - 2)).otherwise(raw)
    n = F.length(w)
    cut = lambda k: F.substring(w, 1, n - k)
    return (
        F.when((n > 5) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & w.rlike("(ches|shes|sses|xes)$"), cut(2))
        .when((n >= 5) & w.endswith("ing"), cut(3))
        .when((n >= 5) & w.endswith("ed") & ~w.endswith("eed"), cut(2))
        .when((n >= 4) & w.endswith("s") & ~w.rlike("(ss|us|is|as)$"), cut(1))
        .otherwise(w)
    )


def prose_tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Distinct lower-case words of three letters or more that start with a letter, without stop words."""
    got = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9]*"), F.lit(0))
    return F.array_distinct(F.filter(got, lambda w: (F.length(w) >= 3) & ~w.isin(stop or PROSE_STOP)))


def stemmed_tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Distinct stems, in order, of words of three letters or more outside the stop list (the stems too)."""
    stop = stop or PROSE_STOP
    ok = lambda w: (F.length(w) >= 3) & ~w.isin(stop)
    got = F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(F.filter(F.transform(got, F.lower), ok), stem), ok))


def norm_question(c: Column, how: str) -> Column:
    """Normal forms of questions: ``guard`` (white space, case, end marks), ``audit`` (also backticks), ``key`` (word characters)."""
    squeezed = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    if how == "guard":
        return F.regexp_replace(squeezed, r"[ ?.!]+$", "")
    if how == "audit":
        return F.regexp_replace(F.trim(F.regexp_replace(squeezed, "`", "")), r"[ ?.!,;:]+$", "")
    return F.trim(F.regexp_replace(F.lower(c), r"\W+", " "))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Similarity of two arrays as sets; ``empty`` when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigram_phrases(w: Column, most: int = 12) -> Column:
    """Distinct words and then neighbouring pairs, the first ``most``."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(F.array_distinct(F.concat(w, pairs)), 1, most)


def question_kind(c: Column) -> Column:
    return F.when(c.rlike(META_QUESTION), "meta").when(c.rlike(DATA_QUESTION), "data_dependent").otherwise("structural")


def first_reason(c: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The reason of the first rule whose pattern is found in any case, else null."""
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for pattern, reason in reversed(rules):
        out = F.when(c.rlike(f"(?i){pattern}"), F.lit(reason)).otherwise(out)
    return out


def tags(c: Column, themes: dict[str, list[str]]) -> Column:
    """Names of the themes of which some pattern is found, in the order of ``themes``."""
    hit = [F.when(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(k)) for k, ps in themes.items()]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


# How a fenced block is written (info, body, closing mark), what only Turtle holds, how a directive begins, and how a line of bare Turtle begins.
FENCE = r"(?s)```[ \t]*([A-Za-z0-9_.+-]*)[ \t]*\r?\n?(.*?)(```|\z)"
TURTLE_SIGN, DIRECTIVE = r"(?i)@prefix\b|\sa\s+owl:", r"(?i)^@?(?:prefix|base)\b"
BARE_STARTS = ["@prefix", "@base", "prefix ", "base ", "<http://", "<https://"]


def stripped(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def fences(c: Column) -> Column:
    """(info, body, closed) of every fenced block in order; the last may be open."""
    part = lambda g: F.regexp_extract_all(c, F.lit(FENCE), F.lit(g))
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    return F.transform(zipped, lambda z: F.struct(F.lower(z["a"]).alias("info"), z["b"].alias("body"), (z["c"] != "").alias("closed")))


def has_open_fence(c: Column) -> Column:
    return F.exists(fences(c), lambda b: ~b["closed"])


def looks_like_turtle(c: Column) -> Column:
    return c.rlike(TURTLE_SIGN)


def has_statement(c: Column) -> Column:
    """Whether some line is neither blank, nor a comment, nor a directive."""
    return F.exists(F.split(c, r"\r\n|\r|\n"), lambda x: (stripped(x) != "") & ~stripped(x).startswith("#") & ~stripped(x).rlike(DIRECTIVE))


def chosen_block(c: Column, strict: list[str] | None = None, loose: list[str] | None = None) -> Column:
    """The body, without white space at its ends, of the fenced block that is taken for the artefact; null if none looks like it.

    Blocks that state something go before those of directives only. Among them the first whose name is a Turtle name wins; else the
    longest without a telling name; else the longest of any name. The first of equally long ones counts.
    """
    strict, loose = strict or STRICT_NAMES, loose or LOOSE_NAMES
    blocks = F.transform(F.filter(fences(c), lambda b: looks_like_turtle(b["body"])), lambda b: F.struct(b["info"].alias("info"), stripped(b["body"]).alias("body"), has_statement(b["body"]).alias("says")))

    def pick(found: Column) -> Column:
        pool = F.when(F.exists(found, lambda b: b["says"]), F.filter(found, lambda b: b["says"])).otherwise(found)
        longest = lambda bs: F.array_max(F.transform(bs, lambda b, i: F.struct(F.length(b["body"]).alias("n"), (-i).alias("i"), b["body"].alias("body"))))["body"]
        return F.coalesce(F.get(F.filter(pool, lambda b: b["info"].isin(strict)), 0)["body"], longest(F.filter(pool, lambda b: b["info"].isin(loose))), longest(pool))

    return F.get(F.transform(F.array(blocks), pick), 0)


def extracted_turtle(c: Column) -> Column:
    """The artefact in a reply: the chosen block, be it open; where no block looks like Turtle, the text from the first line that begins like it. Else null.

    Prose, and the body of a block that holds something else, are never taken: nothing is better than what only looks like a result.
    """
    lines = F.split(stripped(c), r"\r\n|\r|\n")

    def begins(x: Column) -> Column:
        low = F.lower(stripped(x))
        typed = low.startswith(":") & (low.contains(" a owl:") | low.contains(" a rdf:"))
        return typed | F.array_contains(F.transform(F.array(*map(F.lit, BARE_STARTS)), lambda m: low.startswith(m)), True)

    first = F.array_min(F.transform(lines, lambda x, i: F.when(begins(x), i)))
    bare = stripped(F.array_join(F.slice(lines, first + 1, F.size(lines) - first), "\n"))
    bare = stripped(F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```\z", ""))
    return F.coalesce(chosen_block(c), F.when(first.isNotNull(), bare))


def truncation_signals(finish: Column, text: Column, dropped: Column | None = None) -> Column:
    """Names of the signs that a reply was cut short: finish reason, open fence, dropped last statement."""
    budget = F.lower(finish).rlike("|".join(LENGTH_MARKS))
    parts = [F.when(budget, "finish_reason"), F.when(has_open_fence(text), "open_fence")]
    if dropped is not None:
        parts.append(F.when(dropped, "dropped_statement"))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def truncation_verdict(metadata: Column, banner: Column, derived: Column) -> Column:
    """(truncated, source): the first known of metadata, banner, derived; unknown stays null and is never false."""
    source = F.when(metadata.isNotNull(), "metadata").when(banner.isNotNull(), "banner").when(derived.isNotNull(), "derived").otherwise("unknown")
    return F.struct(F.coalesce(metadata, banner, derived).alias("truncated"), source.alias("source"))


def lead_number(c: Column) -> Column:
    """The number at the start of free text, else null."""
    return F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def strict_int(c: Column) -> Column:
    """An integer if the trimmed text is one, else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def clamped_score(c: Column) -> Column:
    """1 to 10; 0 if it cannot be read."""
    n = c.cast("string").try_cast("double").try_cast("int")
    return F.when(n.isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), n)))


# Dashes that stand for a hyphen in answers.
DASHES = "‐‑‒–—−"


def time_saved_label(c: Column) -> Column:
    """An answer whose compatibility forms have been folded (``folded``) with any dash, and a dash lost to a question mark, as a plain hyphen."""
    return F.translate(stripped(c), DASHES + "?", "-" * (len(DASHES) + 1))


def folded(df: DataFrame, column: str, out: str, form: str = "NFKC", most: int = 200_000) -> DataFrame:
    """``df`` with ``out``: the Unicode normal form of a text column; null stays null.

    Answers repeat, so only distinct ones go through Arrow's kernel; they come back by a broadcast if at most ``most`` of them were counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_normalize(b.column(0), form)], names=["__key", out])

    once = df.select(F.col(column).alias("__key")).filter("__key is not null").distinct().mapInArrow(run, f"__key string, `{out}` string")
    if once.limit(most + 1).count() <= most:
        once = F.broadcast(once)
    return df.join(once, F.col(column) == F.col("__key"), "left").drop("__key")


def time_saved(c: Column) -> Column:
    """The midpoint of a folded answer in percent, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIME_SAVED.items() for x in kv]), time_saved_label(c))


def numbered(items: Column) -> Column:
    """``1. first`` and so on, a line each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with ``{name}`` replaced by each value."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def with_banner(c: Column, lines: list[str]) -> Column:
    return F.concat(F.lit("".join(f"# {x}\n" for x in lines)), c)


def without_banner(c: Column) -> Column:
    """Text after its leading comment lines."""
    return F.regexp_replace(c, r"^(?:#[^\n]*\n)+", "")


def path_parts_after(c: Column, mark: str, n: int) -> Column:
    """The ``n`` path segments after the first segment ``mark``."""
    parts = F.split(c, "/")
    return F.when(F.array_contains(parts, mark), F.slice(parts, F.array_position(parts, mark).cast("int") + 1, n))


def file_safe(c: Column) -> Column:
    return F.translate(c, "/:", "__")
