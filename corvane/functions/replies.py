"""Repair, extraction and diagnosis of model replies, as Column functions where no parser is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.rdf import parse_any, whole_statements
from .text import extracted_turtle, question_kind, stripped, with_banner

# Names of the repairs, and prefixes that need no colon before them.
QNAMES, HEADING, BARE, DROPPED = "normalized_standard_prefix_qnames", "commented_out_stray_semicolon_heading", "prefixed_bare_predicate", "dropped_incomplete_trailing_statement"
STANDARD = ["rdf", "rdfs", "owl", "xsd", "skos", "dc", "dcterms", "sh", "prov"]
# Separators at which a question is split, in order; and words that name nothing.
SPLITS = [" associated with ", " related to ", " belongs to ", " used in ", " performed on ", " of the ", " for the ", " in the ", " on the ", " of a ", " of an ", " of ", " for ", " in ", " on ", " about "]
NAMES_NOTHING = [
    "the", "a", "an", "of", "in", "on", "to", "for", "by", "with", "and", "or", "is", "are", "was", "were", "be", "been", "being", "that", "this", "these",
    "those", "it", "its", "their", "there", "any", "some", "all", "can", "could", "would", "should", "has", "have", "had", "do", "does", "did", "given",
    "specific", "particular", "e.g", "eg", "etc", "if", "not", "what", "which", "who", "when", "where", "why", "how", "at", "from", "as", "into", "about",
]
# How a question begins.
LEAD = r"(?i)^\s*(what|which|who|whom|whose|when|where|why|how(\s+\w+)?)\b(\s+(is|are|was|were|do|does|did|can|could|would|should|has|have|had))?(\s+(the|a|an))?\s*"


def _lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\r|\n")


def _headings(c: Column) -> Column:
    """Text in which a line that starts with a semicolon between two statements has become a comment."""
    zero = F.struct(F.lit(True).alias("between"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        stray = t.startswith(";") & acc["between"]
        kept = F.when(stray, F.concat(F.lit("# "), F.trim(F.substring(t, 2, 1 << 30)))).otherwise(line)
        mark = F.when(stray | t.startswith("#"), F.lit("")).otherwise(F.right(t, F.lit(1)))
        return F.struct(F.when(mark == ".", True).when(mark.isin(";", ","), False).otherwise(acc["between"]).alias("between"), F.array_append(acc["out"], kept).alias("out"))

    return F.array_join(F.aggregate(_lines(c), zero, step)["out"], "\n")


def _whole(c: Column) -> Column:
    """Text up to the last line that ends a statement; all of it if none does."""
    ends = F.array_max(F.transform(_lines(c), lambda x, i: F.when(F.trim(x).endswith(".") & ~F.trim(x).startswith("#"), i)))
    return F.when(ends.isNull(), c).otherwise(F.array_join(F.slice(_lines(c), 1, ends + 1), "\n"))


def repaired(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``fixed`` and ``repairs``: stray colons before standard prefixes, headings, bare predicates, an unfinished end."""
    a = F.regexp_replace(text, ":(" + "|".join(STANDARD) + "):", "$1:")
    out = df.withColumn("__a", a).withColumn("__b", _headings(F.col("__a")))
    out = out.withColumn("__c", F.regexp_replace("__b", r"(?m)(^\s*;\s*)(?!(?:" + "|".join(STANDARD) + r"))([A-Za-z_][A-Za-z0-9_-]*)(\s+)", "$1:$2$3"))
    out = out.withColumn("fixed", _whole(F.col("__c")))
    cut = F.length(F.trim(F.regexp_replace(F.substring(F.col("__c"), F.length("fixed") + 1, F.lit(1 << 30)), r"\s+", ""))) > 0
    unlike = lambda x, y: F.array_join(_lines(F.col(x)), "\n") != F.col(y)
    names = [F.when(F.col(text) != F.col("__a"), QNAMES), F.when(unlike("__a", "__b"), HEADING), F.when(F.col("__b") != F.col("__c"), BARE), F.when(cut, DROPPED)]
    return out.withColumn("repairs", F.array_compact(F.array(*names))).drop("__a", "__b", "__c")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), 0)


def signature(c: Column) -> Column:
    """(kind, subject, relation): what a question asks about and by which relation, from its words; weak, and always marked derived.

    The question is cut at the last place of the first separator in ``SPLITS`` that it holds; the relation stands before, the subject after.
    """
    edge = r"^[ ?.!,]+|[ ?.!,]+$"
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), LEAD, ""), edge, ""), r"\s+", " ")
    marks = F.array(*map(F.lit, SPLITS))

    def place(low: Column, reverse: Column) -> Column:
        places = F.transform(marks, lambda m: F.struct((F.length(low) - F.position(F.reverse(m), reverse) + 1 - F.length(m)).alias("at"), F.length(m).alias("n"), low.contains(m).alias("here")))
        return F.get(F.filter(places, lambda p: p["here"] & (p["at"] > 0)), 0)  # from 0, of the last occurrence

    def cut(text: Column) -> Column:
        hit = _once(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), lambda low: _once(F.reverse(low), lambda reverse: place(low, reverse)))
        side = lambda x: F.coalesce(F.regexp_replace(x, edge, ""), text)
        return _once(hit, lambda h: F.struct(text.alias("body"), side(F.substring(text, F.lit(1), h["at"])).alias("head"), side(F.substring(text, h["at"] + h["n"], F.length(text))).alias("tail")))

    def phrases(x: Column) -> Column:
        def joined(w: Column) -> Column:
            n = F.greatest(F.size(w) - 1, F.lit(0))
            pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))
            return F.slice(F.array_distinct(F.concat(F.array_distinct(w), pairs)), 1, 12)

        return _once(F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z][a-z0-9\-]*"), F.lit(0)), lambda v: ~v.isin(NAMES_NOTHING) & (F.length(v) > 2)), joined)

    some = lambda x, other: _once(x, lambda v: F.when(F.size(v) > 0, v).otherwise(other))

    def named(parts: Column) -> Column:
        subject = some(phrases(parts["tail"]), some(phrases(parts["body"]), F.array(F.lit("thing"))))
        return _once(subject, lambda s: F.struct(question_kind(c).alias("kind"), s.alias("subject"), some(phrases(parts["head"]), s).alias("relation")))

    return _once(_once(body, cut), named)


# What makes a text plausibly Turtle, the least bytes of an artefact, and the lines that mark one that was cut short.
MARKS, LEAST_BYTES = ["@prefix", "@base", " a owl:"], 50
CUT_SHORT = ["ODPGEN-RECOVERED-FROM-TRUNCATED-RESPONSE", "The model's reply was truncated by the generation token budget.", "Recovered from raw_response.txt; the trailing axiom(s) are missing.", "Do NOT count this artefact as a complete generation."]
# How a closed block begins on a line of its own, and what an open one has after it.
CLOSED, OPEN_TAIL = r"(?s)```[ \t]*[A-Za-z0-9_+.-]*[ \t]*\r?\n(.*?)```", r"(?s)```[ \t]*[A-Za-z0-9_+.-]*[ \t]*\r?\n((?:(?!```).)*+)\z"
# Why nothing was recovered.
REASONS = ["raw_response_missing", "raw_response_empty", "no_turtle_content_in_raw_response", "unterminated_code_fence", "no_fenced_turtle_block", "extractor_returned_nothing", "extraction_fell_outside_closed_fences", "recovered_text_below_min_bytes", "recovered_text_does_not_parse", "recovered_text_not_better_than_original"]
NO_REPLY, NO_TEXT, NO_TURTLE, UNTERMINATED, NOT_FENCED, NOTHING, OUTSIDE, TOO_SHORT, UNPARSEABLE, NOT_BETTER = REASONS


def plausible(c: Column) -> Column:
    return F.lower(c).rlike("|".join(m.replace(" ", "[ ]") for m in MARKS))


def closed_blocks(c: Column) -> Column:
    """Bodies of closed blocks that plausibly hold Turtle, longest first and the earlier of equally long ones."""
    bodies = F.filter(F.transform(F.regexp_extract_all(c, F.lit(CLOSED), F.lit(1)), stripped), plausible)
    return F.transform(F.sort_array(F.transform(bodies, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b"))), asc=False), lambda x: x["b"])


def cut_short(c: Column) -> Column:
    """Whether a reply ends inside a block that plausibly holds Turtle: an odd number of fence marks, and Turtle after the last."""
    parts = F.split(c, "```", -1)
    return (F.size(parts) % 2 == 0) & plausible(F.element_at(parts, -1))


def open_tail(c: Column) -> Column:
    """The body of the block that a reply ends in, if it plausibly holds Turtle; else null."""
    body = stripped(F.regexp_extract(c, OPEN_TAIL, 1))
    return F.when(plausible(body), body)


def diagnosis(c: Column) -> Column:
    """Why nothing usable is in a reply."""
    odd = F.size(F.split(c, "```", -1)) % 2 == 0
    return (
        F.when(c.isNull(), NO_REPLY).when(stripped(c) == "", NO_TEXT).when(F.size(closed_blocks(c)) > 0, UNPARSEABLE)
        .when(odd, UNTERMINATED).when(~plausible(c), NO_TURTLE).otherwise(NOT_FENCED)
    )


def recovered(df: DataFrame, key: str, reply: str, least: int = LEAST_BYTES, truncated: bool = False) -> DataFrame:
    """(key, text, extractor, repaired, dropped_bytes, n_triples, partial, reason): what a reply holds that parses to some triple.

    Tried are the extracted text and then the longest closed block, each as it stands and then repaired. Where closed blocks
    exist, only one of them, word for word, is accepted; a reply that ends inside a block yields nothing, unless
    ``truncated`` allows its tail up to the last whole statement, by the grammar and not by how a line ends. Such a text is ``partial`` and is
    to be stored under ``CUT_SHORT`` (see ``stored_text``). Without a text, ``reason`` says why: of the last try if one was made, else of the reply.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    c = F.col(reply)
    x = df.select(key, c.alias("__r"), F.coalesce(extracted_turtle(c), F.lit("")).alias("__first"), closed_blocks(c).alias("__closed"), cut_short(c).alias("__cut"), open_tail(c).alias("__tail"), diagnosis(c).alias("__why"))
    x = x.withColumn("__second", F.coalesce(F.get("__closed", 0), F.lit("")))
    x = repaired(x, "__first").withColumnRenamed("fixed", "__fa").drop("repairs")
    x = repaired(x, "__second").withColumnRenamed("fixed", "__fb").drop("repairs")
    tries = F.array(*[F.struct(F.lit(name).alias("name"), F.col(t).alias("text"), stripped(F.col(f)).alias("fixed")) for name, t, f in (("extracted", "__first", "__fa"), ("longest_block", "__second", "__fb"))])
    fenced = F.size("__closed") > 0
    barred = lambda t: F.when(fenced & ~F.array_contains(F.col("__closed"), t["text"]), OUTSIDE).when(~fenced & F.col("__cut"), UNTERMINATED)
    tries = F.transform(F.filter(tries, lambda t: t["text"] != ""), lambda t: F.struct(t["name"].alias("name"), t["text"].alias("text"), t["fixed"].alias("fixed"), barred(t).alias("barred")))
    source = x.select(key, tries.alias("tries"), F.when(F.lit(truncated) & F.col("__cut") & ~fenced, F.col("__tail")).alias("tail"), "__why")

    def parses(text: str) -> int:
        return len(parse_any(text, "", "nonempty")[1]) if len(text.encode()) >= least else -1

    def one(tries: list[dict], tail: str | None, why: str) -> tuple:
        last, seen = None, set()
        for t in tries:
            if t["text"] in seen:
                continue
            seen.add(t["text"])
            if t["barred"]:
                last = last or t["barred"]
                continue
            for text, mended in ((t["text"], False), (t["fixed"], True)):
                if mended and text in ("", t["text"]):
                    continue
                n = parses(text)
                if n > 0:
                    return text, t["name"], mended, len(t["text"].encode()) - len(text.encode()), n, False, None
                last = UNPARSEABLE if n == 0 else last or TOO_SHORT
                if n < 0:
                    break
        if tail:
            end, rows = whole_statements(tail)
            text = tail[:end].strip()
            if rows and len(text.encode()) >= least:
                return text, "open_tail", end < len(tail), len(tail.encode()) - len(text.encode()), len(rows), True, None
            last = UNPARSEABLE
        return None, None, False, 0, 0, False, why if why != UNPARSEABLE or last is None else last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), k) for v, k in zip(cols, kinds, strict=True))], names=[key, "text", "extractor", "repaired", "dropped_bytes", "n_triples", "partial", "reason"])

    return source.mapInArrow(run, f"{key} {kind}, text string, extractor string, repaired boolean, dropped_bytes long, n_triples long, partial boolean, reason string")


def stored_text(text: Column, partial: Column) -> Column:
    """What is written: the text with a final line break, under the banner if it is partial and has none yet."""
    whole = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    return F.when(partial & ~F.ltrim(whole).startswith("# " + CUT_SHORT[0]), with_banner(whole, CUT_SHORT)).otherwise(whole)


def decided(state: Column, size: Column, found: Column, reason: Column, keep_unparseable: bool = True) -> Column:
    """(status, reason) of a stored artefact: healthy, recovered, unrecoverable, or skipped_unparseable.

    ``state`` is that of the stored text (ok, missing, empty, too_small, unparseable) and ``size`` its bytes. One that is whole but
    does not parse is the model's own failure and is skipped unless something that parses was found; it is never traded for a smaller one.
    """
    bad = state == "unparseable"
    lost = found.isNull()
    worse = bad & (F.octet_length(found) <= size)
    status = F.when(state == "ok", "healthy").when(bad & lost & F.lit(keep_unparseable), "skipped_unparseable").when(lost | worse, "unrecoverable").otherwise("recovered")
    why = F.when(state == "ok", F.lit(None).cast("string")).when(lost, F.coalesce(reason, F.lit(NOTHING))).when(worse, NOT_BETTER)
    return F.struct(status.alias("status"), why.alias("reason"))
