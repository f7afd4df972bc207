"""Secret scans with corpus-wide ownership.

Base rules find assignments, access keys and long hexadecimal runs. Wider generators propose vendor tokens, private keys
(header and body) and dense base64 runs. The hash of every candidate's value is aggregated over the whole corpus by distinct
repositories (documents) and owners (sources): a value that one owner has, in however many copies, or that few owners have
in not very many documents is specific to them and looks live; any other is an example. Documents of one text are mirrors of
one repository and count once for an owner. Keys are compared without their line breaks; a private-key header without a key
is not compared and always looks live. Of the wider candidates only those that look live become spans.

Only DataFrame functions run. Texts are scanned once; candidates go to the shared folder with hashes instead of values.

Edge cases: null and empty texts have no spans; a null source counts as an owner of its own name ""; doc_id is not read, so
rows without one are documents as others are; repeated rows count as one document and give equal rows; an empty table gives an empty result; extra
columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from ._spans import add_matches, joined

MOST_OWNERS, MOST_DOCUMENTS = 2, 50
MOST_BROADCAST = 200_000

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_HEADER = r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"
#: What may stand between the lines of a key. Lines repeat possessively, which takes neither a stack nor a bound.
_BREAK = r"(?:[\x20\t\r\n]|\\[nr]){0,16}+"
BASE = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
WIDER = {
    "vendor": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{12,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    "keyblock": _HEADER + rf"(?:(?:{_BREAK}(?:Proc-Type|DEK-Info|Comment|Version): ?[^\r\n\\]{{1,80}}+){{0,4}}+(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?={_BREAK}-----END ))?(?:{_BREAK}-----END (?:[A-Z]{{1,12}} ){{0,3}}PRIVATE KEY-----)?)?",
    "dense": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}",
}
KINDS = (*BASE, *WIDER)


def _dense(v: Column) -> Column:
    """Upper case, lower case and several digits, with many different characters."""
    return v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9].*[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(v, ""))) >= 14)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with ``__cv_spans``: array of (start, order, end, kind, hash) of all candidates, sorted.

    ``__cv_document`` is a hash of the text.
    """
    t = _io.OWN + "t"
    has = F.col(t).rlike("(?i:passw|secret|token|api_?key)")
    df = docs.select(*[f"`{c}`" for c in docs.columns if c != text], _io.text_or_empty(text).alias(t))
    df = add_matches(df, t, {**BASE, **WIDER}, {"assign": has, "access": F.col(t).contains("AKIA"), "keyblock": F.col(t).contains("PRIVATE KEY")})
    m = {k: F.col(f"{_io.OWN}m_{k}") for k in KINDS}
    value = {"assign": lambda v: F.regexp_extract(v, _ASSIGN, 2), "keyblock": lambda v: F.regexp_replace(v, r"\s|\\[nr]", "")}
    keep = {"assign": lambda v: F.length(F.regexp_extract(v, _ASSIGN, 2)) >= 6, "dense": _dense}

    def spans_of(order: int, k: str) -> Column:
        kept = F.filter(m[k], lambda s: keep[k](s["value"])) if k in keep else m[k]
        name = lambda s: F.sha2(value[k](s["value"]) if k in value else s["value"], 256)
        if k == "keyblock":  # a header without a key says nothing about its owner, so it has no name
            named = name
            name = lambda s: F.when(~s["value"].rlike(f"^{_HEADER}$"), named(s))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(k).alias("kind"), name(s).alias("hash")))

    parts = [spans_of(order, k) for order, k in enumerate(KINDS)]
    return df.withColumn(_io.OWN + "spans", F.array_sort(F.concat(*parts))).withColumn(_io.OWN + "document", F.xxhash64(t)).drop(t, *[f"{_io.OWN}m_{k}" for k in KINDS])


def ownership(found: DataFrame) -> DataFrame:
    """(hash, documents, owners) of every candidate value; from rows (hash, owner, document)."""
    once = found.distinct()
    return once.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("documents"), F.count("*").alias("owners"))


def secret_scan(docs: DataFrame, text: str = "text", owner: str = "source", most_owners: int = MOST_OWNERS, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """All columns of ``docs`` but the text, with ``__cv_spans``: sorted array of (start, order, end, kind, hash, live).

    ``most_owners`` and ``most_documents`` bound how often a value of several owners may occur and still look live.
    """
    spans, uid = _io.OWN + "spans", _io.OWN + "uid"
    table = _io.materialize(candidates(docs, text).withColumn(uid, F.monotonically_increasing_id()))
    each = table.filter(F.size(spans) > 0).select(uid, F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.col(_io.OWN + "document").alias("document"), F.explode(spans).alias("s"))
    counts = _io.materialize(ownership(each.select("s.hash", "owner", "document").filter("hash is not null")))
    if counts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        counts = F.broadcast(counts)
    few = (F.col("owners") <= most_owners) & (F.col("documents") <= most_documents)
    live = F.col("hash").isNull() | (F.col("owners") == 1) | few
    judged = each.select(uid, "s.*").join(counts, "hash", "left").filter(live | F.col("kind").isin(*BASE))
    judged = judged.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind", "hash", live.alias("live")))).alias(_io.OWN + "judged"))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,hash:string,live:boolean>>")
    return table.drop(spans).join(judged, uid, "left").withColumn(spans, F.coalesce(_io.OWN + "judged", empty)).drop(uid, _io.OWN + "document", _io.OWN + "judged")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(_io.read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    s = F.col(_io.OWN + "spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter(s, lambda x: x["order"] < len(BASE))), 256).alias("base_sha256"), joined(s).alias("spans"),
        F.size(F.filter(s, lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter(s, lambda x: ~x["live"])).cast("long").alias("n_example"),
    )
