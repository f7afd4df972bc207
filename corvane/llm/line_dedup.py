"""Line dedup: passages of three lines that occur before are cut from later places.

Windows of three consecutive lines that hold more than white space are hashed (128 bits). A window's first place is the one
of the least (doc_id, line); every later place covers its lines, covered lines of a document are merged, and what is
covered goes. Only DataFrame functions run: hashes of lines travel, texts stay where they are scanned unless the table of
covered lines is too large to broadcast (its rows and lines are counted). A window that very many documents share is one row a
task after partial aggregation, and the join back to its places is one that Spark splits when it is skewed.

Edge cases: null text stays null, empty text stays empty; texts of fewer than three such lines have no window; blank lines never
count and stay; a row without doc_id is left as it is; rows of one doc_id and one text count as one place and get equal
results; an empty table gives an empty result; extra columns are kept and helper columns start with ``__cv_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

WINDOW = 3
#: Documents with covered lines, and covered lines in them, that may be broadcast (16 MB at most); beyond it texts are shuffled.
MOST_BROADCAST, MOST_LINES = 200_000, 2_000_000


def _full_lines(text: Column) -> Column:
    """(at, a, b): place and two hashes of every line that holds more than white space."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("x")))
    return F.transform(F.filter(lines, lambda s: F.length(F.translate(s["x"], " \t\r\f\x0b", "")) > 0), lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit("line"), s["x"]).alias("b")))


def covered_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, lines): for each document with lines to cut, their places (from 0). ``key`` is a hash of the text."""
    full = docs.filter("doc_id is not null").select("doc_id", F.xxhash64(text).alias("key"), _full_lines(F.col(text)).alias("full")).filter(F.size("full") >= WINDOW)
    at = lambda j, k: F.get("full", j + k)
    window = lambda j: F.struct(
        *[at(j, k)["at"].alias(f"l{k}") for k in range(WINDOW)],
        F.xxhash64(*[at(j, k)["a"] for k in range(WINDOW)]).alias("w1"),
        F.xxhash64(F.lit("window"), *[at(j, k)["b"] for k in range(WINDOW)]).alias("w2"),
    )
    places = full.select("doc_id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("full") - WINDOW), window)).alias("w")).select("doc_id", "key", "w.*")
    places = _io.materialize(places)
    first = places.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "l0")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w1", "w2", "first")
    later = places.join(first, ["w1", "w2"]).filter(F.struct("doc_id", "l0") > F.col("first"))
    merged = later.select("doc_id", "key", F.explode(F.array(*[f"l{k}" for k in range(WINDOW)])).alias("line")).groupBy("doc_id", "key").agg(F.collect_set("line").alias("lines"))
    merged = _io.materialize(merged)
    _io.discard(places)
    return merged


def line_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text`` without the covered lines, with ``__cv_n_lines`` and ``__cv_n_removed`` (long)."""
    cut = covered_lines(docs, text).select(F.col("doc_id").alias(_io.OWN + "id"), F.col("key").alias(_io.OWN + "key"), F.col("lines").alias(_io.OWN + "cut"))
    if _io.is_small(cut, MOST_BROADCAST, MOST_LINES, F.size(_io.OWN + "cut")):
        cut = F.broadcast(cut)
    lines, gone = F.split(F.col(text), "\n", -1), F.col(_io.OWN + "cut")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return (
        docs.join(cut, (F.col("doc_id") == F.col(_io.OWN + "id")) & (F.xxhash64(text) == F.col(_io.OWN + "key")), "left")
        .withColumn(_io.OWN + "n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn(_io.OWN + "n_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn(text, F.when(gone.isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")))
        .select(*[f"`{c}`" for c in docs.columns], _io.OWN + "n_lines", _io.OWN + "n_removed")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_io.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(_io.OWN + "n_lines").alias("n_lines"), F.col(_io.OWN + "n_removed").alias("n_removed"), "text")


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, i - 1 AS pos, ls[i] AS x FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT doc_id, pos, x, row_number() OVER w AS j, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(pos, 1) OVER w AS a1, lead(pos, 2) OVER w AS a2
      FROM l WHERE length(translate(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11), '')) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT doc_id, pos, a1, a2, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, pos) AS k FROM f WHERE x2 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest([pos, a1, a2]) AS pos FROM w WHERE k > 1),
r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN n.n_removed IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""
