"""URL filters by a temporal list join.

A list is a table of dated events: on a day a pattern enters a category or leaves it. Events become validity intervals
[entered, left), and every capture is judged as of its fetch day: by entries for its host, for any parent domain, and for
host and first path segment. Only DataFrame functions run. Captures of one URL and day are judged once, so that a host or
URL with a large share of the rows costs little; intervals are broadcast only if they are counted and few, and else the
equi-join on the pattern is one that Spark splits when it is skewed.

Edge cases: a null, empty or unreadable URL has no host and no entry; a null day meets no interval; an event without
pattern, category or day is left out; of events of one pattern, category and day "remove" wins; adding twice keeps the first
day; an empty list or table gives no entries or rows; repeated captures give equal rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import _io

MOST_BROADCAST = 200_000


def host_of(url: Column) -> Column:
    """Lower-cased host, without user, port and the dot of the root; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(F.length(host) > 0, host)


def keys_of(url: Column, longest: int) -> Column:
    """Patterns of at most ``longest`` characters that a URL may meet: host, parent domains of two labels or more, and host/first segment.

    Only the end of a host that is that long is cut into labels, so a host of very many labels costs no more than the longest pattern.
    """
    host = host_of(url)
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)", 1)
    none = F.array().cast("array<string>")
    short = F.length(host) <= longest
    labels = F.split(F.right(host, F.lit(longest + 1)), r"\.")
    labels = F.when(short, labels).otherwise(F.slice(labels, 2, F.size(labels)))  # the first label of a long host is cut or too long

    def parents(own: Column) -> Column:
        n = F.size(own)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(own, i, n), "."))).otherwise(none)

    made = F.flatten(F.transform(F.array(F.struct(labels.alias("own"), short.alias("short"))), lambda x: F.when(x["short"] | (F.size(x["own"]) >= 2), parents(x["own"])).otherwise(none)))
    path = F.when((F.length(segment) > 0) & (F.length(host) + F.length(segment) <= longest), F.array(F.concat(host, segment))).otherwise(none)
    return F.when(host.isNotNull(), F.array_distinct(F.concat(made, path))).otherwise(none)


def validity(events: DataFrame) -> DataFrame:
    """(pattern, category, entered, left) from (pattern, category, action, day); ``left`` is null while an entry is active."""
    events = events.withColumn("pattern", F.regexp_replace("pattern", r"^([^/]+)\.(?=/|$)", "$1"))  # the dot of the root says nothing
    daily = events.filter("pattern is not null and category is not null and day is not null").groupBy("pattern", "category", "day").agg(F.max(F.col("action") == "remove").alias("gone"))
    w = Window.partitionBy("pattern", "category").orderBy("day")
    turns = daily.withColumn("was", F.lag("gone").over(w)).filter("not gone and coalesce(was, true) or gone and not was")
    return turns.withColumn("left", F.lead("day").over(w)).filter("not gone").select("pattern", "category", F.col("day").alias("entered"), "left")


def url_filter(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """All columns of ``captures`` with ``__cv_n_active`` (long) and ``__cv_categories`` (sorted array) as of the fetch day."""
    spans = _io.materialize(validity(events))
    if spans.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    longest = spans.agg(F.max(F.length("pattern"))).first()[0] or 0
    one = captures.select(F.col(url).alias("u"), F.col(day).alias("d")).filter("u is not null and d is not null").distinct()
    met = one.select("u", "d", F.explode(keys_of(F.col("u"), longest)).alias("pattern")).join(spans, "pattern").filter("entered <= d and (left is null or d < left)")
    verdict = met.groupBy("u", "d").agg(F.count("*").alias(_io.OWN + "n_active"), F.array_sort(F.collect_set("category")).alias(_io.OWN + "categories"))
    verdict = verdict.withColumnsRenamed({"u": _io.OWN + "u", "d": _io.OWN + "d"})
    out = captures.join(verdict, (F.col(url) == F.col(_io.OWN + "u")) & (F.col(day) == F.col(_io.OWN + "d")), "left")
    return out.select(
        *[f"`{c}`" for c in captures.columns],
        F.coalesce(_io.OWN + "n_active", F.lit(0)).cast("long").alias(_io.OWN + "n_active"),
        F.coalesce(_io.OWN + "categories", F.array().cast("array<string>")).alias(_io.OWN + "categories"),
    )


def _digest(c: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(c), at, 4), 16, 10).cast("int")


def events_of(pages: DataFrame) -> DataFrame:
    """A dated list made by rule from the hosts of the pages, as the tables bring none: which hosts, parent domains and
    sections enter a category, when, and whether they leave and come back, follows from digests of the pattern."""
    hosts = pages.select(host_of(F.col("url")).alias("h"), F.col("url")).filter("h is not null")
    segment = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)", 1)
    patterns = hosts.select(F.explode(F.array("h", F.concat("h", segment), F.array_join(F.slice(F.split("h", r"\."), 2, 9), "."))).alias("pattern")).distinct()
    p = F.col("pattern")
    day = lambda n: F.date_add(F.to_date(F.lit("2024-01-01")), n)
    start = F.pmod(_digest(p, 5), F.lit(200))
    stay = 20 + F.pmod(_digest(p, 9), F.lit(100))
    category = F.when(F.pmod(_digest(p, 13), F.lit(2)) == 0, "spam").otherwise("malware")
    rows = F.array(
        F.struct(F.lit("add").alias("action"), day(start).alias("day")),
        F.struct(F.lit("remove").alias("action"), day(start + stay).alias("day")),
        F.struct(F.when(F.pmod(_digest(p, 17), F.lit(2)) == 0, "add").otherwise("remove").alias("action"), day(start + stay + 30).alias("day")),
    )
    listed = patterns.filter((F.length(p) > 0) & (F.pmod(_digest(p, 1), F.lit(3)) == 0))
    return listed.select(p, category.alias("category"), F.explode(rows).alias("e")).select("pattern", "category", "e.action", "e.day")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _io.read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")))
    out = url_filter(captures, events_of(pages))
    return out.select(
        "page_id", "url", F.col("day").cast("string").alias("fetched_on"), F.col(_io.OWN + "n_active").alias("n_active"),
        F.array_join(_io.OWN + "categories", ",").alias("categories"), (F.col(_io.OWN + "n_active") > 0).alias("blocked"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS DATE) AS d,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS h,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)', 1) AS seg FROM pages),
pat AS (SELECT DISTINCT unnest([h, h || seg, array_to_string(string_split(h, '.')[2:10], '.')]) AS pattern FROM p WHERE h IS NOT NULL),
dg AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS a, CAST('0x' || substr(md5(pattern), 5, 4) AS INTEGER) AS b, CAST('0x' || substr(md5(pattern), 9, 4) AS INTEGER) AS c,
        CAST('0x' || substr(md5(pattern), 13, 4) AS INTEGER) AS e, CAST('0x' || substr(md5(pattern), 17, 4) AS INTEGER) AS f FROM pat WHERE length(pattern) > 0),
iv AS (SELECT pattern, CASE WHEN e % 2 = 0 THEN 'spam' ELSE 'malware' END AS category, b % 200 AS t0, b % 200 + 20 + c % 100 AS t1 FROM dg WHERE a % 3 = 0
       UNION ALL SELECT pattern, CASE WHEN e % 2 = 0 THEN 'spam' ELSE 'malware' END, b % 200 + 20 + c % 100 + 30, 1000000 FROM dg WHERE a % 3 = 0 AND f % 2 = 0),
n AS (SELECT *, date_diff('day', DATE '2024-01-01', d) AS t, len(string_split(h, '.')) AS k FROM p),
keys AS (SELECT DISTINCT page_id, t, unnest(list_concat(list_transform(range(1, greatest(2, k)), lambda i: array_to_string(string_split(h, '.')[i:k], '.')), CASE WHEN seg <> '' THEN [h || seg] ELSE [] END)) AS pattern FROM n WHERE h IS NOT NULL),
m AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c FROM keys JOIN iv USING (pattern) WHERE t0 <= t AND t < t1 GROUP BY page_id)
SELECT p.page_id, p.url, CAST(p.d AS VARCHAR) AS fetched_on, CAST(coalesce(m.n, 0) AS BIGINT) AS n_active, coalesce(m.c, '') AS categories, coalesce(m.n, 0) > 0 AS blocked
FROM p LEFT JOIN m USING (page_id)
"""
