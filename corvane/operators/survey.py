"""Survey statistics: agreement, paired rank tests, summaries."""

from functools import reduce
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rollups import sample_spread


#: Categories of a scale of ratings.
MOST_CATEGORIES = 1000


def likert(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median and sample deviation (0 for one answer, null for none)."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), sample_spread(v).alias("sd"))


def krippendorff(ratings: DataFrame, unit: str, value: str, scale: str = "ordinal") -> DataFrame:
    """One row (alpha, n_units) from rows of one rating each; missing ratings and units of one rating are left out.

    A scale has few categories: more than ``MOST_CATEGORIES`` are an error, since their pairs and running sums are one task's.
    Distances need only counts of categories in all and a unit, so no pair of ratings is ever formed: the table a unit is
    (unit, category, count), and joins run over the categories, which a scale keeps few.
    """
    r = ratings.filter(F.col(value).isNotNull()).select(F.col(unit).alias("u"), F.col(value).cast("double").alias("v"))
    sized = r.groupBy("u", "v").agg(F.count("*").alias("c")).withColumn("m", F.sum("c").over(Window.partitionBy("u"))).filter("m >= 2")
    freq = sized.groupBy("v").agg(F.sum("c").alias("f"))
    if freq.limit(MOST_CATEGORIES + 1).count() > MOST_CATEGORIES:
        raise ValueError(f"{value} has more than {MOST_CATEGORIES} categories")
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    freq = freq.withColumn("run", F.sum("f").over(upto))  # categories only
    x, y = freq.alias("x"), freq.alias("y")
    between = F.col("y.run") - F.col("x.run") + F.col("x.f") - (F.col("x.f") + F.col("y.f")) / 2
    far = F.pow(between, 2) if scale == "ordinal" else F.lit(1.0)
    pairs = x.join(y, F.col("x.v") < F.col("y.v")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"), far.alias("d"), (F.col("x.f") * F.col("y.f")).alias("ff"))
    total = freq.agg(F.sum("f").alias("total"), F.count("*").alias("k"))
    expected = pairs.agg((2 * F.sum(F.col("ff") * F.col("d"))).alias("e"))
    l, r2 = sized.alias("l"), sized.alias("r")
    seen = l.join(r2, (F.col("l.u") == F.col("r.u")) & (F.col("l.v") < F.col("r.v"))).select(F.col("l.v").alias("a"), F.col("r.v").alias("b"), (F.col("l.c") * F.col("r.c") / (F.col("l.m") - 1)).alias("w"))
    observed = seen.groupBy("a", "b").agg(F.sum("w").alias("w")).join(pairs, ["a", "b"]).agg((2 * F.sum(F.col("w") * F.col("d"))).alias("o"))
    units = sized.agg(F.countDistinct("u").alias("n_units"))
    one = total.join(expected).join(observed).join(units)  # one row each
    e = F.col("e") / F.greatest(F.lit(1), F.col("total") - 1)
    alpha = F.when(F.col("n_units") == 0, None).when((F.col("k") < 2) | (e == 0), 1.0).otherwise(1 - F.coalesce("o", F.lit(0.0)) / e)
    return one.select(alpha.alias("alpha"), "n_units")


def signed_ranks(pairs: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """(by, n_pairs, n, w_plus, w_minus, w, r_rb, ties): ranks of |second - first| without zeros, averaged over ties.

    Under two pairs nothing is said; with zeros only, w and r_rb are 0.
    """
    d = pairs.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn("d", F.col(second) - F.col(first))
    every = d.groupBy(*by).agg(F.count("*").alias("n_pairs"))
    # ranks need only the distinct sizes of differences with their counts: partial aggregates come first, the window sees one row a size
    size = d.filter("d <> 0").groupBy(*by, F.abs("d").alias("ad")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    # a group of very many sizes is no single task: sizes fall into bands that rise with them, and a first window sees one row a band
    x = F.col("ad").cast("double")
    size = size.withColumn("band", F.when(F.isnan(x), F.lit(2**31)).otherwise(F.floor(F.log2(x) * 1024)))
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    bands = size.groupBy(*by, "band").agg(F.sum("t").alias("m")).select(*by, "band", upto.alias("before"))
    within = F.sum("t").over(Window.partitionBy(*by, "band").orderBy("ad").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")
    alike = reduce(lambda p, q: p & q, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*by, "band")])
    r = size.withColumn("within", within).alias("s").join(bands.alias("b"), alike).select("s.*", "before").withColumn("r", F.col("before") + F.col("within") + (F.col("t") + 1) / 2)
    sums = r.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum((F.col("t") - F.col("up")) * F.col("r")).alias("w_minus"))
    ties = r.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    out = every.join(sums, by, "left").join(ties, by, "left").na.fill(0)
    enough, some = F.col("n_pairs") >= 2, F.col("n") > 0
    return out.withColumn("w", F.when(enough, F.when(some, F.least("w_plus", "w_minus")).otherwise(0.0))).withColumn("r_rb", F.when(enough, F.when(some, (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))).otherwise(0.0)))


def wilcoxon_p(w: float, n: int, ties: int, zeros: int) -> float:
    """Two-sided p: exact for n up to 50 without ties and zeros, else the normal approximation with the tie correction."""
    if n == 0:
        return 1.0
    if ties == 0 and zeros == 0 and n <= 50:
        ways = np.zeros(n * (n + 1) // 2 + 1, dtype=object)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return float(min(1.0, 2 * int(sum(ways[: int(w) + 1])) / 2**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(1 - erf(abs(w - mean) / sqrt(var) / sqrt(2))) if var > 0 else 1.0


def with_wilcoxon_p(ranks: DataFrame) -> DataFrame:
    """``signed_ranks`` with ``p``; a few rows, one a group."""


    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, ties: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else wilcoxon_p(a, int(b), int(c), int(d - b)) for a, b, c, d in zip(w, n, ties, pairs, strict=True)], dtype="float64")

    return ranks.withColumn("p", p("w", "n", "ties", "n_pairs"))


def sign_test(plus: int, n: int) -> float:
    """Two-sided sign test, for samples whose ranks are not to be trusted."""
    tail = sum(comb(n, k) for k in range(min(plus, n - plus) + 1)) / 2**n
    return min(1.0, 2 * tail)


def adoption(df: DataFrame, track: str, answer: str, saved: str) -> DataFrame:
    """Counts and percentages of answers a track and over all (track null); blank answers stay in the denominator."""
    a, s = F.col(answer), F.col(saved)
    total = F.greatest(F.lit(1), F.count("*"))
    counts = [F.count_if(a == k).alias(k.lower()) for k in ("Yes", "Maybe", "No")]
    shares = [(100.0 * F.count_if(a == k) / total).alias(f"{k.lower()}_pct") for k in ("Yes", "Maybe", "No")]
    zero = F.when(F.count(s) > 0, 100.0 * F.count_if(s == 0) / F.count(s))
    return df.groupingSets([[track], []], track).agg(F.count("*").alias("total"), *counts, *shares, F.avg(s).alias("mean_time_saved"), F.count(s).alias("n_time_saved"), zero.alias("zero_time_pct"))
