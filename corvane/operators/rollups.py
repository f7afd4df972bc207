"""Roll-ups by model and configuration. Every mean comes with its denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_means(value: Column, name: str) -> list[Column]:
    """``<name>_available`` leaves missing values out, ``<name>_all`` counts them as 0, ``n_<name>`` is the first's denominator."""
    return [F.avg(value).alias(f"{name}_available"), F.avg(F.coalesce(value, F.lit(0.0))).alias(f"{name}_all"), F.count(value).alias(f"n_{name}")]


def three_valued(flag: Column, name: str) -> list[Column]:
    """Counts of true, false and unknown; unknown is never folded into false."""
    return [F.count_if(flag).alias(f"n_{name}"), F.count_if(~flag).alias(f"n_not_{name}"), F.count_if(flag.isNull()).alias(f"n_{name}_unknown")]


def sample_spread(value: Column) -> Column:
    """Sample standard deviation: 0 for one value, null for none."""
    return F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))


def ranked(df: DataFrame, score: str, by: list[str], tie: str, digits: int = 4) -> DataFrame:
    """``rk``: place by the rounded score, downwards, then by ``tie`` upwards."""
    w = Window.partitionBy(*by).orderBy(F.round(score, digits).desc(), F.col(tie))
    return df.withColumn("rk", F.row_number().over(w).cast("long"))


def crosstab(df: DataFrame, row: str, column: str, value: str, names: list | None = None) -> DataFrame:
    """Mean of ``value`` by row and column; given ``names`` spare a pass over the data."""
    g = df.groupBy(row)
    return (g.pivot(column, names) if names else g.pivot(column)).agg(F.avg(value))


def weighted_mean(mean: Column, n: Column) -> Column:
    return F.sum(mean * n) / F.greatest(F.lit(1), F.sum(n))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows a group."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("k") <= k)


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks from 1, upwards, with the mean rank for ties."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)


def missing_cells(facts: DataFrame, rows: str, columns: str) -> DataFrame:
    """Pairs of a known row and a known column without a fact. The column's values are few by contract: at most 1,000."""
    names = facts.select(columns).distinct()
    if names.limit(1001).count() > 1000:
        raise ValueError("too many columns for a table of cells")
    wanted = facts.select(rows).distinct().withColumn(columns, F.explode(F.array(*[F.lit(r[0]) for r in names.collect()])))
    return wanted.join(facts.select(rows, columns).distinct(), [rows, columns], "left_anti")
