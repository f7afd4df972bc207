"""Roll-ups and rankings by model and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES = {}

_RANKING = """
WITH b AS (SELECT d.lang model, d.source config, l.quality q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT model, config, CAST(GROUPING(config) AS BIGINT) AS lvl, count(*) AS n, count(q) AS n_available,
        avg(CAST(q AS DOUBLE)) AS mean_available, avg(CAST(coalesce(q, 0) AS DOUBLE)) AS mean_all
      FROM b GROUP BY GROUPING SETS ((model), (model, config)))
SELECT model, config, lvl, n, n_available, round(mean_available, 9) AS mean_available, round(mean_all, 9) AS mean_all,
       CAST(row_number() OVER (PARTITION BY lvl, config ORDER BY round(mean_all, 4) DESC, model) AS BIGINT) AS rk FROM g
"""


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over available and over all rows with their denominators, by model and by model and configuration, ranked."""
    views(spark, sf_dir, "documents", "labels")
    return spark.sql(_RANKING)


QUERIES["agg_ranking_blocks"] = ranking
ORACLES["agg_ranking_blocks"] = _RANKING
