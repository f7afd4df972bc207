"""The test tables read as evaluation records, and the same reading in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = """
SELECT d.doc_id AS id, d.lang AS model, d.source AS config, CAST(d.n_chars % 40 AS BIGINT) AS triples, CAST(d.n_chars % 7 AS BIGINT) AS classes, CAST(d.n_chars % 5 AS BIGINT) AS properties,
  CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 1 END AS consistent, CAST(d.doc_id % 4 AS BIGINT) AS important, CAST(d.doc_id % 3 AS BIGINT) AS critical, CAST(d.doc_id % 4 + d.doc_id % 3 + d.doc_id % 2 AS BIGINT) AS total,
  CASE WHEN d.doc_id % 10 = 0 THEN 'unavailable' WHEN d.doc_id % 10 = 1 THEN 'failed' ELSE 'scanned' END AS state,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE (d.doc_id % 11) / 10.0E0 END AS pass_rate, d.doc_id % 9 <> 0 AS parsed,
  CASE WHEN l.toxic IS NULL THEN NULL ELSE l.toxic = 1 END AS truncated, CASE WHEN d.doc_id % 13 = 0 THEN 'timeout' END AS error
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
R = f"WITH r AS ({RECORDS}) "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read(spark, sf_dir, "documents").drop("text"), read(spark, sf_dir, "labels")
    k, n = F.col("doc_id"), F.col("n_chars")
    return d.join(l, "doc_id", "left").select(
        k.alias("id"), F.col("lang").alias("model"), F.col("source").alias("config"), (n % 40).alias("triples"), (n % 7).alias("classes"), (n % 5).alias("properties"),
        (F.col("quality") == 1).alias("consistent"), (k % 4).alias("important"), (k % 3).alias("critical"), (k % 4 + k % 3 + k % 2).alias("total"),
        F.when(k % 10 == 0, "unavailable").when(k % 10 == 1, "failed").otherwise("scanned").alias("state"), F.when(k % 6 != 0, (k % 11) / 10.0).alias("pass_rate"), (k % 9 != 0).alias("parsed"),
        (F.col("toxic") == 1).alias("truncated"), F.when(k % 13 == 0, "timeout").alias("error"),
    )


def catalogue() -> tuple[dict, dict, callable]:
    """Queries, their SQL, and the decorator that fills both."""
    queries, oracles = {}, {}

    def add(name: str, sql: str | None):
        def wrap(f):
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return wrap

    return queries, oracles, add
