"""Incremental upserts: micro-batches of new records replace older ones of their key. An extension; the rest is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import carry_over


def upsert(spark: SparkSession, batch: DataFrame, target: str, version: int, keys: list[str]) -> str:
    """Write version ``version`` of the table at ``target``: the batch, and what the version before holds besides. Repeating a version gives the same table."""
    new = batch.dropDuplicates(keys)
    path = f"{target}/v={version}"
    old = f"{target}/v={version - 1}"
    if version > 0:
        new = carry_over(new, spark.read.parquet(old).drop("record_origin"), keys)
    else:
        new = new.withColumn("record_origin", F.lit("this_run"))
    new.write.mode("overwrite").parquet(path)
    return path


def upsert_stream(spark: SparkSession, source: str, schema: T.StructType | str, target: str, keys: list[str], checkpoint: str):
    """A query that upserts each micro-batch of Parquet files; offsets and version numbers make it repeatable after a loss."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: upsert(spark, df, target, n, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_version(query) -> int:
    """The last version that a finished upsert query wrote in this run; -1 if it found nothing new."""
    return max([p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0], default=-1)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums a window and type; ``ts`` has no zone in the tables, so it is cast before the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
