"""The corpus pipeline: stages over ``documents``, each written and reread as the next one's input.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of ``documents``. Edge cases
are those of the operators: null and empty texts fail the quality rules; rows without doc_id pass line dedup and the
near-duplicate stage unchanged; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _io
from corvane.llm.byte_bpe import default_ranks, encode
from corvane.llm.decontaminate import contaminated, decontaminate
from corvane.llm.jaccard_join import jaccard_components, small_side
from corvane.llm.line_dedup import line_dedup
from corvane.llm.quality_rules import quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).filter(F.col(_io.OWN + "kept")).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier passage of three lines."""
    return line_dedup(docs).withColumn("n_chars", F.when(F.col(_io.OWN + "n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8."""
    gone = jaccard_components(docs.select("doc_id", "text"), 5, 80).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small_side(_io.materialize(gone)), "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, _io.read(spark, sf_dir, "benchmark")).filter(~contaminated()).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; decoding them gives the text back, which the operator checks."""
    ids = F.col(_io.OWN + "ids")
    return encode(docs, default_ranks(), keep=["doc_id"]).select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]

#: The stages estimate, hash and tokenize; SQL cannot express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept, written and reread between stages."""
    docs = _io.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _io.materialize(docs)
    return docs
