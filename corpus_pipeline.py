"""From documents to a training mixture: quality rules, near-duplicates, repeated passages, benchmark passages, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, jaccard, mixing, quality_rules, simhash, substring
from framelake.llm.rows import Packed
from framelake.llm.store import cut, drop

# A stage hands its operator the columns that it needs and packs all others, so that no name of documents' clashes with the operator's own.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    packed = Packed(docs, text="text", lang="lang")
    return packed.unpack(quality_rules.judge(packed.df).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates by shingles."""
    return jaccard.keep_one(docs)


def fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash fingerprints, and of these one of each class of near-duplicates by shingles, whose fingerprints mostly differ in more than four bits."""
    kept = simhash.keep_one(docs)
    out = near_duplicates(spark, kept, sf_dir)  # has written kept
    drop(kept)
    return out


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that stand earlier; n_chars follows the text."""
    packed = Packed(docs, doc_id="doc_id", text="text", n_chars="n_chars")
    changed = F.col("n_removed") > 0
    text, n_chars = F.when(changed, F.col("kept_text")).otherwise(F.col("text")), F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return packed.unpack(substring.remove_repeats(packed.df), text=text, n_chars=n_chars)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    packed = Packed(docs, text="text")
    return packed.unpack(decontaminate.mark_contamination(packed.df, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, numbered by copy."""
    return mixing.copies_of(docs)


STAGES = [("quality_rules", quality), ("simhash", fingerprints), ("substring_dedup", repeats), ("decontamination", benchmark), ("mixing", mixture)]

#: SimHash and rounding at random are not expressible; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
