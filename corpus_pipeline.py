"""A training corpus from `documents`: quality rules, near-duplicate removal, removal of repeated passages, removal of
benchmark leaks, packing. Each stage works on all that its predecessor kept; the result of each is a Parquet table in
the shared folder, so that no stage is computed twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellate.llm import decontam, packing, quality, simhash, suffix
from stellate.llm.common import fresh_path, remove_path
from stellate.session import scratch

SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base counts or lose most of their lines; the others lose their frequent lines. A null
    or empty text has no words and is rejected; equal rows share their fate; a null source counts as the host ''."""
    return quality.apply_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies: wide fingerprints of five-word shingles give
    candidates, of which those that share 0.8 of their shingles are linked. Null and wordless texts are copies of each other;
    of repeated rows one stays."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE_WORDS, mode=simhash.WIDE, similarity=simhash.SIMILARITY)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of 200 bytes that occur again, so that passages of 50 words and more (about 300 bytes) are caught;
    documents of which nothing is left go. A null text stays null; equal rows repeat each other."""
    return suffix.cut_repeats(docs, length=suffix.FLOOR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item. Null and empty texts overlap nothing; without items all stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids. A null text is the end id alone; repeated rows are packed each. An empty
    table gives no rows, here and in the stages before; columns that clash with names used inside keep their values."""
    return packing.pack_documents(docs, ids_too=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]

#: Fingerprints, hashes of words and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage made for itself goes when its result is written, a stage's result when the
    next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
