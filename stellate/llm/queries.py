"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.llm import counts, decontam, html, langid, merkle, negatives, packing, quality, simhash, sql, suffix, token_output, urls, warc
from stellate.llm.common import fresh_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output.write_tokens(_read(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), end_id=0)
    table = token_output.read_tokens(spark, out)
    return token_output.with_starts(token_output.with_crc(table), table).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"), floor=suffix.FLOOR, digest=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.one_more(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(_read(spark, sf_dir, "embeddings")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.read_archives(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_quality_rules, op3_packing, op4_url_filters, op5_simhash_near_dedup, op6_suffix_array_dedup, op7_token_counts, op8_language_id, op9_html_extraction, op10_decontamination, op11_merkle_manifest, op12_hard_negatives, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": sql.OP2, "op4_url_filters": sql.OP4, "op6_suffix_array_dedup": sql.OP6, "op10_decontamination": sql.OP10, "op11_merkle_manifest": sql.OP11, "op12_hard_negatives": sql.OP12, "op13_warc": sql.OP13}
