"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, drop_path, scratch_path, table
from . import decontam, license_scan, line_dedup, near_dup, packing, quality_rules, sharding, suffix_dedup, suffix_trees, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), error_share=0.1)


def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.remove_later(table(spark, sf_dir, "documents"), min_words=50).drop("spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path, least_revisit_bytes=0)
    page = F.get("metadata", F.lit(0))["fields"]
    records = cut(warc.read_records(spark, path).drop("payload"))
    drop_path(spark, path)
    captures = warc.assemble(records).select(
        "capture_id", "type", "refers_to", "response",
        F.get(F.filter(page, lambda x: x["key"] == "page-id"), F.lit(0))["value"].try_cast("long").alias("metadata"),
    )
    own = F.col("response")
    whole = F.when(F.col("type") == "revisit", F.col("original.response")).otherwise(own)
    return warc.resolve_revisits(cut(captures)).select(
        F.col("metadata").alias("page_id"),
        whole["payload_bytes"].alias("payload_bytes"),
        whole["payload_digest"].alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("original.metadata")).alias("refers_to"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.remove_copied(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), tokenizer_path(), window=2048, with_ids=False)
    return packing.pack(cut(pieces), capacity=2048)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8).drop("node")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return sharding.shard_rows(docs, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, window=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_suffix_trees, op3_warc, op4_license_scan, op5_line_dedup, op6_packing, op7_jaccard_join, op8_quality_rules, op9_sharding, op10_suffix_array)}
