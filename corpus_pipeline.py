"""From raw documents to packed sequences: quality rules, line dedup, near duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, line_dedup, near_dup, packing, quality_rules
from quarry.llm.queries import tokenizer_path
from quarry.runtime import cut, drop_path, scratch_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that five or more of them share, but for the last holder's."""
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    return near_dup.keep_one(docs, n=5, threshold=0.8).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), error_share=0.1).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    pieces = packing.tokenise(docs, tokenizer_path(), window=2048, with_ids=False)
    return packing.pack(cut(pieces), capacity=2048)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: MinHash, edit distance, byte-pair encoding and best-fit packing have no SQL; tests/llm has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again.

    What a stage wrote goes when the next one has written; the last one keeps its pieces in a checkpoint.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop_path(spark, before)
    return packed
