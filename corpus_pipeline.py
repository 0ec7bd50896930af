"""The corpus pipeline: documents through five stages, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flawsieve.llm.decontamination import find_leaks
from flawsieve.llm.line_dedup import apply_bitmaps, drop_bitmaps
from flawsieve.llm.near_dedup import near_duplicates
from flawsieve.llm.packing import pack
from flawsieve.llm.quality_rules import judge_quality, trusted_documents
from flawsieve.llm.shared import staged

# The columns of documents; others of the same table are not carried.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near duplicates: shingles of five words that agree to 80 % or more.
SIMILAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the quality model. Null and empty texts go."""
    trusted = trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs.select(*COLUMNS), trusted).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more have.

    ``n_chars`` follows the text; documents of nothing but such lines go.
    """
    found = apply_bitmaps(docs.select(*COLUMNS), drop_bitmaps(docs))
    kept = found.filter("n_dropped = 0 OR trim(kept_text) <> ''")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id and text, of each group of near duplicates; of its repeated rows, one.

    Different texts under one id are different documents.
    """
    found = near_duplicates(docs, SIMILAR_PERCENT).filter("first AND doc_id IS NOT NULL")
    first = found.select("doc_id", F.col("mark").alias("_mark")).distinct()
    known = docs.select(*COLUMNS).withColumn("_mark", F.xxhash64("text")).join(first, ["doc_id", "_mark"], "left_semi")
    nameless = docs.select(*COLUMNS).filter("doc_id IS NULL")  # no id, so no duplicate of any
    return known.dropDuplicates(["doc_id", "_mark"]).select(*COLUMNS).unionByName(nameless)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark was found."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = staged(leaks.select("doc_id").distinct(), "leaks")
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

# Signatures, random walks and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
