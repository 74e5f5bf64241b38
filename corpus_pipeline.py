"""A training corpus from raw documents: five stages, each a table that the next one reads.

Every stage but the last returns the columns of ``documents``. Rows that agree in doc_id and text are
one document: what a stage decides holds for both, and the near-duplicate stage keeps one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsync.llm import decontam, linededup, packing, simhash, toxicity
from recordsync.llm._common import free_name, materialise, tokenizer_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of toxicity under one half; all where none is labelled."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    prefix = "p_"
    while {f"{prefix}toxic", f"{prefix}low_quality"} & set(docs.columns):
        prefix += "_"
    scored = toxicity.toxic_scores(docs, docs, labels, prefix=prefix)
    return scored.where(F.coalesce(F.col(f"{prefix}toxic") < 0.5, F.lit(True))).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; one whose words all go, goes."""
    lines, dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out = linededup.deduplicate(docs, counts=(lines, dropped))
    out = out.where((F.col(dropped) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word 5-grams, similarity 0.8."""
    return simhash.deduplicate(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models, alignment and tokenizers have no SQL; tests/llm hold the operators and the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
