"""The corpus pipeline: quality rules, near-dedup, substring dedup, benchmark
decontamination, BPE encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``. Nulls in any column are allowed; a row with a null
id is judged by its text. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import bpe, decontaminate, near_dedup, quality_rules, substring_dedup
from curio.llm.queries import table, vocab_path
from curio.session import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule or learned rule rejects."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.keep(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows that share an id but
    not the text are told apart."""
    return near_dedup.keep(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and the runs of 50 words or more that
    stand before."""
    return substring_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text. A
    column of ``docs`` with the name of a new one gives way to it."""
    new = ("token_ids", "n_tokens", "round_trip")
    kept = docs.drop(*new)
    both = bpe.encode_decode(kept, vocab_path(), ids_col="token_ids", decoded_col="__decoded")
    same = F.col("__decoded") == F.coalesce(F.col("text"), F.lit(""))
    return both.select(*kept.columns, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeats),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

ORACLE_SQL = None  # learned rules, near-duplicate groups and BPE are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written goes once the next
    one's result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(docs)
        docs = done
    return docs
