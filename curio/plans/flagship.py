"""Flagship: how do the text metrics of what has been consumed evolve over
checkpoints when documents are fed easiest first?

documents -> metrics (words, diversity, Flesch-Kincaid) -> written scored
table (cuts lineage: later passes read two numbers per row, not the text) ->
90/10 split in table order -> global order by grade -> cumulative checkpoint
means (B=8, G=4, checkpoint every 5 iterations) -> long curves -> min-max
normalisation per metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.functions.metrics import score_texts
from curio.operators.curves import normalize_minmax, to_long
from curio.operators.lineage import checkpoint_schedule, cumulative_checkpoint_means
from curio.operators.order import train_valid_split
from curio.operators.positions import SortKey, asc, assign_positions
from curio.session import materialize as materialize_table
from curio.sources import table

# --- fixed values -----------------------------------------------------------
BATCH_SIZE = 8
GRAD_ACCUM = 4
EVAL_INTERVAL = 5
FLAGSHIP_METRICS = ("flesch_kincaid_grade", "vocabulary_diversity")
# ---------------------------------------------------------------------------


def scored_documents(spark: SparkSession, sf: str, metrics=FLAGSHIP_METRICS,
                     extra=(), materialize: bool = True, **kw) -> DataFrame:
    """``(id, *extra, *metrics)`` per document, materialised as Parquet in the
    shared checkpoint folder: the several passes of the ordering read the
    small scored table (only the columns each pass needs) instead of
    re-scoring text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", *extra)
    s = score_texts(d, "text", metrics=metrics, **kw).drop("text")
    if materialize:
        s = materialize_table(s, "scored")
    return s


def ordered_train(scored: DataFrame, key: SortKey) -> tuple[DataFrame, int]:
    """Train rows with their position in ``key`` order, and their count
    (``int(0.9 * n)``, known from the split -- no extra pass)."""
    n = scored.count()
    train = train_valid_split(scored, "train", "id", n=n)
    n_train = int(0.9 * n)
    return assign_positions(train, [key], "id", "pos", n=n_train), n_train


def curriculum_means(spark: SparkSession, scored: DataFrame, key: SortKey,
                     metrics=FLAGSHIP_METRICS) -> DataFrame:
    ordered, n_train = ordered_train(scored, key)
    ckpts = checkpoint_schedule(spark, n_train, BATCH_SIZE, GRAD_ACCUM, EVAL_INTERVAL)
    return cumulative_checkpoint_means(ordered, ckpts, list(metrics), BATCH_SIZE, GRAD_ACCUM,
                                       EVAL_INTERVAL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_documents(spark, sf)
    means = curriculum_means(spark, scored, asc("flesch_kincaid_grade"))
    long = to_long(means, ["ckpt", "n_rows"], list(FLAGSHIP_METRICS))
    return normalize_minmax(long, "value", ["metric"]).select(
        "ckpt", "metric", "n_rows", "value", "norm")
