"""The composed jobs: shards to token table, token table to scored table, and the
two tables of a checkpoint evaluation (I11). Each writes its result as Parquet and
returns it as a scan; nothing passes through the driver."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.functions.metrics import registered_metrics, score_texts
from curio.functions.text import strip
from curio.functions.tokens import pad_truncate, parse_token_string
from curio.operators.lineage import cumulative_checkpoint_means
from curio.operators.order import assign_dense_ids
from curio.operators.positions import asc
from curio.operators.tokenizer import decode_tokens, encode_texts
from curio.session import discard, materialize
from curio.sources import io

# --- fixed values -----------------------------------------------------------
SEQ_LENGTH = 128
TOKEN_SCHEMA = "id bigint, tokens array<int>"
# ---------------------------------------------------------------------------


def pretokenize(spark: SparkSession, directory: str, vocab: DataFrame, path: str,
                length: int | None = SEQ_LENGTH, max_shards: int | None = None,
                first_id: int = 0, glob: str = "*.json") -> DataFrame:
    """``(id, tokens)`` of all stories of the JSON shards under ``directory``: stripped,
    encoded with a begin id, cut or padded with 0 to ``length`` (``None``: left
    as they are). Ids are dense from ``first_id`` in (shard name, place in shard)
    order. A null or empty story is its begin id alone. The stories are encoded
    before they are ordered, so the range shuffle moves tokens, not text; they are
    written, as ordering reads its input twice."""
    stories = io.read_json_shards(spark, directory, max_shards, glob).select(
        F.struct("shard", "pos").alias("place"), strip("story").alias("story"))
    ids = F.col("ids") if length is None else pad_truncate("ids", length)
    rows = encode_texts(spark, stories, vocab, "place", "story").select(
        "place.shard", "place.pos", ids.alias("tokens"))
    rows = materialize(rows, "encoded")
    dense = assign_dense_ids(rows, [asc("shard")], "pos")
    discard(rows)
    io.write_table(dense.select((F.col("id") + F.lit(first_id)).cast("bigint").alias("id"), "tokens"), path, ())
    discard(dense)
    return io.read_scored_table(spark, path, TOKEN_SCHEMA)


def compute_metadata(tokens: DataFrame, vocab: DataFrame, path: str, tokens_col: str = "tokens",
                     metrics: Iterable[str] | None = None, **scoring) -> DataFrame:
    """``tokens`` with the metric columns of its decoded texts. Tokens may be
    arrays or their printed form (``"[1 2 3]"``). The metrics are functions of the
    row, so they stay on it: what would be a join on the id needs no shuffle, and
    rows with equal ids stay apart. A null array scores as an empty text; columns
    of ``tokens`` that have a metric's name are replaced."""
    ids = "__ids"
    parsed = parse_token_string(tokens_col) if isinstance(tokens.schema[tokens_col].dataType, T.StringType) \
        else F.col(tokens_col)
    texts = decode_tokens(tokens.withColumn(ids, parsed), vocab, ids, out="__decoded")
    wanted = tuple(metrics) if metrics is not None else registered_metrics()
    kept = [c for c in tokens.columns if c not in wanted]
    scored = score_texts(texts, "__decoded", metrics=wanted, **scoring).select(*kept, *wanted)
    io.write_table(scored, path, ())
    return io.read_scored_table(tokens.sparkSession, path, scored.schema)


def evaluate_checkpoints(generations: DataFrame, positions: DataFrame, ckpts: DataFrame,
                         metrics: Iterable[str], batch_size: int, grad_accum: int, step: int,
                         ckpt_col: str = "ckpt", text: str = "text", path: str | None = None,
                         **scoring) -> dict[str, DataFrame]:
    """The input and the output side of a run's checkpoints. ``output``: mean
    metrics of the texts that each checkpoint generated; ``input``: mean metrics of
    the scored rows (``positions``, with their ``pos``) that it has consumed. With
    ``path`` both are written below it. A checkpoint without generations has no
    output row; one that has consumed nothing has nulls."""
    metrics = list(metrics)
    scored = score_texts(generations.select(ckpt_col, text), text, metrics=metrics, **scoring)
    out = scored.groupBy(F.col(ckpt_col).cast("bigint").alias("ckpt")).agg(*[F.avg(m).alias(m) for m in metrics])
    inp = cumulative_checkpoint_means(positions, ckpts, metrics, batch_size, grad_accum, step).select("ckpt", *metrics)
    sides = {"input": inp, "output": out}
    if path is None:
        return sides
    spark = positions.sparkSession
    for name, side in sides.items():
        io.write_table(side, f"{path.rstrip('/')}/{name}", ())
    return {name: io.read_scored_table(spark, f"{path.rstrip('/')}/{name}", side.schema) for name, side in sides.items()}
