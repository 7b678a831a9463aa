"""Declared schemas of the tables the operators read and write (no schema
inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

from curio.functions.metrics import METRIC_COLUMNS

_METRICS = [T.StructField(m, T.DoubleType()) for m in METRIC_COLUMNS]

STORIES = T.StructType([T.StructField("shard", T.StringType()), T.StructField("pos", T.IntegerType()),
                        T.StructField("story", T.StringType())])
TOKENS = T.StructType([T.StructField("id", T.LongType()),
                       T.StructField("tokens", T.ArrayType(T.IntegerType()))])
SCORED = T.StructType(TOKENS.fields + _METRICS)
LINEAGE = T.StructType([T.StructField("run", T.StringType()), T.StructField("ckpt", T.IntegerType()),
                        T.StructField("batch_no", T.LongType()), T.StructField("id", T.LongType())])
OUTPUTS = T.StructType([T.StructField("run", T.StringType()),
                        T.StructField("checkpoint_name", T.IntegerType()),
                        T.StructField("text", T.StringType())] + _METRICS)
CURVES = T.StructType([T.StructField("run", T.StringType()), T.StructField("side", T.StringType()),
                       T.StructField("ckpt", T.LongType()), T.StructField("metric", T.StringType()),
                       T.StructField("value", T.DoubleType()), T.StructField("norm", T.DoubleType())])
EMBEDDINGS = T.StructType([T.StructField("run", T.StringType()), T.StructField("ckpt", T.IntegerType()),
                           T.StructField("token_id", T.IntegerType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])
ATTENTION = T.StructType([T.StructField("run", T.StringType()), T.StructField("ckpt", T.IntegerType()),
                          T.StructField("layer", T.IntegerType()), T.StructField("sample", T.IntegerType()),
                          T.StructField("head", T.IntegerType()), T.StructField("q_pos", T.IntegerType()),
                          T.StructField("weights", T.ArrayType(T.FloatType()))])
TRAIN_LOG = T.StructType([T.StructField("run", T.StringType()), T.StructField("iter", T.LongType()),
                          T.StructField("split", T.StringType()), T.StructField("loss", T.DoubleType()),
                          T.StructField("lr", T.DoubleType()), T.StructField("dt_ms", T.DoubleType()),
                          T.StructField("mfu", T.DoubleType())])
VOCAB = T.StructType([T.StructField("token_id", T.IntegerType()), T.StructField("piece", T.StringType()),
                      T.StructField("score", T.FloatType()), T.StructField("n_bytes", T.IntegerType())])
LEXICON = T.StructType([T.StructField("word", T.StringType()), T.StructField("polarity", T.DoubleType()),
                        T.StructField("subjectivity", T.DoubleType())])
LOGITS = T.StructType([T.StructField("group_key", T.LongType()), T.StructField("item_id", T.LongType()),
                       T.StructField("logit", T.DoubleType())])
CHAT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
