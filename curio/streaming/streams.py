"""Structured Streaming versions of the scoring and metric roll-ups.

* ``score_stream`` (J1): the same column expressions as the batch scorer on
  a stream of texts -- stateless, one pass.
* ``windowed_metrics`` (J2): mean and count per key per event-time window
  (tumbling, or sliding with ``slide``); with a watermark, rows later than the
  watermark are dropped and, in append mode, a window is emitted once it is
  final.
* ``stream_ema`` (J3): the training-loop EMA carried across micro-batches in
  state (``applyInPandasWithState``): two numbers per run and, where rows may come out
  of order, those that the watermark hasn't passed. Many runs share a group of state,
  as a call into Python costs far more than a row.

``run_available_now`` drives a query over everything present in the source
(``trigger(availableNow=True)``) to a Parquet sink with its checkpoint, which
is how the same code runs as a scheduled incremental job.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curio.functions.metrics import score_texts
from curio.functions.timeutil import utc_instant
from curio.operators.trainlog import EMA_DECAY, EMA_START, EMA_WEIGHT


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None
                ) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(stream: DataFrame, text: str = "text", **kw) -> DataFrame:
    """Metric columns added to a stream of texts."""
    return score_texts(stream, text, **kw)


def windowed_metrics(stream: DataFrame, ts: str, keys: Sequence[str], value: str,
                     window: str, slide: str | None = None, watermark: str | None = "1 hour"
                     ) -> DataFrame:
    """``(window_start, window_end, *keys, mean_value, n)`` per event-time
    window."""
    s = stream.withColumn("__ts", utc_instant(F.col(ts), stream.schema[ts].dataType))
    if watermark:
        s = s.withWatermark("__ts", watermark)
    w = F.window("__ts", window, slide) if slide else F.window("__ts", window)
    return s.groupBy(w.alias("w"), *keys).agg(
        F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
        "mean_value", "n")


# Groups of state that the runs of a stream are dealt to. A call into Python costs
# the same for a row as for thousands, so a call takes the rows of many runs.
RUN_GROUPS = 256
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _filled(c: Column, kind: str) -> Column:
    """Whole numbers without nulls, which pandas would turn into floats."""
    return F.coalesce(c, F.lit(0).cast(kind)) if kind in _WHOLE else c


def _as_text(c: Column, kind: str) -> Column:
    """A key as text: empty for null, else a mark and what ``_from_text`` reads."""
    shown = F.base64(c) if kind == "binary" else (F.unix_micros(c) if kind == "timestamp" else c).cast("string")
    return F.coalesce(F.concat(F.lit("="), shown), F.lit(""))


def _from_text(c: Column, kind: str) -> Column:
    shown = F.when(c != "", F.substring(c, F.lit(2), F.length(c)))
    if kind == "binary":
        return F.unbase64(shown)
    return F.timestamp_micros(shown.cast("bigint")) if kind == "timestamp" else shown.cast(kind)


def stream_ema(stream: DataFrame, run: str, ts: str, id_col: str, value: str,
               decay: float = EMA_DECAY, start: int = EMA_START,
               weight: float = EMA_WEIGHT, delay: str | None = None, groups: int = RUN_GROUPS) -> DataFrame:
    """``(run, iter, ema)`` per incoming row; ``iter`` counts the run's rows
    in (ts, id) order across micro-batches. A null or NaN value leaves the mean as it is.

    With ``delay`` rows may come out of order: a row is given out, with its
    ``id_col``, once the watermark (the latest time seen, less ``delay``) has passed it, and rows
    that come later than that are dropped: none can come before a row given out, so its
    place in the run is final. What the watermark hasn't passed stays in the
    state, which holds two numbers per run and the rows of the last ``delay``. Rows
    without a time are left out. Without ``delay`` rows are expected in order across
    batches (a training log is appended in order) and come out at once.

    The runs are dealt to ``groups`` groups of state by a hash; a call takes a group's
    runs, and a micro-batch rewrites the state of the groups it has rows of. More runs
    than a task can hold call for more groups; a checkpoint keeps the number it began with."""
    fields = stream.schema
    kind = {c: fields[c].dataType.simpleString() for c in (run, id_col, ts)}
    timed = isinstance(fields[ts].dataType, (T.TimestampType, T.TimestampNTZType))
    time = utc_instant(F.col(ts), fields[ts].dataType)
    at, at_kind = (F.unix_micros(time), "bigint") if timed or delay is not None else (F.col(ts), kind[ts])
    rows = stream.select(
        _as_text(F.col(run), kind[run]).alias("__run"), _filled(F.col(id_col), kind[id_col]).alias("__id"),
        F.col(id_col).isNull().alias("__no_id"), _filled(at, at_kind).alias("__at"), at.isNull().alias("__no_at"),
        F.col(value).cast("double").alias("__x"), *([] if delay is None else [time.alias("__ts")]))
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("__run"), F.lit(groups)).cast("int"))
    if delay is not None:
        rows = rows.where("__ts is not null").withWatermark("__ts", delay)
    order = ["__no_at", "__at", "__no_id", "__id"]
    columns = [*order, "__run", "__x"]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        runs, its, means, *held = state.get if state.exists else ([],) * 8
        tails = dict(zip(runs, zip(its, means)))
        frames = [pd.DataFrame({"__no_at": False, **dict(zip(columns[1:], held))})] if held[0] else []
        if delay is None or not state.hasTimedOut:
            frames += [b[columns] for b in batches]
        found = pd.concat(frames, ignore_index=True).sort_values(order, kind="stable")
        passed = None if delay is None else state.getCurrentWatermarkMs()
        ready = len(found) if passed is None else int((found["__at"] <= passed * 1000).sum()) if passed > 0 else 0
        now, later = found.iloc[:ready], found.iloc[ready:]
        iters, emas = [], []
        for r, x in zip(now["__run"].tolist(), now["__x"].tolist()):
            it, e = tails.get(r, (0, None))
            if it >= start and x == x:
                e = x if e is None else decay * e + weight * x
            iters.append(it)
            emas.append(e)
            tails[r] = (it + 1, e)
        state.update((list(tails), [it for it, _ in tails.values()], [e for _, e in tails.values()],
                      *(later[c].tolist() for c in columns[1:])))
        if len(later):
            # fires once the watermark is beyond it: as soon as the first row may go
            state.setTimeoutTimestamp(max(-(-int(later["__at"].iloc[0]) // 1000) - 1, passed, 1))
        if ready:
            yield pd.DataFrame({"__run": now["__run"], "__id": now["__id"], "__no_id": now["__no_id"], "iter": iters, "ema": emas})

    out = rows.groupBy("__group").applyInPandasWithState(
        update, f"__run string, __id {kind[id_col]}, __no_id boolean, iter long, ema double",
        "runs array<string>, iters array<long>, emas array<double>, "
        f"at array<{at_kind}>, no_ids array<boolean>, ids array<{kind[id_col]}>, held array<string>, xs array<double>",
        "append", GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout)
    shown = [_from_text(F.col("__run"), kind[run]).alias(run), "iter", "ema"]
    return out.select(*shown, *([] if delay is None else [F.when(~F.col("__no_id"), F.col("__id")).alias(id_col)]))


def run_available_now(sdf: DataFrame, sink: str, checkpoint: str, output_mode: str = "append",
                      timeout_s: float | None = None) -> None:
    """Process everything available, write Parquet, stop. ``complete`` mode
    (full aggregate every batch) overwrites the sink in ``foreachBatch``."""
    if output_mode == "complete":
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(sink)
        q = sdf.writeStream.outputMode("complete").foreachBatch(write) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = sdf.writeStream.outputMode(output_mode).format("parquet") \
            .option("path", sink).option("checkpointLocation", checkpoint) \
            .trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise q.exception()
