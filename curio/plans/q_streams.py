"""Queries for the streaming operators (J1-J3): the driver tables are copied
to a file source (several files, read one per micro-batch where state
matters) and processed to completion with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.functions.timeutil import utc_instant
from curio.plans import sql as S
from curio.plans.q_trainlog import _EV
from curio.plans.registry import query
from curio.session import scratch_path
from curio.sources import table
from curio.streaming import streams as st

FK, DIV = "flesch_kincaid_grade", "vocabulary_diversity"
N_FILES = 4
# Rank error of the cuts between arrivals: exact ones would hold every value on the
# driver. No row comes later than the watermark, wherever the cuts lie.
CUT_ERROR = 0.001


def _source(df, name, order_col, cluster_col=None):
    """Copy ``df`` to a file source as ``N_FILES`` appends in ``order_col``
    order (the file source takes files by modification time, so the appends
    arrive in the order a log is written). With ``cluster_col`` the files of
    one append hold disjoint keys, so their relative order does not matter to
    per-key state."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    cuts = df.approxQuantile(order_col, [i / N_FILES for i in range(1, N_FILES)], 0.0)
    bounds = [None] + sorted(set(cuts)) + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(order_col) > lo)
        if hi is not None:
            part = part.filter(F.col(order_col) <= hi)
        part = part.repartition(N_FILES, cluster_col) if cluster_col else part
        part.sortWithinPartitions(order_col).write.mode("append").parquet(path)
    return path, df.schema


@query("score_stream", f"""WITH {S.text_stats_cte()}
SELECT doc_id, round({S.FK}, 6) AS {FK}, round({S.DIV}, 6) AS {DIV} FROM st""")
def q_score_stream(spark, sf):
    src, schema = _source(table(spark, sf, "documents").select("doc_id", "text"), "docs-src", "doc_id")
    s = st.score_stream(st.read_stream(spark, src, schema), "text", metrics=[FK, DIV])
    sink = scratch_path(spark, "scored-stream")
    st.run_available_now(s.select("doc_id", FK, DIV), sink, scratch_path(spark, "ckpt-score"))
    return spark.read.parquet(sink)


@query("windowed_metrics", """
SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, event_type,
       round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2""")
def q_windowed_metrics(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    src, schema = _source(ev, "events-src", "event_id")
    w = st.windowed_metrics(st.read_stream(spark, src, schema, 1), "ts", ["event_type"], "value",
                            "1 day", watermark="1 hour")
    sink = scratch_path(spark, "windows")
    st.run_available_now(w, sink, scratch_path(spark, "ckpt-windows"), "complete")
    return spark.read.parquet(sink).select(
        F.unix_seconds("window_start").alias("window_start"),
        "event_type", "mean_value", "n")


@query("stream_ema", f"""WITH RECURSIVE {_EV},
r AS (SELECT run, iter, loss AS e FROM ev WHERE iter = 5
      UNION ALL
      SELECT ev.run, ev.iter, 0.9 * r.e + 0.1 * ev.loss FROM r JOIN ev ON ev.run = r.run AND ev.iter = r.iter + 1)
SELECT ev.run, ev.iter, round(r.e, 6) AS ema FROM ev LEFT JOIN r ON ev.run = r.run AND ev.iter = r.iter""")
def q_stream_ema(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "value")
    src, schema = _source(ev, "log-src", "event_id", "run")
    e = st.stream_ema(st.read_stream(spark, src, schema, 1), "run", "ts", "event_id", "value")
    sink = scratch_path(spark, "ema-stream")
    st.run_available_now(e, sink, scratch_path(spark, "ckpt-ema"))
    return spark.read.parquet(sink)


DELAY = "1 day"


def _runs_of_arrivals(spark, sf, name, columns, build):
    """The events in order of arrival, a hash of their id deciding by how many
    hours (under a day) each comes late, in ``N_FILES`` appends; after each the same
    job runs on what is new, as a scheduled job does. ``build``: stream -> stream."""
    ev = table(spark, sf, "events").select("event_id", "ts", *columns)
    hours = F.pmod(F.hash("event_id"), F.lit(24))
    arrival = F.unix_micros(utc_instant(F.col("ts"), ev.schema["ts"].dataType)) + hours * 3_600_000_000
    ev = ev.withColumn("arrival", arrival)
    src, sink, state = (scratch_path(spark, f"{name}-{x}") for x in ("src", "sink", "state"))
    cuts = [None] + sorted(set(ev.approxQuantile("arrival", [i / N_FILES for i in range(1, N_FILES)], CUT_ERROR))) + [None]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = ev if lo is None else ev.where(F.col("arrival") > lo)
        part = part if hi is None else part.where(F.col("arrival") <= hi)
        part.write.mode("append").parquet(src)
        st.run_available_now(build(st.read_stream(spark, src, ev.schema)), sink, state)
    return spark.read.parquet(sink)


@query("windowed_metrics_append", """
SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, event_type,
       round(avg(value), 6) AS mean_value, count(*) AS n FROM events
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)
GROUP BY 1, 2""")
def q_windowed_metrics_append(spark, sf):
    """Append mode over rows out of order: each window once, when the watermark
    has passed its end; the windows it hasn't passed are still state."""
    out = _runs_of_arrivals(spark, sf, "late-windows", ("event_type", "value"), lambda s: st.windowed_metrics(
        s, "ts", ["event_type"], "value", "1 day", watermark=DELAY))
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "mean_value", "n")


@query("stream_ema_late", f"""WITH RECURSIVE {_EV},
r AS (SELECT run, iter, loss AS e FROM ev WHERE iter = 5
      UNION ALL
      SELECT ev.run, ev.iter, 0.9 * r.e + 0.1 * ev.loss FROM r JOIN ev ON ev.run = r.run AND ev.iter = r.iter + 1)
SELECT ev.run, ev.event_id, ev.iter, round(r.e, 6) AS ema FROM ev LEFT JOIN r ON ev.run = r.run AND ev.iter = r.iter
WHERE ev.ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
def q_stream_ema_late(spark, sf):
    """The mean over rows that come out of order, up to the last watermark."""
    return _runs_of_arrivals(spark, sf, "late-log", (F.col("user_id").alias("run"), "value"), lambda s: st.stream_ema(
        s, "run", "ts", "event_id", "value", delay=DELAY)).select("run", "event_id", "iter", "ema")
