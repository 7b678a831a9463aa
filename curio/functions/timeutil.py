"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_instant(c: Column, dtype: T.DataType) -> Column:
    """A ``TIMESTAMP`` instant: wall-clock ``TIMESTAMP_NTZ`` values are read
    as UTC (a cast would read them in the session time zone, which shifts
    windows and is ambiguous across daylight-saving changes)."""
    if isinstance(dtype, T.TimestampNTZType):
        secs = F.date_format(c, "ss.SSSSSS").cast("decimal(8,6)")
        return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                                secs, F.lit("UTC"))
    return c.cast("timestamp")


def epoch_micros(c: Column, dtype: T.DataType) -> Column:
    return F.unix_micros(utc_instant(c, dtype))
