"""Token-array column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curio.functions.text import WS_RUN, _col


def add_bos_eos(tokens, bos: int | None = 1, eos: int | None = 2) -> Column:
    """Optional begin/end ids around the tokens."""
    t = _col(tokens)
    parts = ([F.array(F.lit(bos))] if bos is not None else []) + [t] + \
        ([F.array(F.lit(eos))] if eos is not None else [])
    return F.concat(*parts) if len(parts) > 1 else t


def pad_truncate(tokens, length: int, pad: int = 0) -> Column:
    """Exactly ``length`` tokens, right-padded with ``pad``."""
    t = _col(tokens)
    return F.slice(F.concat(t, F.array_repeat(F.lit(pad), length)), 1, length)


def shift_pairs(tokens) -> tuple[Column, Column]:
    """``x = t[:-1]``, ``y = t[1:]``; empty for fewer than two tokens."""
    t = _col(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.slice(t, 1, n), F.slice(t, 2, n)


def parse_token_string(s) -> Column:
    """``"[1 2  3]"`` -> ``[1, 2, 3]``: drop the first and last
    character, split on whitespace, cast; any bad token gives ``[]``."""
    c = _col(s)
    inner = c.substr(F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    parts = F.filter(F.split(inner, WS_RUN), lambda p: p != "")
    ints = F.transform(parts, lambda p: p.try_cast("int"))
    bad = F.exists(ints, lambda x: x.isNull())
    return F.when(c.isNull(), F.array().cast("array<int>")).when(
        bad, F.array().cast("array<int>")).otherwise(ints)
