"""Vector column functions (H17, H18, H20) as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curio.functions.text import _col

# --- fixed values -----------------------------------------------------------
INT8_MAX = 127.0
# ---------------------------------------------------------------------------


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v, norm: Column | None = None) -> Column:
    """Unit vector; null for a zero vector (callers drop those)."""
    n = l2_norm(v) if norm is None else norm
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n))


def cosine_similarity(a, b) -> Column:
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)


def group_size_for(dim: int, group_size: int) -> int:
    """The group size halves until it divides the dimension."""
    g = group_size
    while g > 1 and dim % g != 0:
        g //= 2
    return max(g, 1)


def quantize_groups(v, dim: int, group_size: int = 64) -> Column:
    """Symmetric int8 quantisation per group of ``g`` values:
    ``scale = max|x| / 127``, ``q = rint(x / scale)`` (half to even). An
    all-zero group has scale 0 and q 0. Returns ``struct(q array<int>,
    scale array<double>, group_size int)``."""
    g = group_size_for(dim, group_size)
    x = as_double(v)
    n_groups = F.ceil(F.size(x) / F.lit(g)).cast("int")  # the last group may be shorter
    groups = F.transform(F.sequence(F.lit(0), n_groups - 1),
                         lambda k: F.slice(x, k * g + 1, g))
    scales = F.transform(groups, lambda grp: F.array_max(F.transform(grp, F.abs)) / INT8_MAX)
    qs = F.zip_with(groups, scales, lambda grp, s: F.transform(
        grp, lambda y: F.when(s == 0, F.lit(0)).otherwise(F.rint(y / s).cast("int"))))
    return F.struct(F.flatten(qs).alias("q"), scales.alias("scale"), F.lit(g).alias("group_size"))


def dequantize_groups(qv: Column) -> Column:
    """Inverse of ``quantize_groups``: ``q * scale`` per group."""
    g = qv["group_size"]
    return F.transform(qv["q"], lambda q, i: q.cast("double")
                       * F.element_at(qv["scale"], F.floor(i / g).cast("int") + 1))


def max_abs_error(v, qv: Column) -> Column:
    """D8 per vector: max |x - dequantize(quantize(x))|."""
    return F.array_max(F.zip_with(as_double(v), dequantize_groups(qv),
                                  lambda a, b: F.abs(a - b)))
