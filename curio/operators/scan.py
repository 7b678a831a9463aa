"""Segmented prefix scans: an index, running sums (or exclusive-ors) and seeded
exponential means of the rows of each group, in an order.

One range shuffle on ``(group, order)`` sorts the rows, so a group of any size
lies over as many neighbouring partitions as it needs and a million small groups
share a few. One Arrow pass scans each partition by itself: an associative
operator is applied at doubling distances inside each group (numpy, no loop over
rows). Its rows are written once with the number of their partition. The summary
has one row a partition: the state at its end, the state at the end of its first
group, and whether both are one group. An exclusive scan of these (as many rows
as there are partitions, whatever the data) gives what enters each partition, and
only rows of a partition's first group take it in.

Results: a null value adds nothing to a sum or exclusive-or and passes a mean on unchanged; before
a group's first value the mean is null. Null and NaN group keys are groups like
any other (as in ``groupBy``). Rows that tie in the whole order may stand in either
order; give an id as the last key. An empty table gives an empty table.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


@dataclass(frozen=True)
class RunningSum:
    """Inclusive running sum of ``col`` (long for whole numbers, else double)."""
    col: str


@dataclass(frozen=True)
class RunningXor:
    """Inclusive running exclusive-or of the long column ``col``."""
    col: str


@dataclass(frozen=True)
class RunningMean:
    """``e = decay * e + weight * x``, seeded by the group's first value."""
    col: str
    decay: float
    weight: float


def _changed(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the row before; nulls are
    equal to each other, and so are NaNs."""
    if pa.types.is_floating(column.type):
        nan = pc.fill_null(pc.is_nan(column), False)
        column = pc.if_else(nan, pa.scalar(None, column.type), column)
        marks = [column, nan]
    else:
        marks = [column]
    out = np.zeros(len(column) - 1, bool)
    for c in marks:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        null_a, null_b = pc.is_null(a), pc.is_null(b)
        same = pc.or_(pc.and_(null_a, null_b), pc.fill_null(pc.equal(a, b), False))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def _sums(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Running sums inside segments; ``place`` is the index in the segment."""
    if x.dtype == np.int64:
        total = np.cumsum(x)
        return total - (total - x)[np.arange(len(x)) - place]
    x, step, last = x.copy(), 1, int(place.max())
    while step <= last:
        at = np.flatnonzero(place >= step)
        x[at] += x[at - step]
        step *= 2
    return x


def _xors(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    total = np.bitwise_xor.accumulate(x)
    return total ^ (total ^ x)[np.arange(len(x)) - place]


def _means(x: np.ndarray, known: np.ndarray, decay: float, weight: float, place: np.ndarray):
    """Composed maps inside segments: ``(a, b)`` for a mean that enters the
    segment, ``s`` for none (defined where ``has``)."""
    a, b = np.where(known, decay, 1.0), np.where(known, weight * x, 0.0)
    s, has = np.where(known, x, 0.0), known.copy()
    step, last = 1, int(place.max())
    while step <= last:
        at = np.flatnonzero(place >= step)
        a1, b1, s1, h1 = a[at - step], b[at - step], s[at - step], has[at - step]
        s[at] = np.where(h1, a[at] * s1 + b[at], s[at])
        b[at] = a[at] * b1 + b[at]
        a[at] = a[at] * a1
        has[at] = h1 | has[at]
        step *= 2
    return a, b, s, has


STEPS = 64


def _first_steps(s, has, x, known, decay: float, weight: float, begins: np.ndarray, entering: float | None) -> None:
    """The first ``STEPS`` values of every segment, one step at a time over all
    segments at once, so that short runs have the recursion's own rounding.
    ``entering``: the mean that goes into the first segment."""
    sizes = np.diff(np.append(begins, len(x)))
    now, there = np.zeros(len(begins)), np.zeros(len(begins), bool)
    if entering is not None:
        now[0], there[0] = entering, True
    for t in range(min(STEPS, int(sizes.max()))):
        go = np.flatnonzero(sizes > t)
        at = begins[go] + t
        new = np.where(known[at], np.where(there[go], decay * now[go] + weight * x[at], x[at]), now[go])
        there[go] |= known[at]
        now[go] = new
        s[at], has[at] = new, there[go]


class _Part:
    """The scan of one partition, batch after batch. The state of a sum is its
    value; that of a mean is ``(a, b, s)``, with ``s`` None before a value."""

    def __init__(self, groups: list[str], scans: list[tuple]):
        self.groups, self.scans = groups, scans
        self.key: pa.RecordBatch | None = None
        self.lead, self.row = True, 0
        self.state: list = [None] * len(scans)

    def __call__(self, batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        new = np.zeros(n, bool)
        for g in self.groups:
            new[1:] |= _changed(batch.column(g))
            if self.key is not None:
                new[0] |= _changed(pa.concat_arrays([self.key.column(g), batch.column(g).slice(0, 1)]))[0]
        begins = new.copy()
        begins[0] = True
        index = np.arange(n)
        place = index - np.maximum.accumulate(np.where(begins, index, 0))
        first = int(np.argmax(new[1:])) + 1 if new[1:].any() else n
        went_on = first if self.key is not None and not new[0] else 0
        self.lead = self.lead and not new[0]
        out = [pa.array(self.row + index), pa.array(self.lead & (index < first))]
        for k, (kind, at, decay, weight) in enumerate(self.scans):
            before = self.state[k]
            if kind == "mean":
                column = batch.column(at).cast(pa.float64())
                x = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                a, b, s, has = _means(x, known, decay, weight, place)
                if went_on:
                    cut = slice(0, went_on)
                    if before[2] is not None:
                        s[cut] = a[cut] * before[2] + b[cut]
                        has[cut] = True
                    b[cut] += a[cut] * before[1]
                    a[cut] *= before[0]
                _first_steps(s, has, x, known, decay, weight, np.flatnonzero(begins), before[2] if went_on else None)
                out += [pa.array(s, mask=~has), pa.array(a), pa.array(b)]
                self.state[k] = (float(a[-1]), float(b[-1]), float(s[-1]) if has[-1] else None)
                continue
            if kind == "index":
                x = np.ones(n, np.int64)
            else:
                x = pc.fill_null(batch.column(at).cast(pa.float64() if kind == "real" else pa.int64()), 0).to_numpy(
                    zero_copy_only=False)
            y = _xors(x, place) if kind == "xor" else _sums(x, place)
            if went_on and kind == "xor":
                y[:went_on] ^= before
            elif went_on:
                y[:went_on] += before
            out.append(pa.array(y))
            self.state[k] = y[-1]
        self.lead = self.lead and first == n
        self.key = batch.slice(n - 1, 1).select(self.groups)
        self.row += n
        return out


def _same(a, b) -> bool:
    return all(x == y or (x is None and y is None) or (x != x and y != y) for x, y in zip(a, b))


def _entering(parts, groups: list[str], scans: list[tuple]) -> list[tuple]:
    """``(partition, value...)`` for each partition whose first group began in
    an earlier one; ``parts`` are the summary rows in order."""
    out, tail, state = [], None, None
    for p in parts:
        head = tuple(p["head"][g] for g in groups)
        came = state if tail is not None and _same(head, tail) else None
        if came is not None:
            out.append((p["part"], *came))
        end = [p["tail"][f"y{k}"] for k in range(len(scans))]
        if came is not None and p["single"]:
            for k, (kind, *_) in enumerate(scans):
                if kind == "xor":
                    end[k] ^= came[k]
                elif kind != "mean":
                    end[k] += came[k]
                elif came[k] is not None:
                    end[k] = p["tail"][f"a{k}"] * came[k] + p["tail"][f"b{k}"]
        tail, state = tuple(p["tail"][g] for g in groups), end
    return out


def segmented_scan(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
                   scans: dict[str, RunningSum | RunningXor | RunningMean] | None = None,
                   idx_col: str | None = None) -> DataFrame:
    """``df`` with one column per scan and, if named, the 0-based index of each
    row in its group. ``order`` are sort expressions (``col.asc_nulls_last()``,
    ...). ``df`` is read twice (once for the sample of the range shuffle)."""
    groups = list(groups)
    asked: list[tuple] = [("index", None, 0.0, 0.0)] if idx_col else []
    names = [idx_col] if idx_col else []
    for name, s in (scans or {}).items():
        kind = "mean" if isinstance(s, RunningMean) else "xor" if isinstance(s, RunningXor) else (
            "whole" if isinstance(df.schema[s.col].dataType, _WHOLE) else "real")
        asked.append((kind, s.col, getattr(s, "decay", 0.0), getattr(s, "weight", 0.0)))
        names.append(name)
    keep = [f for f in df.schema.fields if f.name not in names]
    fields = [T.StructField("__part", T.IntegerType()), T.StructField("__row", T.LongType()),
              T.StructField("__lead", T.BooleanType())]
    for k, (kind, *_) in enumerate(asked):
        real = kind in ("mean", "real")
        fields.append(T.StructField(f"__y{k}", T.DoubleType() if real else T.LongType()))
        if kind == "mean":
            fields += [T.StructField(f"__a{k}", T.DoubleType()), T.StructField(f"__b{k}", T.DoubleType())]
    schema = T.StructType(keep + fields)
    kept = [f.name for f in keep]
    keys = [F.col(g).asc_nulls_last() for g in groups] + list(order)
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches):
        part, number = _Part(groups, asked), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                new = part(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [pa.array(np.full(batch.num_rows, number, np.int32)), *new],
                    schema.names)

    done = materialize(rows.mapInArrow(run, schema), "scan")
    ends = [F.col(f"__{v}{k}").alias(f"{v}{k}") for k, (kind, *_) in enumerate(asked)
            for v in (("y", "a", "b") if kind == "mean" else ("y",))]
    one = F.lit(1).alias("one")
    parts = done.groupBy(F.col("__part").alias("part")).agg(
        F.min_by(F.struct(one, *groups), "__row").alias("head"),
        F.max_by(F.struct(one, *groups, *ends), "__row").alias("tail"),
        F.bool_and("__lead").alias("single")).collect()
    come = _entering(sorted(parts, key=lambda p: p["part"]), groups, asked)
    types = [T.DoubleType() if kind in ("mean", "real") else T.LongType() for kind, *_ in asked]
    # one row a partition at most, whatever the data
    carry = F.broadcast(df.sparkSession.createDataFrame(come, T.StructType(
        [T.StructField("__part", T.IntegerType())] + [T.StructField(f"__c{k}", t) for k, t in enumerate(types)])))
    if not come:
        joined = done.withColumns({f"__c{k}": F.lit(None).cast(t) for k, t in enumerate(types)})
    else:
        joined = done.join(carry, "__part", "left")
    out = []
    for k, (kind, *_) in enumerate(asked):
        y, c = F.col(f"__y{k}"), F.col(f"__c{k}")
        late = F.col("__lead") & c.isNotNull()
        if kind == "mean":
            out.append(F.when(late, F.col(f"__a{k}") * c + F.col(f"__b{k}")).otherwise(y).alias(names[k]))
        else:
            full = F.when(late, y.bitwiseXOR(c) if kind == "xor" else y + c).otherwise(y)
            out.append((full - 1 if kind == "index" else full).alias(names[k]))
    return joined.select(*kept, *out)
