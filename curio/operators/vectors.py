"""Embedding and attention analytics.

Design points for scale:

* Element-wise sums/means of vectors (centroids) are ``posexplode`` +
  ``groupBy(keys, idx)``: partial aggregation combines map-side, each group
  has at most ``dim`` entries when re-assembled.
* The mean cosine over all checkpoint pairs uses
  ``sum_{i<j} u_i.u_j = (|sum u|^2 - sum |u|^2) / 2`` for unit vectors ``u``:
  linear in the rows, no pairs are generated.
* The similarity matrices (C5/I3) compare *group-level* vectors (one per
  layer / checkpoint) by an equi-join on the group and blocks of items; their
  number is not bounded.
* PCA: centred moments per partition (numpy inside ``mapInPandas``), merged in a
  tree of two levels, so that no frame holds one partial per partition; a d x d
  eigen-solve per group, then the projection as a JVM expression.
* Wide PCA: block subspace iteration, two joins and two sums a round; only a
  b x b matrix per group (b: components and a few more) is ever solved.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.functions.vectors import as_double, dot, l2_normalize
from curio.operators._util import row_count_at_most
from curio.session import discard, materialize

ITEMS_PER_BLOCK = 512
MERGES = 256          # partials of a group after the first merge
SPARE_AXES = 8


def has_artifact(df: DataFrame, col: str) -> DataFrame:
    """Rows (checkpoints) whose artefact column is present."""
    return df.filter(F.col(col).isNotNull() & (F.size(col) > 0))


def attention_slice(att: DataFrame, sample: int = 0) -> DataFrame:
    """One sample, every layer and head, one row per attention weight
    ``(layer, head, q_pos, k_pos, w)``."""
    return att.filter(F.col("sample") == sample).select(
        "layer", "head", "q_pos", F.posexplode("weights").alias("k_pos", "w")) \
        .withColumn("k_pos", F.col("k_pos").cast("bigint"))


def centroids(df: DataFrame, keys: Sequence[str], vec: str = "embedding",
              out: str = "centroid") -> DataFrame:
    """Element-wise mean vector per group of ``keys``."""
    ex = df.select(*keys, F.posexplode(as_double(vec)).alias("idx", "x"))
    per = ex.groupBy(*keys, "idx").agg(F.avg("x").alias("x"))
    return per.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"])
        .alias(out))


def pairwise_similarity(items: DataFrame, key: str, vec: str,
                        group_cols: Sequence[str] = (),
                        max_items: int | None = None) -> DataFrame:
    """Cosine matrix between group-level vectors, long form
    ``(*group_cols, i, j, cos)``; zero vectors are dropped. Computed on the
    triangle ``i <= j`` and mirrored. Items are dealt into blocks by a hash of
    their key, as many as the largest group needs for ``ITEMS_PER_BLOCK`` in each, and
    a pair of blocks of a group is one key of the join, so any number of items is
    spread over tasks. A caller may bound the items
    (``max_items``); more are then an error."""
    if max_items is not None and not row_count_at_most(items, max_items):
        raise ValueError(f"more than {max_items} items; similarity matrices are for "
                         "group-level vectors (aggregate first)")
    g = list(group_cols)
    u = items.select(*g, F.col(key).alias("i"), l2_normalize(vec).alias("u")) \
        .filter(F.col("u").isNotNull())
    most = u.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // ITEMS_PER_BLOCK))
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = u.select("*", block.alias("block_i"), every.alias("block_j")).alias("a")
    b = u.select(*g, F.col("i").alias("j"), F.col("u").alias("v"), block.alias("block_j"),
                 every.alias("block_i")).alias("b")
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*g, "block_i", "block_j"]] + [
        F.col("a.i") <= F.col("b.j")]
    tri = a.join(b, cond).select(*[F.col(f"a.{c}").alias(c) for c in g], "i", "j",
                                 dot(F.col("u"), F.col("v")).alias("cos"))
    mirror = tri.filter(F.col("i") != F.col("j")).select(*g, F.col("j").alias("i"),
                                                         F.col("i").alias("j"), "cos")
    return tri.unionByName(mirror)


def cross_checkpoint_similarity(df: DataFrame, layer: str, ckpt: str, vec: str,
                                n_paths: int | None = None) -> DataFrame:
    """Per layer, the mean cosine over all checkpoint pairs i < j, divided
    by E(E-1)/2 where E counts every checkpoint (zero vectors contribute 0).
    ``df`` holds one vector per (layer, checkpoint) -- the original vectors,
    or with ``pca_space`` the per-checkpoint 2-D coordinates."""
    u = df.select(layer, ckpt, l2_normalize(vec).alias("u"))
    e = u.groupBy(layer).agg(F.countDistinct(ckpt).alias("E"))
    if n_paths is not None:
        e = e.withColumn("E", F.lit(n_paths).cast("bigint"))
    nz = u.filter(F.col("u").isNotNull())
    sums = nz.select(layer, F.posexplode("u").alias("idx", "x")) \
        .groupBy(layer, "idx").agg(F.sum("x").alias("s"))
    sq = sums.groupBy(layer).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    cnt = nz.groupBy(layer).agg(F.count(F.lit(1)).alias("k"))
    r = e.join(sq, layer, "left").join(cnt, layer, "left").fillna(0, subset=["ss", "k"])
    pairs = F.col("E") * (F.col("E") - 1) / 2
    return r.select(layer, F.col("E").cast("bigint").alias("n_checkpoints"),
                    F.when(pairs > 0, (F.col("ss") - F.col("k")) / 2 / pairs)
                    .alias("mean_cosine"))


# ---- PCA --------------------------------------------------------------------

def _merged_moments(a, b):
    """Count, mean and centred second moments of two parts together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def pca_2d(df: DataFrame, group_col: str, vec: str, id_col: str, k: int = 2) -> DataFrame:
    """Centre and project every vector on the top-``k`` principal axes of
    its group (e.g. checkpoint). Output ``(group, id, pc1..pck)``. Sign: per
    component, the row with the largest |projection| is positive (ties: lowest
    id). Null vectors take no part in the fit and have null coordinates."""
    gtype = df.schema[group_col].dataType.simpleString()
    src = df.select(F.col(group_col).alias("g"), as_double(vec).alias("v"))

    def partial(it):
        acc: dict = {}
        for pdf in it:
            for g, part in pdf.groupby("g", sort=False, dropna=False):
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                mean = x.mean(0)
                own = (len(x), mean, (x - mean).T @ (x - mean))
                key = None if g != g else g
                acc[key] = _merged_moments(acc[key], own) if key in acc else own
        yield frame([(g, TaskContext.get().partitionId() % MERGES, *m) for g, m in acc.items()])

    def frame(rows):
        return pd.DataFrame([{"g": g, "b": b, "n": n, "m": m.tolist(), "ss": ss[np.triu_indices(len(m))].tolist()}
                             for g, b, n, m, ss in rows], columns=["g", "b", "n", "m", "ss"])

    def joined(pdf: pd.DataFrame):
        parts = []
        for n, m, ss in zip(pdf["n"], pdf["m"], pdf["ss"]):
            full = np.zeros((len(m), len(m)))
            full[np.triu_indices(len(m))] = ss
            parts.append((int(n), np.asarray(m), full + np.triu(full, 1).T))
        return reduce(_merged_moments, parts)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame([(pdf["g"].iloc[0], 0, *joined(pdf))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, ss = joined(pdf)
        w, vecs = np.linalg.eigh(ss / max(n - 1, 1))
        axes = [vecs[:, i].tolist() for i in np.argsort(w)[::-1][:k]]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "mean": [mean.tolist()], "comps": [axes + [[0.0] * len(mean)] * (k - len(axes))]})

    schema = f"g {gtype}, b int, n long, m array<double>, ss array<double>"
    parts = src.where("v is not null").mapInPandas(partial, schema)
    axes = parts.groupBy("g", "b").applyInPandas(merge, schema).groupBy("g").applyInPandas(
        solve, f"g {gtype}, mean array<double>, comps array<array<double>>")
    j = df.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), as_double(vec).alias("v")) \
        .join(axes.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left")
    centred = F.zip_with(F.col("v"), F.col("mean"), lambda a, b: a - b)
    proj = j.select("g", "id", *[dot(centred, F.element_at("comps", i + 1)).alias(f"pc{i + 1}")
                                 for i in range(k)])
    # sign convention, one small aggregate per group
    signs = proj.groupBy("g").agg(*[
        F.max_by(F.signum(F.col(f"pc{i + 1}")),
                 F.struct(F.abs(F.col(f"pc{i + 1}")), -F.col("id"))).alias(f"s{i + 1}")
        for i in range(k)])
    out = proj.join(signs.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left").select(
        F.col("g").alias(group_col), F.col("id").alias(id_col),
        *[(F.col(f"pc{i + 1}") * F.when(F.col(f"s{i + 1}") < 0, -1.0).otherwise(1.0))
          .alias(f"pc{i + 1}") for i in range(k)])
    return out


def pca_wide(elements: DataFrame, item: str = "item", pos: str = "pos", value: str = "value",
             k: int = 2, group_cols: Sequence[str] = (), spare: int = SPARE_AXES,
             tol: float = 1e-8, max_rounds: int = 300, block: int | None = None) -> DataFrame:
    """PCA of very long vectors given as elements ``(item, pos, value)``
    (missing positions are 0, repeated ones add up), fitted separately per
    ``group_cols`` (e.g. one fit per checkpoint). Coordinates are ``U * sqrt(lambda)``,
    each component's largest entry positive (ties: the lowest item).

    Block subspace iteration on the centred items, ``X' = JX``: a round
    multiplies ``b = k + spare`` directions by ``X'^T`` (a join on the item, sums by
    position) and by ``X'`` (a join on the position, sums by item); J only takes the
    means off the directions. The new directions are made orthonormal by a b x b
    eigen-solve per group, largest first. It ends when the residual ``|Gq - lambda
    q|`` of the first k is below ``tol`` of the largest lambda (or after
    ``max_rounds``); with at most b items that is the second round. Neither items nor
    positions are bounded and no task sees a group. (``block`` has no effect.)"""
    g = [f"__g{i}" for i in range(len(group_cols))]
    names = [F.col(c).alias(a) for c, a in zip(group_cols, g)]
    el = materialize(elements.select(*names, F.col(item).alias("item"), F.col(pos).cast("bigint").alias("pos"),
                                     F.col(value).cast("double").alias("x")), "elements")
    b = k + spare
    q = [f"q{i}" for i in range(b)]
    z = [f"z{i}" for i in range(b)]
    start = [(F.pmod(F.xxhash64("item", F.lit(i)), F.lit(1 << 20)).cast("double") / (1 << 19) - 1).alias(q[i]) for i in range(b)]
    now = materialize(el.select(*g, "item").distinct().select(*g, "item", *start), "directions")
    one = F.lit(1).alias("__one")
    keys = [*g, "__one"]
    pairs = [(i, j) for i in range(b) for j in range(i, b)]
    types = "".join(f"{a} {el.schema[a].dataType.simpleString()}, " for a in g)

    def turn(it):
        """What makes the directions of a group orthonormal: column means, a
        matrix, and the size of each new direction."""
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                n, mean = r["n"], np.array([r[f"s{i}"] for i in range(b)]) / r["n"]
                c = np.zeros((b, b))
                for i, j in pairs:
                    c[i, j] = c[j, i] = r[f"c{i}_{j}"] - n * mean[i] * mean[j]
                w, v = np.linalg.eigh(c)
                w, v = w[::-1], v[:, ::-1]
                good = w > max(w[0], 0.0) * 1e-13
                m = np.where(good, v / np.sqrt(np.where(good, w, 1.0)), 0.0)
                rows.append({**{a: r[a] for a in g}, "mean": mean.tolist(), "m": m.ravel().tolist(),
                             "size": np.sqrt(np.where(good, w, 0.0)).tolist()})
            yield pd.DataFrame(rows, columns=[*g, "mean", "m", "size"])

    def matched(left, right, on):
        renamed = right.select(*[F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in right.columns])
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"r_{c}"))
        return left.join(renamed, cond).drop(*[f"r_{c}" for c in on])

    def orthonormal(df, cols):
        moments = df.select(*g, one, *cols).groupBy(*keys).agg(
            F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)],
            *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"c{i}_{j}") for i, j in pairs])
        turns = moments.mapInPandas(turn, f"{types}mean array<double>, m array<double>, size array<double>")
        joined = matched(df.withColumn("__one", one), turns.withColumn("__one", one), keys)
        new = [sum((((F.col(c) - F.col("mean")[i]) * F.col("m")[i * b + j]) for i, c in enumerate(cols)), F.lit(0.0)).alias(q[j])
               for j in range(b)]
        return joined.select(*g, "item", *new, "size")

    now = materialize(orthonormal(now, q), "directions")
    for _ in range(max_rounds):
        here = now.drop("size")
        y = matched(el, here, [*g, "item"]).groupBy(*g, "pos").agg(*[F.sum(F.col("x") * F.col(c)).alias(f"y{i}") for i, c in enumerate(q)])
        image = matched(el, y, [*g, "pos"]).groupBy(*g, "item").agg(*[F.sum(F.col("x") * F.col(f"y{i}")).alias(z[i]) for i in range(b)])
        both = materialize(matched(here, image, [*g, "item"]), "images")
        # residuals of the directions that went in, with their own Rayleigh quotients
        facts = [e for i in range(k) for e in (F.sum(F.col(q[i]) * F.col(z[i])).alias(f"l{i}"), F.sum(F.col(z[i]) ** 2).alias(f"zz{i}"),
                                               F.sum(F.col(z[i])).alias(f"zs{i}"), F.sum(F.col(q[i]) ** 2).alias(f"qq{i}"))]
        fit = both.select(*g, one, *q, *z).groupBy(*keys).agg(F.count("*").alias("n"), *facts)
        gone = [F.col(f"zz{i}") - F.col(f"zs{i}") ** 2 / F.col("n") - F.col(f"l{i}") ** 2 * F.col(f"qq{i}") for i in range(k)]
        top = F.greatest(*[F.abs(F.col(f"l{i}")) for i in range(k)]) if k > 1 else F.abs(F.col("l0"))
        worst = F.greatest(F.lit(0.0), *gone)
        off = fit.agg(F.max(F.sqrt(worst) / F.greatest(top, F.lit(1e-300)))).first()[0] or 0.0
        after = materialize(orthonormal(both.drop(*q), z), "directions")
        for done in (now, both):
            discard(done)
        now = after
        if off <= max(tol, 3e-8):      # the sums themselves are no more exact than that
            break
    raw = now.select(*g, "item", *[(F.col(q[i]) * F.sqrt(F.col("size")[i])).alias(f"pc{i + 1}") for i in range(k)])
    up = raw.withColumn("__one", one).groupBy(*keys).agg(*[F.min_by(F.signum(f"pc{i + 1}"), F.struct(
        (-F.round(F.abs(f"pc{i + 1}"), 9)).alias("size"), "item")).alias(f"up{i + 1}") for i in range(k)])
    signed = matched(raw.withColumn("__one", one), up, keys)
    return signed.select(*[F.col(a).alias(c) for a, c in zip(g, group_cols)], F.col("item").alias(item), *[
        (F.col(f"pc{i + 1}") * F.when(F.col(f"up{i + 1}") < 0, -1.0).otherwise(1.0)).alias(f"pc{i + 1}") for i in range(k)])


def pca_space(elements: DataFrame, layer: str, ckpt: str, pos: str, value: str) -> DataFrame:
    """The reference's space for C6: each checkpoint's layers placed in 2-D
    by a PCA fitted on that checkpoint alone -> ``(layer, ckpt, coords)``."""
    p = pca_wide(elements, layer, pos, value, group_cols=[ckpt])
    return p.select(layer, ckpt, F.array("pc1", "pc2").alias("coords"))
