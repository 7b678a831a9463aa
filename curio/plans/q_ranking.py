"""Queries for the group-wise ranking operators (E8, E9, F8, F9, I8, I9) on
revenue per customer, grouped by nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from curio.operators import ranking as rk
from curio.operators._util import broadcast_if_small
from curio.plans.registry import query
from curio.session import ensure_checkpoint_dir
from curio.sources import table

TOPP = 0.5
TOP_K = 3
TEMPERATURE = 1.0


def revenue(spark, sf):
    """``(nation, cust, logit, coin)``: log revenue per customer. Line items
    are summed per order before the join (less data through the shuffle)."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_cust = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey") \
        .agg(F.sum("rev").alias("revenue"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    r = per_cust.join(broadcast_if_small(c), per_cust.o_custkey == c.c_custkey)
    return r.select(F.col("c_nationkey").cast("bigint").alias("nation"),
                    F.col("o_custkey").alias("cust"), F.log("revenue").alias("logit"),
                    ((F.col("c_nationkey") * 37 % 100) / 100.0).alias("coin"))


def shares(spark, sf):
    """Softmax shares, materialised once (a reliable checkpoint in the shared
    checkpoint folder; every pass reads all of its few columns): the ranking
    operators make several passes over them, which would otherwise each re-run
    the three-table revenue join."""
    ensure_checkpoint_dir(spark)
    rev = revenue(spark, sf).checkpoint(eager=True)
    return rk.group_softmax(rev, "nation", "logit", TEMPERATURE, "p").checkpoint(eager=True)


_REV = """
r AS (SELECT CAST(c.c_nationkey AS BIGINT) AS nation, o.o_custkey AS cust,
             sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue, (c.c_nationkey * 37 % 100) / 100.0 AS coin
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
      GROUP BY 1, 2, 4),
s AS (SELECT *, ln(revenue) AS logit FROM r),
e AS (SELECT *, exp(logit / 1.0 - max(logit / 1.0) OVER (PARTITION BY nation)) AS ex FROM s),
sp AS (SELECT *, ex / sum(ex) OVER (PARTITION BY nation) AS p FROM e)"""

_NUC = f"""{_REV},
cr AS (SELECT *, count(*) OVER (PARTITION BY nation) AS n FROM sp),
cp AS (SELECT * FROM cr WHERE n <= 1 OR p >= (1.0 - {TOPP}) / (n - 1)),
oc AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY p DESC, cust) - 1 AS idx,
              sum(p) OVER (PARTITION BY nation ORDER BY p DESC, cust ROWS UNBOUNDED PRECEDING) AS cum FROM cp),
kept AS (SELECT * FROM oc WHERE cum - p <= {TOPP})"""


@query("group_softmax", f"WITH {_REV} SELECT nation, cust, round(p, 6) AS p FROM sp")
def q_group_softmax(spark, sf):
    return shares(spark, sf).select("nation", "cust", "p")


@query("nucleus_filter", f"""WITH {_NUC}
SELECT nation, cust, idx, round(p, 6) AS p, round(cum, 6) AS cum FROM kept""")
def q_nucleus_filter(spark, sf):
    return rk.nucleus_filter(shares(spark, sf), "nation", "cust", "p", TOPP).select(
        "nation", "cust", "idx", "p", "cum")


@query("top_k_per_group", f"""WITH {_REV},
rk AS (SELECT nation, cust, rank() OVER (PARTITION BY nation ORDER BY logit DESC) AS rank FROM s)
SELECT nation, cust, rank FROM rk WHERE rank <= {TOP_K}""")
def q_top_k_per_group(spark, sf):
    return rk.top_k_per_group(revenue(spark, sf), "nation", "logit", TOP_K, "cust").select(
        "nation", "cust", "rank")


@query("argmax_per_group", f"""WITH {_REV}
SELECT nation, arg_max(cust, struct_pack(l := logit, c := -cust)) AS cust, round(max(logit), 6) AS logit
FROM s GROUP BY nation""")
def q_argmax_per_group(spark, sf):
    return rk.argmax_per_group(revenue(spark, sf), "nation", "logit", "cust")


@query("weighted_sample", f"""WITH {_REV},
c AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY cust) AS i,
             sum(p) OVER (PARTITION BY nation ORDER BY cust ROWS UNBOUNDED PRECEDING) AS cdf FROM sp),
hit AS (SELECT nation, arg_min(cust, i) FILTER (WHERE coin < cdf) AS h, arg_max(cust, i) AS last FROM c GROUP BY nation)
SELECT nation, coalesce(h, last) AS cust FROM hit""")
def q_weighted_sample(spark, sf):
    return rk.weighted_sample(shares(spark, sf), "nation", "cust", "p", "coin")


@query("nucleus_sample", f"""WITH {_NUC},
mass AS (SELECT nation, max(cum) AS m FROM kept GROUP BY nation),
hit AS (SELECT k.nation, arg_min(k.cust, k.idx) FILTER (WHERE k.coin * mass.m < k.cum) AS h,
               arg_max(k.cust, k.idx) AS last
        FROM kept k JOIN mass ON k.nation = mass.nation GROUP BY k.nation)
SELECT nation, coalesce(h, last) AS cust FROM hit""")
def q_nucleus_sample(spark, sf):
    return rk.nucleus_sample(shares(spark, sf), "nation", "cust", "p", TOPP, "coin")
