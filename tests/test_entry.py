import os
import sys

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert [f.name for f in df.schema.fields] == ["ckpt", "metric", "n_rows", "value", "norm"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


def test_oracle_matches_on_small_tables(spark):
    """A handful of queries against DuckDB on the sf0.001 tables."""
    import duckdb
    from curio.sources.tables import TABLES
    from conftest import SF001
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from check_oracle import rows_of
    for name in ["score_texts", "flagship", "nucleus_filter", "ema", "cross_checkpoint_similarity"]:
        sc, sr = rows_of(E.queries()[name](spark, SF001).toPandas())
        oc, orr = rows_of(con.execute(E.oracle_sql()[name]).df())
        assert sc == oc, name
        assert sr == orr, name


def test_query_rounding_matches_oracle_engine_on_ties(spark):
    """Values with a tie at the seventh decimal (k/128, k/640) round the same
    way in the registered queries' last projection and in the SQL engine."""
    import duckdb
    from pyspark.sql import functions as F
    from curio.plans.registry import round_digits
    vals = [k / 128 for k in range(-300, 300)] + [k / 640 for k in range(1, 700)] + [-1e-9, 0.0]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["r"] for r in df.select(round_digits(F.col("x")).alias("r")).collect()]
    con = duckdb.connect()
    exp = [r[0] for r in con.execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS x)",
                                     [vals]).fetchall()]
    assert got == exp
