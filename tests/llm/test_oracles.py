"""The SQL of op5 and op6 on tables that hold what the given ones don't."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from curio.llm.queries import ORACLE, QUERIES


def both(spark, tmp_path, query, name, table):
    """Rows of a query and of its SQL over one table."""
    pq.write_table(table, tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    df = QUERIES[query](spark, str(tmp_path))
    sql = con.execute(ORACLE[query])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(df.columns)
    return [sorted(map(repr, rows)) for rows in ([tuple(r) for r in df.select(*names).collect()], sql.fetchall())]


def test_sharding(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "é" * 5000, "a\nb"] + ["".join(rng.choice("aé漢 \n") for _ in range(rng.randrange(300))) for _ in range(300)]
    mine, want = both(spark, tmp_path, "op5_sharding", "documents", pa.table({"doc_id": range(len(texts)), "text": texts}))
    assert mine == want


def test_url_filter_with_links(spark, tmp_path):
    rng = random.Random(6)
    hosts = ["example.com", "www.example.com", "a.net", "M.b.org", "c.org:443", "d.org"]
    url = lambda: f"https://{rng.choice(hosts)}/{rng.choice(['en/', 'es/', 'fr/x', 'q'])}{rng.choice(['', '?a=1', '?utm_x=2&b=1', '#f'])}"
    link = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv=refresh content="0;url={}">']
    rows = [(i, url(), "<p>x" + "".join(rng.choice(link).format(url().replace("&", "&amp;")) for _ in range(rng.choice([0, 0, 0, 1, 2]))))
            for i in range(40)] + [(40, None, None), (41, "no scheme", "<p>"), (42, url(), None)]
    ids, urls, html = zip(*rows)
    for first in (0, 20):  # with and without the first pages' links
        table = pa.table({"page_id": ids[first:], "url": urls[first:], "html": html[first:]})
        mine, want = both(spark, tmp_path, "op6_url_filter", "pages", table)
        assert mine == want
