"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from veridale.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query(spark, small, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    res = con.execute(q.ORACLE_SQL[name])
    columns = [d[0] for d in res.description]
    df = q.QUERIES[name](spark, small)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, res.fetchall())) == sorted(repr(tuple(r)) for r in df.select(columns).collect())


def test_url_sql_follows_links(spark, tmp_path):
    """On pages with links of all kinds, since the generated ones have none."""
    own, to = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://bad.example.org/es/1", None), (2, "http://a.net/x?q=1#f", own.format("http://a.net/x?q=1") + to.format("http://bad.example.org/es/1")), (3, "HTTP://B.net/y/z", own.format("../x") + own.format("//a.net/x?q=1")),
        (4, "http://c.net/z", to.format("/w&amp;v")), (5, "http://c.net/w&v", own.format("http://ok.org/")), (6, "http://ok.org/", own.format("http://bad.com/de/2")), (7, "http://bad.com/de/2", ""), (8, None, own.format("http://a.net/x")), (9, "no scheme", None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    res = con.execute(q.ORACLE_SQL["op7_url_filters"])
    columns = [d[0] for d in res.description]
    want = sorted(map(repr, res.fetchall()))
    got = q.QUERIES["op7_url_filters"](spark, folder).select(columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow"}
    assert len({r.component for r in got if r.component}) == 2
