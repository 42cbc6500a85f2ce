"""Registered queries against their SQL in DuckDB, on small tables that tell the two apart."""

import math

import duckdb
import pytest

from plumbline.plans.registry import QUERIES, SQL


def against_sql(spark, tmp_path, query, **tables):
    """Rows of a query and of its SQL on tables (SQL text each), both sorted; floats to six places."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for name, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    got, want = QUERIES[query](spark, str(tmp_path)), con.execute(SQL[query])
    assert got.columns == [c[0] for c in want.description]
    return plain(map(tuple, got.collect())), plain(want.fetchall())


def test_exported_roots(spark, tmp_path):
    """Lines that share order, part and number: the first of the file is "a", that of the largest quantity "b"."""
    lines = [(2, 7, 3, 19.0, 0.05), (2, 7, 3, 28.0, 0.06), (2, 5, 1, 90.0, 0.01), (3, 9, 1, 7.0, 0.04), (3, 9, 1, 41.0, 0.02), (3, 1, 5, 3.0, 0.03), (4, 8, 3, None, 0.07), (4, 2, 3, 6.0, 0.05), (5, 3, 3, 1.0, 0.05)]
    values = ", ".join(f"({o}, {p}, {n}, {'NULL' if q is None else q}::DOUBLE, {t}::DOUBLE)" for o, p, n, q, t in lines)
    got, want = against_sql(
        spark, tmp_path, "exported_roots",
        lineitem=f"SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, n::INT AS l_linenumber, q AS l_quantity, t AS l_tax FROM (VALUES {values}) v(o, p, n, q, t)",
        orders="SELECT o_orderkey::BIGINT AS o_orderkey FROM range(1, 8) r(o_orderkey)",
    )
    assert got == want and {(r[0], r[1], r[2]) for r in got} == {("2", 19.0, 0.06), ("3", 7.0, None), ("4", 6.0, 0.07), ("5", 1.0, 0.05)}


def test_html_text(spark, tmp_path):
    """Entities without a semicolon and others than the SQL's stay; so do quotes and blanks beyond ASCII."""
    texts = ["this &amp that &amp; it", "caf&eacute; &copy &copy;", "&amp;lt;b&#39;s&nbsp;&nbsp;x", "“q” ‘r’", "  a  b　", "a\x0bb\x0c\nc ", "<p>x</p\n><SCRIPT a>1<2</script >y<ſcript>z</script><style>s</style\x0b>t</style>u", "<scripty>k</scripty><scripté>m</script>n", "", "<", "&lt;i&gt;"]
    values = ", ".join("(" + "'" + t.replace("'", "''") + "')" for t in texts)
    got, want = against_sql(spark, tmp_path, "html_text", pages=f"SELECT row_number() OVER () AS page_id, html FROM (VALUES {values}, (NULL)) v(html)")
    assert got == want and "this &amp that & it" in {r[1] for r in got}


@pytest.mark.parametrize("query", ["corrections_one_family", "benjamini_hochberg"])
def test_corrections(spark, tmp_path, query):
    got, want = against_sql(
        spark, tmp_path, query,
        orders="SELECT r::BIGINT AS o_orderkey FROM range(1, 3000) t(r)",
        part="SELECT r::BIGINT AS p_partkey, 'b' || r % 3 AS p_brand FROM range(1, 3000) t(r)",
    )
    assert len(got) == 2999 and all(math.isclose(a, b, abs_tol=2e-6) if isinstance(a, float) else a == b for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))
