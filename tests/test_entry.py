import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert "b01_running_total" in queries and set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values())


def test_bindings_match_sql(spark):
    """A few bindings against DuckDB on the smallest tables; the driver compares all of them."""
    duckdb = __import__("pytest").importorskip("duckdb")
    import os

    root = "/root/testdata/sf0.001"
    if not os.path.isdir(root):
        __import__("pytest").skip("no tables")
    c = duckdb.connect()
    for t in ("orders", "events", "customer", "lineitem", "nation"):
        c.sql(f"create view {t} as select * from '{root}/{t}.parquet'")
    for name in ("b01_running_total", "b06_snapshot_total", "b23_abort_propagation", "b25_due_predicate"):
        df = entry.queries()[name](spark, root)
        columns = sorted(df.columns)
        have = sorted(tuple(map(str, r)) for r in df.select(columns).collect())
        want = sorted(tuple(map(str, r)) for r in c.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall())
        assert have == want, name
