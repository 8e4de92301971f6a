"""Comparing queries with their SQL."""

import os


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


def connect(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(data)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


def assert_same(spark, data, query, sql):
    df = query(spark, data)
    rel = connect(data).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())
