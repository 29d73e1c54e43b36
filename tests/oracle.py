"""Runs a query and its DuckDB SQL over the same tables and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(df, sql, sf):
    a, b = df.toPandas(), duck(sf).sql(sql).df()
    # whole numbers with nulls are doubles in the one and nullable in the other
    b = b.astype({c: "float64" for c, t in b.dtypes.items() if str(t) == "Int64"})
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [sorted(map(repr, x[cols].astype(object).itertuples(index=False, name=None))) for x in (a, b)]
    assert rows[0] == rows[1]
    return len(a)
