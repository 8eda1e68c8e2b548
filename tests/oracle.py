"""Compare a query with its SQL on the same tables."""

import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        at = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.sql(f'CREATE VIEW "{os.path.basename(f)[:-8]}" AS SELECT * FROM \'{at}\'')
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if isinstance(v, float):
            return None if v != v else repr(round(v, 9))
        return None if v is None else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return [names[i] for i in order], sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


def same(spark_df, sql, con):
    q = con.sql(sql)
    a, b = plain(spark_df.columns, [tuple(r) for r in spark_df.collect()]), plain(q.columns, q.fetchall())
    assert a[0] == b[0]
    assert a[1] == b[1]
