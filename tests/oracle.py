"""Results of Spark and of DuckDB, made comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark pages conversations embeddings".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=str)


def results(df, con, sql):
    got = by_name(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    return got, by_name([d[0] for d in cur.description], cur.fetchall())
