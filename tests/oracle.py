"""Holds a query's rows against DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(table):
    names = sorted(table.column_names)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in table.to_pylist())


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def arrow(relation):
    made = relation.arrow()
    return made.read_all() if hasattr(made, "read_all") else made


def same(frame, sql, sf_dir):
    return canonical(frame.toArrow()) == canonical(arrow(connection(sf_dir).sql(sql)))
