"""Rows of a Spark query and of a DuckDB query in one comparable form."""

import glob
import math
import os

import duckdb


def value(x):
    if x is None or hasattr(x, "isoformat"):
        return x and x.isoformat()
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7)
    return float(x) if isinstance(x, (int, bool)) else x


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def duck(root, sql):
    c = duckdb.connect()
    for f in glob.glob(f"{root}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = c.execute(sql)
    return canon([d[0] for d in cursor.description], cursor.fetchall())


def spark_rows(df):
    return canon(df.columns, [tuple(r) for r in df.collect()])
