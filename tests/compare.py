"""Runs a query in Spark and its twin in DuckDB."""

import glob
import os

import duckdb

#: DuckDB views over a folder of tables.
def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f":
        return None if v != v else round(float(v), 9)
    if getattr(getattr(v, "dtype", None), "kind", "") in "iu" and hasattr(v, "dtype"):
        return int(v)
    return v if isinstance(v, (int, str)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


def assert_same(spark_frame, sql, con):
    a, b = rows(spark_frame.toPandas()), rows(con.execute(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1]
