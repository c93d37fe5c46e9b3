"""A query's rows beside those of its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def told(value):
    """A value in a form that both engines' rows have."""
    if not hasattr(value, "__len__") and pd.isna(value):
        return "null"
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return f"{float(value):.9g}"
    if isinstance(value, (int, float)) or type(value).__name__ in ("Decimal", "int64", "float64", "int32", "float32"):
        return f"{float(value):.9g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([told(x) for x in value])
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(told(x) for x in row) for row in frame[columns].itertuples(index=False, name=None))


def same(spark, sf_dir, query, sql):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = rows(query(spark, sf_dir).toPandas()), rows(c.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
