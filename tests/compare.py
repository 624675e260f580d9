"""Running a query and its SQL over one folder of tables."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def sql_rows(sql, sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        path = f"{file}/*.parquet" if file.is_dir() else file
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{path}'")
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    return sorted(columns), rows(columns, cursor.fetchall())


def query_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())
