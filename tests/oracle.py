"""Compares a registered query with its SQL twin on DuckDB, order aside."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection(data: Path = DATA):
    con = duckdb.connect()
    for f in data.iterdir():
        con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, bool):
        return "b", value
    if isinstance(value, (int, float, decimal.Decimal)):
        return "n", "nan" if math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return "t", value.replace(tzinfo=None).isoformat()
    return ("z",) if value is None else ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql, data: Path = DATA):
    frame = run(spark, str(data))
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, cursor.fetchall())
