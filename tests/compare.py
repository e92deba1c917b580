"""Run a registered query and its check statement on the same files and compare whole results."""

import glob
import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def differences(spark, con, sf_dir, plan, statement):
    """Empty string when both results are equal, otherwise what differs first."""
    df = plan(spark, sf_dir)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = _rows(names, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} <> {want_columns}"
    for name, dtype in df.dtypes:
        if TYPE_NAMES.get(dtype) != types[name]:
            return f"type of {name}: {dtype} <> {types[name]}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    for a, c in zip(got, want):
        if a != c:
            return f"first difference in {got_columns}: {a} <> {c}"
    return "" if got else "no rows"
