"""Run queries and their SQL side by side and report where rows differ.

Usage: python -m checks.compare FOLDER [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import oracle_sql
from checks.queries import queries

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value: object) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return str(value)


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


# What DuckDB calls Spark's types.
SAME_TYPE = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def difference(spark, con, folder: str, name: str) -> str | None:
    """None if the rows agree, else a short account of how they differ."""
    df = queries()[name](spark, folder)
    got = _rows(df.columns, df.collect())
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    have = sorted((c, SAME_TYPE.get(t, t)) for c, t in df.dtypes)
    need = sorted((d[0], str(d[1])) for d in cursor.description)
    if have != need:
        return f"columns {sorted(set(have) - set(need))} and {sorted(set(need) - set(have))}"
    if got != want:
        first = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"{len(got)} and {len(want)} rows; first: {first}"
    return None


def main(folder: str, *names: str) -> int:
    from tradewind.session import build_session

    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}
    spark = build_session("checks", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(folder), 0
    for name in names or queries():
        if name not in oracle_sql():
            print(f"{name}: no SQL", flush=True)
            continue
        start = time.monotonic()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as error:  # keep going: one broken query should not hide the others
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None
        print(f"{name}: {problem or 'same'} ({time.monotonic() - start:.1f}s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
