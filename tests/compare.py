"""Run registered queries in Spark and DuckDB and compare the results.

    python -m tests.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    connection = duckdb.connect()
    connection.execute("SET threads TO 8")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    return value


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else a short description."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    kinds = [
        (c, spark_frame[c].dtype, sql_frame[c].dtype)
        for c in sorted(spark_frame.columns)
        # Integer columns with nulls come back as different pandas types from the two engines.
        if spark_frame[c].dtype != sql_frame[c].dtype and not (spark_frame[c].isna().any() and sql_frame[c].isna().any())
    ]
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    left, right = _rows(spark_frame), _rows(sql_frame)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]} (types {kinds})"
    if kinds:
        return f"types {kinds}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    from tests.session import session
    import __spark_entry__ as entry

    spark = session()
    connection = duck(folder)
    oracles = entry.oracle_sql()
    failures = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            result = query(spark, folder).toPandas()
            took = time.time() - started
            if name in oracles:
                problem = difference(result, connection.execute(oracles[name]).df())
                note = "ok" if problem is None else f"FAIL {problem}"
            else:
                problem, note = None, "no sql"
        except Exception as error:  # report and go on with the next query
            took, problem = time.time() - started, str(error)[:900]
            note = f"ERROR {problem}"
            result = []
        failures += problem is not None
        print(f"{name:36s} {len(result):7d} rows {took:6.2f}s {note}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    arguments = sys.argv[1:]
    base = arguments.pop(0) if arguments and arguments[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(base, arguments) else 0)
