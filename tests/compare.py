"""Runs catalog queries next to their SQL and compares rows.

    python tests/compare.py /root/testdata/sf0.01 [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, folder) -> str:
    """Empty text when both sides agree, else what differs."""
    df = query(spark, folder)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got_columns else "no columns"
    result = con.execute(sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main() -> None:
    from parcelscope.catalog import ORACLE, QUERIES
    from parcelscope.session import get_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                             "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed, total = connect(folder), 0, 0
    for name, query in QUERIES.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start, total = time.time(), total + 1
        try:
            problem = compare(spark, con, query, ORACLE.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.1f}s {name} {problem}", flush=True)
    print(f"{total} queries, {failed} failed")


if __name__ == "__main__":
    main()
