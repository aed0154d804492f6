"""Run queries next to their SQL twins: ``python -m checks.compare [pattern] [sf]``."""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

import duckdb

from checks import all_queries
from tideline import build_session


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else format(value + 0.0, ".6f")
    return str(value)


def rows(frame, columns):
    return sorted(tuple(normal(v) for v in row) for row in frame[columns].itertuples(index=False))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    start = time.time()
    try:
        frame = fn(spark, sf_dir)
        schema = frame.dtypes
        got_rows = [tuple(r) for r in frame.collect()]
    except Exception as error:  # noqa: BLE001 - reported per query
        return False, f"spark: {str(error)[:600]}"
    spent = time.time() - start
    names = [c for c, _ in schema]
    if sql is None:
        return True, f"rows {len(got_rows)} (no oracle) {spent:.1f}s"
    try:
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        want_rows = result.fetchall()
    except Exception as error:  # noqa: BLE001
        return False, f"duckdb: {str(error)[:600]}"
    odd = [c[0] for c in result.description if "DECIMAL" in str(c[1]) or "HUGEINT" in str(c[1])]
    if odd:
        return False, f"duckdb types of {odd} have no Spark twin"
    if sorted(columns) != sorted(names):
        return False, f"columns {names} != {columns}"
    order = sorted(columns)

    def key(rows, cols):
        index = [cols.index(c) for c in order]
        return sorted(tuple(normal(r[i]) for i in index) for r in rows)

    got, want = key(got_rows, names), key(want_rows, columns)
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"{len(got)} vs {len(want)} rows; {diff}"
    note = "" if got else " EMPTY"
    return True, f"rows {len(got)} {spent:.1f}s duck {time.time() - start - spent:.1f}s{note}"


def main() -> None:
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = f"/root/testdata/{sys.argv[2] if len(sys.argv) > 2 else 'sf0.01'}"
    spark = build_session(
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = all_queries()
    con = duck(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if re.search(pattern, name):
            good, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
            bad += not good
            print("ok  " if good else "FAIL", name, note, flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main()
