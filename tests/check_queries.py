"""Run registered queries against their SQL on one data folder: ``python tests/check_queries.py [sf] [name …]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(con, frame, oracle: str) -> tuple[bool, str]:
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(oracle)
    names = [c[0] for c in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in want][:2]
        lost = [r for r in want if r not in got][:2]
        return False, f"{len(got)} rows against {len(want)}; only Spark {extra}; only SQL {lost}"
    return True, f"{len(got)} rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from riskloom.session import local_session

    sf_dir = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    wanted = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            frame = queries()[name](spark, sf_dir)
            oracle = oracle_sql().get(name)
            ok, note = compare(con, frame, oracle) if oracle else (True, f"{frame.count()} rows, no SQL")
        except Exception as problem:  # noqa: BLE001
            ok, note = False, str(problem)[:600]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} queries agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
