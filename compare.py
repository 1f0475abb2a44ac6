"""Run registered queries against their oracles: ``python compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from attestry.plans.catalog import load
from attestry.plans.model import BASE_TABLES
from attestry.session import local_session


def canonical(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float) and value != value:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    if isinstance(value, str):
        return value
    return str(int(number)) if number == int(number) else f"{number:.9g}"


def multiset(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def differences(spark, con, query, sf_dir: str) -> tuple[str, int]:
    frame = query(spark, sf_dir)
    mine = [tuple(row) for row in frame.collect()]
    if query.sql is None:
        return "rows only", len(mine)
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(mine)
    left, right = multiset(mine, frame.columns), multiset(theirs, names)
    if left == right:
        return "", len(mine)
    only_left = sorted(set(left) - set(right))[:3]
    only_right = sorted(set(right) - set(left))[:3]
    return f"{len(left)} vs {len(right)} rows; {sorted(names)}\n   spark {only_left}\n   sql   {only_right}", len(mine)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name, query in load().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem, rows = differences(spark, con, query, sf_dir)
        except Exception as error:  # noqa: BLE001  one failure must not hide the rest
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        ok = problem in ("", "rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} rows={rows} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
