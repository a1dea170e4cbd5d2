"""Holds every query with SQL against DuckDB: ``python tests/parity.py SF_DIR [NAME...]``."""

from __future__ import annotations

import glob
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        files = f"{path}/*.parquet" if Path(path).is_dir() else path
        con.execute(f"create view {Path(path).stem} as select * from read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, f, sql, sf_dir) -> str:
    """'' where both agree, else what differs."""
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only here {a}; only in SQL {b}"
    return "" if got else "both are empty"


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, con = make_session(), connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or oracles:
        t = time.time()
        try:
            said = compare(spark, con, name, queries[name], oracles[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if not said else 'DIFF'} {name} {time.time() - t:.1f}s {said[:900]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
