"""Compare registered queries with their DuckDB statements.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return "null" if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    """Empty string when equal, otherwise what differs."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return "" if got is not None else "no rows", len(got)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} vs {len(b)}; spark only {sorted(sa - sb)[:3]}; sql only {sorted(sb - sa)[:3]}", len(got)
    return "", len(got)


def main() -> None:
    import __spark_entry__ as E
    from graphloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    con = duck(sf_dir)
    sqls = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            diff, n = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - t:.1f}s{'' if name in sqls else ' (no sql)'} {diff}", flush=True)
    extra = set(sqls) - set(E.queries())
    print("failed:", bad, "sql without query:", extra)


if __name__ == "__main__":
    main()
