"""Run registered queries next to their SQL and compare rows, columns and values.

    python tests/compare.py [name-part ...] [--sf 0.01]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


TIMES: dict[str, float] = {}


def canon(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    TIMES["spark"] = time.time()
    cols, mine = rows_of(df.columns, got)
    if sql is None:
        return len(mine), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = rows_of(names, cur.fetchall())
    if cols != want_cols:
        return len(mine), f"columns {cols} != {want_cols}"
    if len(mine) != len(want):
        return len(mine), f"{len(mine)} rows != {len(want)}; extra {sorted(set(mine) - set(want))[:2]} missing {sorted(set(want) - set(mine))[:2]}"
    if mine != want:
        bad = [(a, b) for a, b in zip(mine, want) if a != b]
        return len(mine), f"{len(bad)} rows differ, e.g. {bad[0]}"
    return len(mine), None


def main(argv):
    import __spark_entry__ as E
    from geoloom.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = connect(sf_dir)
    queries, oracle = E.queries(), E.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if argv and not any(a in name or a == fn.__module__.rsplit('.', 1)[-1] for a in argv):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # report and go on
            n, err = -1, f"{type(exc).__name__}: {str(exc)[:900]}"
        status = "ok" if err is None else "FAIL"
        note = "" if name in oracle else " (no sql)"
        print(f"{status:4} {name:40} rows={n} {TIMES.get("spark", t) - t:6.2f}s sql {time.time() - max(t, TIMES.get("spark", t)):6.2f}s{note} {err or ''}", flush=True)
        failed += err is not None
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
