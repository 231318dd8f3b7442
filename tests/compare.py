"""Run registered queries next to their SQL twins and compare the results.

``python tests/compare.py [sf_dir] [name-part ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    """Values as the two engines hand them out, in one form; types stay apart."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f:{v + 0.0!r}"
    if isinstance(v, datetime):
        return f"t:{v.replace(tzinfo=None).isoformat()}"
    if isinstance(v, date):
        return f"d:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference {g} != {w}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from salesloom.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                diff = compare(df, con, oracles[name])
                state = "ok" if diff is None else f"DIFFERS: {diff}"
            else:
                state = f"rows only ({df.count()})"
        except Exception as e:  # report and go on
            state = f"FAILED: {type(e).__name__}: {str(e)[:600]}"
        bad += state.startswith(("DIFFERS", "FAILED"))
        print(f"{name:45s} {time.time() - start:6.2f}s  {state}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
