"""Run registered queries beside their SQL twins and report differences.

    python tools/check_oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from galeledger.catalog import REGISTRY, SQL  # noqa: E402
from galeledger.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(row[i]) for i in order) for row in data), key=repr), [columns[i] for i in order]


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when equal, else what differs."""
    df = REGISTRY[name](spark, sf_dir)
    got, gc = _rows(df.columns, df.collect())
    if name not in SQL:
        return "" if got else "no rows"
    cur = con.execute(SQL[name])
    want, wc = _rows([d[0] for d in cur.description], cur.fetchall())
    if gc != wc:
        return f"columns {gc} != {wc}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first only here {next(iter(set(map(repr, got)) - set(map(repr, want))), None)}, first only there {next(iter(set(map(repr, want)) - set(map(repr, got))), None)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    types = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(gc, got[0], want[0]) if type(a) is not type(b) and None not in (a, b)] if got else []
    if types:
        return f"types {types}"
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else ("" if got else "both empty")


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    names = [n for n in REGISTRY if n in names or any(n.startswith(p.rstrip("*")) for p in names if p.endswith("*"))]
    spark, con, failed = local_session(), connect(sf_dir), 0
    for n in names:
        t0 = time.time()
        try:
            diff = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {n} {time.time() - t0:.1f}s {diff}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
