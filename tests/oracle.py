"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

    python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return None if math.isnan(v) else float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(t[i]) for i in order) for t in tuples]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


KIND = {
    "bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int", "hugeint": "huge",
    "double": "float", "float": "float", "string": "str", "varchar": "str", "boolean": "bool",
    "timestamp_ntz": "ts", "timestamp": "ts", "date": "date",
}


def compare(spark, con, name, sf_dir):
    """Returns (ok, message)."""
    from airgrid.plans import catalog

    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if name not in catalog.ORACLES:
        return len(got) > 0, f"rows only: {len(got)}"
    cur = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]).lower() for d in cur.description}
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    kinds = []
    for f in df.schema:
        s, d = f.dataType.simpleString(), dtypes[f.name]
        if s == "string" and d == "string":
            continue
        if d.startswith("decimal") or KIND.get(s, s) != {"number": "num"}.get(d, KIND.get(d, d)):
            kinds.append(f"{f.name}: {s} / {d}")
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}; {kinds}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {sorted(df.columns)}\n   {bad[0][0]}\n   {bad[0][1]}"
    empty = "" if got else " EMPTY"
    return True, f"{len(got)} rows{empty} {'TYPES ' + str(kinds) if kinds else ''}"


def main(argv):
    from airgrid.core import session
    from airgrid.plans import catalog

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    names = [n for n in catalog.QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session("oracle", cpus=8), duck(sf_dir)
    failed = []
    for n in names:
        t = time.time()
        try:
            ok, msg = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
