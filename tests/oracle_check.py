"""Compare registered queries with their SQL checks: python -m tests.oracle_check [sf] [name part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from radiolake.plans.adapters import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = round(v, 6) + 0.0
        return ("n", v)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(canon(x) for x in v))
    return ("s", str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


FAMILY = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "integer": "int", "hugeint": "int",
    "double": "float", "float": "float", "decimal": "float", "varchar": "str", "string": "str",
    "boolean": "bool",
}


def family(t: str) -> str:
    t = str(t).lower().split("(")[0]
    return FAMILY.get(t, t)


def compare(spark, con, sf_dir, name, fn, sql):
    """Return (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time() - t0
    if sql is None:
        return True, f"rows={len(got)} {t1:.2f}s (no sql)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: family(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"rows {len(a)} vs {len(b)}; cols {sorted(names)}; first diff {bad}"
    spark_types = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    odd = {n: (spark_types[n], types[n]) for n in names if spark_types[n] != types[n]
           and not spark_types[n].startswith(("array", "struct"))}
    note = f" TYPES {odd}" if odd else ""
    return True, f"rows={len(a)} {t1:.2f}s{note}"


def main(argv):
    import __spark_entry__ as entry
    from radiolake.session import local_session

    sf = argv[0] if argv else "0.01"
    parts = argv[1:]
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc).split("JVM stacktrace")[0][:600]}"
        print(("ok   " if ok else "FAIL ") + name + "  " + msg, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
