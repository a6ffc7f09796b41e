"""Run catalogue queries against their SQL statements: python tools/compare.py [sf_dir] [name ...]"""
from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sourceloom.session import build_session  # noqa: E402


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "∅"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"f{v:.9g}"
        return f"{type(v).__name__}:{v}"

    return [sorted(columns)] + sorted(tuple(cell(r[i]) for i in order) for r in rows)


def oracle_connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def main(argv):
    sf_dir = argv[0] if argv and os.path.isdir(argv[0]) else "/root/testdata/sf0.01"
    names = [a for a in argv if not os.path.isdir(a)]
    from sourceloom.queries import ORACLES, PLANS
    spark = build_session(master="local[8]", extra={
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    bad = []
    for name in names or list(PLANS):
        matches = [n for n in PLANS if n == name or (name.endswith("*") and n.startswith(name[:-1]))]
        for n in matches:
            try:
                t = time.time()
                df = PLANS[n](spark, sf_dir)
                got = canonical([tuple(r) for r in df.collect()], df.columns)
                t1 = time.time() - t
                if n not in ORACLES:
                    print(f"ROWS {n}: {len(got) - 1} rows {t1:.1f}s", flush=True)
                    continue
                t = time.time()
                cur = con.execute(ORACLES[n])
                want = canonical(cur.fetchall(), [d[0] for d in cur.description])
                t2 = time.time() - t
                if got == want:
                    print(f"OK   {n}: {len(got) - 1} rows spark {t1:.1f}s sql {t2:.1f}s", flush=True)
                else:
                    bad.append(n)
                    print(f"DIFF {n}: spark {len(got) - 1} sql {len(want) - 1} {got[0]} {want[0]}", flush=True)
                    g, w = set(map(tuple, got[1:])), set(map(tuple, want[1:]))
                    for r in sorted(g - w)[:3]:
                        print("   spark only", str(r)[:600])
                    for r in sorted(w - g)[:3]:
                        print("   sql only  ", str(r)[:600])
            except Exception as ex:  # noqa: BLE001
                bad.append(n)
                print(f"FAIL {n}: {str(ex)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
