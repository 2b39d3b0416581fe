"""Runs queries next to their SQL twins and reports differences: python tests/oracle_check.py SF [names...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        return str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(sf, wanted):
    import duckdb

    import __spark_entry__ as entry
    from compassframe.session import local_session

    spark = local_session(8, 8)
    sf_dir = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            t0 = time.time()
            df = fn(spark, sf_dir)
            got = canonical_rows(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in oracles:
                print(f"{name:28s} rows={len(got[1])} spark={t1 - t0:.1f}s (no SQL)", flush=True)
                continue
            cur = con.execute(oracles[name])
            exp = canonical_rows([d[0] for d in cur.description], cur.fetchall())
            t2 = time.time()
            same = got == exp
            print(f"{name:28s} rows={len(got[1])}/{len(exp[1])} {'OK' if same else 'DIFF'} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s", flush=True)
            if not same:
                bad.append(name)
                print("   columns", got[0], exp[0] if got[0] != exp[0] else "")
                a, b = set(got[1]), set(exp[1])
                for r in sorted(a - b)[:3]:
                    print("   spark only", str(r)[:400])
                for r in sorted(b - a)[:3]:
                    print("   sql only  ", str(r)[:400])
        except Exception as exc:
            bad.append(name)
            print(f"{name:28s} ERROR {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
