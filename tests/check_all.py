"""CLI: compare every registered query with its oracle at one scale factor.

    python tests/check_all.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from polysafe.session import get_spark  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, orc = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        if name not in orc:
            n = fn(spark, sf_dir).count()
            print(f"{name:28s} rows-only {n} rows {time.time()-t:.1f}s")
            continue
        try:
            r = compare(spark, name, fn, orc[name], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        ok = r["values_ok"]
        bad += 0 if ok else 1
        print(f"{name:28s} {'OK ' if ok else 'BAD'} rows {r['spark_rows']}/{r['oracle_rows']} "
              f"{time.time()-t:.1f}s" + ("" if ok else f" cols_ok={r['cols_ok']} {r.get('first_diff', '')} "
                                         f"{r['spark_cols'] if not r['cols_ok'] else ''} {r['oracle_cols'] if not r['cols_ok'] else ''}"))
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
