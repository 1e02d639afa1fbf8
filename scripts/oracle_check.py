"""Run registered queries in Spark and their DuckDB oracles; compare rows, schema and values.

    python scripts/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.plans.catalog import oracle_queries, spark_queries  # noqa: E402
from ledgerline.plans.verify import compare, duckdb_connection  # noqa: E402
from ledgerline.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session()
    con = duckdb_connection(sf_dir)
    sq, oq = spark_queries(), oracle_queries()
    ok = True
    for n in (names or sq):
        if n not in oq:
            print(f"{n:28s} NOORACLE rows={sq[n](spark, sf_dir).count()}", flush=True)
            continue
        try:
            t0 = time.time()
            s_pdf = sq[n](spark, sf_dir).toPandas()
            t1 = time.time()
            o_pdf = con.sql(oq[n]).df()
            t2 = time.time()
            good, detail = compare(s_pdf, o_pdf)
            ok &= good
            print(f"{n:28s} {'OK' if good else 'DIFF':5s} spark={t1 - t0:6.2f}s oracle={t2 - t1:6.2f}s {detail}",
                  flush=True)
        except Exception as e:  # report and continue with the next query
            ok = False
            print(f"{n:28s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
    sys.exit(0 if ok else 1)


if __name__ == "__main__":
    main()
