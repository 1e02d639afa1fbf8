"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row computed,
nothing collected to the driver), twice; the faster run is reported. Prints
one JSON line:

    {"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

The drained streams (their time is per-key state and commits, not the
queries') are timed with ``BENCH_STREAMS=1`` or by name only.

``value`` is the sum over all queries timed; ``headline`` repeats the five headline
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["realized_pnl", "transaction_history", "portfolio_history", "position_ledger", "moving_averages"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from ledgerline.plans.catalog import spark_queries
    from ledgerline.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    queries = spark_queries()
    streams = os.environ.get("BENCH_STREAMS") == "1"
    names = only or [q for q in queries if streams or "stream" not in q]

    # Warm the JVM (class loading, JIT, codegen caches) on untimed runs that
    # exercise scans, aggregates, windows, joins and the Python workers.
    for warm in ("stock_listing", "realized_pnl", "position_ledger", "portfolio_history"):
        try:
            queries[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception:  # a failing warm-up query is reported by the timed loop
            pass

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        best = float("inf")
        try:
            for _ in range(runs):
                t0 = time.perf_counter()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - t0)
        except Exception as e:  # record and go on: one failure must not hide the other timings
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
            print(f"{name}: FAILED {errors[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(best, 3)
        print(f"{name}: {times[name]:.3f}s", file=sys.stderr, flush=True)

    extra = {}
    if os.environ.get("BENCH_WAREHOUSE") == "1":
        # Same queries on ledger tables persisted once (partitioned facts),
        # i.e. operator cost without re-deriving the tables from lineitem.
        from ledgerline.plans.catalog import run_on
        from ledgerline.session import scratch_path
        from ledgerline.sources.fixtures import fixtures
        from ledgerline.sources.warehouse import Warehouse, persist_tables
        folder = scratch_path(spark, f"bench-warehouse-{os.getpid()}")
        t0 = time.perf_counter()
        persist_tables(fixtures(spark, sf_dir), folder)
        extra["warehouse_persist_sec"] = round(time.perf_counter() - t0, 3)
        wh = Warehouse(spark, folder, fallback=fixtures(spark, sf_dir))
        wtimes = {}
        for name in names:
            best = float("inf")
            for _ in range(runs):
                t0 = time.perf_counter()
                run_on(wh, name).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - t0)
            wtimes[name] = round(best, 3)
            print(f"warehouse {name}: {wtimes[name]:.3f}s", file=sys.stderr, flush=True)
        extra["warehouse_queries"] = wtimes
        extra["warehouse_total_sec"] = round(sum(wtimes.values()), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir.rstrip("/"))
    out = {
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "headline": {k: times[k] for k in HEADLINE if k in times},
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "stat": "min",
        **({"errors": errors} if errors else {}),
        **extra,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
