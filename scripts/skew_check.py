"""Skew check: how a hot position spreads over tasks, plain window vs bucketed scan.

A skewed trade table is derived from the fixture (Spark, from the given
tables): 40% of trades are moved to one (user, ticker) position. The running
buy cost is computed with a plain window partitioned by position and with
``bucketed_prefix``; the event log (written under the scratch folder) gives
the shuffle records read by each task of the window stage.

    python scripts/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-events-", dir="/tmp")
    from ledgerline.session import build_session
    from ledgerline.operators.scan import bucketed_prefix
    from ledgerline.sources.fixtures import fixtures
    spark = build_session("local[8]", 32, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    t = fixtures(spark, sf_dir).txn
    hot = (F.pmod(F.xxhash64("transaction_id"), F.lit(5))) < 2
    t = t.withColumn("user_id", F.when(hot, F.lit(1)).otherwise(F.col("user_id"))) \
         .withColumn("stock_ticker", F.when(hot, F.lit("T0")).otherwise(F.col("stock_ticker"))) \
         .withColumn("date", F.col("ts").cast("date")) \
         .withColumn("_q", F.when(F.col("type") == "BUY", F.col("quantity")).otherwise(0))
    w = Window.partitionBy("user_id", "stock_ticker").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    jobs = {
        "plain_window": t.withColumn("cum_q", F.sum("_q").over(w)),
        "bucketed_prefix": bucketed_prefix(t, ["user_id", "stock_ticker"], "date", ["ts"], {"cum_q": ("sum", "_q")}),
    }
    spark.sparkContext.setJobGroup("skew", "skew")
    marks = {}
    for name, df in jobs.items():
        spark.sparkContext.setLocalProperty("spark.job.description", name)
        df.write.format("noop").mode("overwrite").save()
        marks[name] = name
    spark.stop()
    # Shuffle records read per task, grouped by job description.
    per_job: dict[str, list[int]] = {}
    stage_job: dict[int, str] = {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path) or not os.path.basename(path).startswith("events"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    desc = stage_job.get(ev["Stage ID"])
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    recs = m.get("Total Records Read", 0)
                    if desc in jobs and recs:
                        per_job.setdefault(desc, {}).setdefault(ev["Stage ID"], []).append(recs)
    out = {}
    for name, stages in per_job.items():
        # The stage that reads the trades (the largest shuffle read).
        recs = max(stages.values(), key=sum)
        total = sum(recs)
        out[name] = {"stages_reading_shuffle": len(stages), "tasks_in_trade_stage": len(recs),
                     "trade_stage_records": total, "max_task_records": max(recs),
                     "max_task_share": round(max(recs) / total, 3)}
    print(json.dumps(out, indent=1))


if __name__ == "__main__":
    main()
