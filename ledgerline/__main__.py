"""Run a registered query and write its result.

    python -m ledgerline list
    python -m ledgerline run <query> <sf_dir> <out_path> [--format parquet|json]
    python -m ledgerline stream <job> <events_dir> <sf_dir> <out_path> [--checkpoint DIR] [--once]
                                [--delay "1 day"] [--heartbeats DIR]

Stream jobs: positions (T1/T2), orders (T1 with cash), prices (T3/T4),
price-audit (T3), high-low (T4), ohlc. They read ``events*.parquet`` files as they arrive, in any order within the
delay, in ``events_dir`` (seeds such as stored prices come from the tables of
``sf_dir``). The first three commit their steps and the late rows as table
versions under the output folder, the others append on-time rows to it; the
checkpoint (default: under ``spark.checkpoint.dir``) lets a restarted job
resume. ``--once`` drains what is there up to the newest event and stops.

``json`` writes one JSON object per row (dates as YYYY-MM-DD), the shape the
original endpoints returned; ``parquet`` writes the DataFrame as is. Output is
written by the executors; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.plans.catalog import spark_queries
from ledgerline.session import apply_required_conf, ensure_checkpoint_dir, scratch_path, ship_package
from ledgerline.sources.tables import to_json_rows


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerline")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("query")
    r.add_argument("sf_dir")
    r.add_argument("out")
    r.add_argument("--format", choices=["parquet", "json"], default="parquet")
    st = sub.add_parser("stream")
    st.add_argument("job", choices=["positions", "orders", "prices", "price-audit", "high-low", "ohlc"])
    st.add_argument("events_dir")
    st.add_argument("sf_dir")
    st.add_argument("out")
    st.add_argument("--checkpoint", default=None)
    st.add_argument("--once", action="store_true")
    st.add_argument("--delay", default="1 day", help="how far behind the newest event a row may come")
    st.add_argument("--heartbeats", default=None, help="folder of heartbeat files that close a period")
    args = ap.parse_args(argv)
    queries = spark_queries()
    if args.cmd == "list":
        print("\n".join(sorted(queries)))
        return 0
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.appName(f"ledgerline-{getattr(args, 'query', None) or args.job}").getOrCreate()
    apply_required_conf(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if args.cmd == "stream":
        return _stream(spark, args)
    df = queries[args.query](spark, args.sf_dir)
    if args.format == "json":
        to_json_rows(df).write.mode("overwrite").text(args.out)
    else:
        df.write.mode("overwrite").parquet(args.out)
    return 0


def _stream(spark, args) -> int:
    from ledgerline.sources.fixtures import Fixtures, fixtures
    from ledgerline.streaming import jobs, ordered
    fx, delay = fixtures(spark, args.sf_dir), args.delay
    if args.job == "ohlc":
        ev = jobs.event_stream(spark, args.events_dir, watermark=delay)
        q = jobs.start_to_parquet(jobs.ohlc_stream(Fixtures.ticks_from(ev, fx.n_parts)), args.out, f"cli-{args.job}",
                                  checkpoint=args.checkpoint, available_now=args.once)
        q.awaitTermination()
        return 0
    place = args.checkpoint or scratch_path(spark, f"streams/cli-{args.job}")
    beats = args.heartbeats or f"{place}-heartbeats"
    ordered.ensure_folder(spark, beats)

    keep = ordered.Kept()  # for as long as the stream runs

    def started():
        ev = ordered.with_heartbeats(jobs.event_stream(spark, args.events_dir), beats)
        orders, ticks = Fixtures.orders_from(ev, fx.n_parts), Fixtures.ticks_from(ev, fx.n_parts)
        if args.job == "positions":
            steps = ordered.position_steps(jobs.trades_from_orders(orders), delay)
        elif args.job == "orders":
            steps = ordered.order_steps(orders, fx.account, fx.portfolio, fx.stock, delay, keep)
        else:
            steps = ordered.price_steps(ticks, fx.stock, delay, keep)
        if args.job in ("price-audit", "high-low"):
            on_time = steps.where("NOT late").drop("late")
            rows = jobs.audit_rows(on_time) if args.job == "price-audit" else jobs.high_low_rows(on_time)
            return jobs.start_to_parquet(rows, args.out, f"cli-{args.job}", checkpoint=place, available_now=args.once)
        return ordered.start(steps, ordered.SplitSink(spark, args.out, args.job), f"cli-{args.job}", place, args.once)

    with keep:
        started().awaitTermination()
        if args.once:  # the newest event closes the period: nothing waits for rows older than it
            events = spark.read.schema(schemas.EVENTS).option("pathGlobFilter", "events*.parquet").parquet(args.events_dir)
            closed = events.agg(F.max("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 MILLISECOND")).first()[0]
            if closed is not None:
                ordered.beat(spark, beats, closed)
                started().awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
