"""Summarise the physical plan of every registered query into PLANS.md.

For each query: shuffles (Exchange hashpartitioning / rangepartitioning / single
partition), broadcasts, join strategies, windows and group limits, Python
stages, and whether any nested-loop or cartesian join appears (there must be
none). Plans are the initial adaptive plans from ``explain()``.

    python scripts/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.plans.catalog import spark_queries  # noqa: E402
from ledgerline.session import build_session  # noqa: E402

HEADLINE = ["realized_pnl", "transaction_history", "portfolio_history", "position_ledger", "moving_averages"]

PATTERNS = {
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "windows": r"\bWindow \[",
    "group limits": r"WindowGroupLimit .*Partial",
    "partial aggs": r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_",
    "python": r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython",
    "nested loop / cartesian": r"BroadcastNestedLoopJoin|CartesianProduct",
}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    rows = []
    for name, q in spark_queries().items():
        if "stream" in name:  # what is left to plan after a drain is a read of its result
            continue
        text = plan_text(q(spark, sf_dir))
        counts = {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}
        scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
        widest = max((len(s.split(",")) for s in scans), default=0)
        rows.append((name, counts, len(scans), widest))
    cols = list(PATTERNS)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plan_report.py` from the initial adaptive plans at {os.path.basename(sf_dir)} (AQE may still")
    print("turn a sort-merge join into a broadcast join at run time when a side turns out small).")
    print("`scans` = parquet scans, `max cols` = most columns read by one scan (column pruning). The drained")
    print("streams and the training-data operators, which run jobs before they return, are left out.\n")
    print("| query | " + " | ".join(cols) + " | scans | max cols |")
    print("|---" * (len(cols) + 3) + "|")
    for name, c, n_scans, widest in rows:
        print(f"| {name} | " + " | ".join(str(c[k]) for k in cols) + f" | {n_scans} | {widest} |")
    bad = [n for n, c, _, _ in rows if c["nested loop / cartesian"]]
    print(f"\nQueries with a nested-loop or cartesian join: {bad or 'none'}.")
    print("\n## Headline plans\n")
    print("Physical plan trees (`explain()`), with long scan descriptions shortened to the columns read")
    print("and the filters pushed to parquet.\n")
    queries = spark_queries()
    for name in HEADLINE:
        text = plan_text(queries[name](spark, sf_dir))
        text = re.sub(r"FileScan parquet \[([^\]]*)\][^\n]*?Location: [^\[]*\[[^\]]*/([^/\]]+)\][^\n]*?"
                      r"PushedFilters: (\[[^\]]*\])[^\n]*",
                      lambda m: f"FileScan {m.group(2)} [{m.group(1)}] PushedFilters: {m.group(3)}", text)
        text = re.sub(r"#\d+L?", "", text)
        print(f"### {name}\n\n```\n{text.strip()}\n```\n")


if __name__ == "__main__":
    main()
