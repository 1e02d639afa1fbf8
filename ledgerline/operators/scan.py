"""Prefix scans that stay parallel when one key holds a large share of rows.

A plain ``sum(...) OVER (PARTITION BY key ORDER BY ts)`` puts every row of a
key into one task, so a hot key (a third of all trades) becomes one giant
sort. The scans here split each key's history into time buckets (a day by
default) and run in two levels:

1. inside each ``(key, bucket)``: the running aggregate over the rows of the
   bucket (a window partitioned by ``key + bucket``);
2. across buckets: the aggregate of all *earlier* buckets of the key, computed
   on the per-bucket totals (one row per key and bucket, so its size is bounded
   by the length of the calendar, not by the number of trades), and joined
   back on ``(key, bucket)``.

The input is scanned twice: once for the rows, once for the totals, which
Catalyst reduces to the pruned columns and sums before their exchange.
Level 1 shuffles the data once on ``(key, bucket)``; the per-bucket totals are
aggregated on that same partitioning, and the carry join reuses it, so the
large side is exchanged exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}

#: Stand-ins for null by kind of type; which keys are null is kept beside them.
_NO_VALUE = {"string": "", "date": "0001-01-01", "timestamp": "0001-01-01", "timestamp_ntz": "0001-01-01", "boolean": False}


def match_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that are equal exactly where ``keys`` are, nulls
    included, and never null themselves: joins on them lose no row and share
    the exchange of a window partitioned by them. Returns their names."""
    names = []
    for k in keys:
        kind = df.schema[k].dataType.typeName()
        stand_in = F.lit(_NO_VALUE.get(kind, 0)).cast(df.schema[k].dataType)
        if f"_key_{k}" not in df.columns:
            df = df.withColumn(f"_key_{k}", F.coalesce(F.col(k), stand_in)).withColumn(f"_null_{k}", F.col(k).isNull())
        names += [f"_key_{k}", f"_null_{k}"]
    return df, names


def drop_match_keys(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_key_", "_null_"))])


def bucketed_prefix(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
                    aggs: dict[str, tuple[str, str]], include_peers: bool = True,
                    carry_default: dict[str, Column] | None = None) -> DataFrame:
    """Add running aggregates over ``keys`` ordered by ``order``.

    ``aggs`` maps output column -> (kind, input column), kind in sum/max/min.
    ``bucket`` must be non-decreasing in ``order`` (e.g. the day of the
    timestamp ordered on). ``carry_default`` gives a sum's value when every
    input in its frame is null (SQL: null). With ``include_peers`` rows with an equal order
    value count as preceding (a RANGE frame, ``ts <= current ts``); otherwise
    a ROWS frame is used. Rows are never dropped.
    """
    df, keys = match_keys(df, keys)
    df, day = match_keys(df, [bucket])
    part = keys + day
    w_in = Window.partitionBy(*part).orderBy(*order)
    w_in = (w_in.rangeBetween(Window.unboundedPreceding, Window.currentRow) if include_peers
            else w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df
    for name, (kind, src) in aggs.items():
        out = out.withColumn(f"_in_{name}", _COMBINE[kind](src).over(w_in))

    totals = out.groupBy(*part).agg(*[_COMBINE[k](src).alias(f"_bt_{n}") for n, (k, src) in aggs.items()])
    # a null bucket comes before all others, as null order values do
    w_prev = (Window.partitionBy(*keys).orderBy(F.col(day[1]).desc(), day[0])
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*part, *[_COMBINE[k](f"_bt_{n}").over(w_prev).alias(f"_carry_{n}")
                                   for n, (k, _) in aggs.items()])
    # The carry table has one row per (key, bucket): it grows with the data,
    # so it is never broadcast. The big side is already hash-partitioned on
    # (key, bucket) by the window, so a merge join only moves the carry side.
    out = out.join(carry.hint("shuffle_merge"), part, "inner")
    defaults = carry_default or {}
    for name, (kind, _) in aggs.items():
        inner, prev = F.col(f"_in_{name}"), F.col(f"_carry_{name}")
        if kind == "sum":
            # SQL SUM: null only when every value in the frame is null.
            val = F.when(prev.isNull() & inner.isNull(), defaults.get(name)) \
                   .otherwise(F.coalesce(prev, F.lit(0)) + F.coalesce(inner, F.lit(0)))
        elif kind == "max":
            val = F.greatest(prev, inner)
        else:
            val = F.least(prev, inner)
        out = out.withColumn(name, val)
    return drop_match_keys(out.drop(*[c for c in out.columns if c.startswith(("_in_", "_carry_"))]))


def bucketed_lag(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
                 value: str, out: str, has_prev: str | None = None) -> DataFrame:
    """``lag(value) OVER (PARTITION BY keys ORDER BY order)`` in two levels.

    Inside a bucket it is a plain lag; the first row of a bucket takes the
    last value of the nearest earlier non-empty bucket of the same key. With
    ``has_prev`` a boolean column tells whether the row has a predecessor at
    all (the lag alone cannot: a predecessor's value may itself be null).
    """
    df, keys = match_keys(df, keys)
    df, day = match_keys(df, [bucket])
    part = keys + day
    w_in = Window.partitionBy(*part).orderBy(*order)
    marked = df.withColumn("_lag_in", F.lag(value).over(w_in)).withColumn("_first", F.row_number().over(w_in) == 1)
    ordered = F.struct(*[F.col(c) for c in order])
    last_in_bucket = marked.groupBy(*part).agg(F.max_by(F.col(value), ordered).alias("_last"))
    w_prev = Window.partitionBy(*keys).orderBy(F.col(day[1]).desc(), day[0])
    prev = last_in_bucket.select(*part, F.lag("_last").over(w_prev).alias("_prev_bucket_last"),
                                 F.lag(day[0]).over(w_prev).isNotNull().alias("_earlier_bucket"))
    # One row per (key, bucket): grows with the data, so never broadcast.
    joined = marked.join(prev.hint("shuffle_merge"), part, "inner")
    res = joined.withColumn(out, F.when(F.col("_first"), F.col("_prev_bucket_last")).otherwise(F.col("_lag_in")))
    if has_prev:
        res = res.withColumn(has_prev, ~F.col("_first") | F.col("_earlier_bucket"))
    return drop_match_keys(res.drop("_lag_in", "_first", "_prev_bucket_last", "_earlier_bucket"))


def sliding_range(df: DataFrame, keys: Sequence[str], day: str, days: int,
                  aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """``agg(col) OVER (PARTITION BY keys ORDER BY day RANGE BETWEEN days PRECEDING AND CURRENT ROW)``
    for associative aggregates (sum, count, max, min), in linear time.

    Spark evaluates a sliding RANGE frame by re-aggregating the frame for each
    row: O(rows x frame). Here the day axis is cut into blocks of ``days + 1``
    days, so every frame is a suffix of the previous block plus a prefix of
    the current one. The prefix is a running aggregate inside ``(key, block)``;
    the suffix is a running aggregate over the previous block's rows taken in
    descending day order, interleaved with the rows that ask for it. Each
    window partition spans at most two blocks of one key. ``day`` must be a
    DATE column; ``aggs`` maps output column -> (kind, input column).
    """
    keys = list(keys)
    fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    span = days + 1
    dn = F.unix_date(F.col(day))
    base = df.withColumn("_blk", F.floor(dn / span)).withColumn("_off", dn - F.col("_blk") * span)
    # rows of one day are peers: each sees all of them
    w_pre = Window.partitionBy(*keys, "_blk").orderBy("_off").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for o, (kind, c) in aggs.items():
        base = base.withColumn(f"_pre_{o}", fn[kind](c).over(w_pre))
    inputs = sorted({c for _, c in aggs.values()})
    pres = [f"_pre_{o}" for o in aggs]
    # Rows asking for "previous block, offsets >= my offset + 1", and the
    # previous block's values, meeting in the group of the asking block.
    row = F.struct(*[F.col(c) for c in df.columns], *[F.col(p) for p in pres]).alias("_row")
    ask = base.select(*keys, F.col("_blk").alias("_grp"), (F.col("_off") + 1).alias("_k"), F.lit(1).alias("_ask"),
                      row, *[F.lit(None).cast(df.schema[c].dataType).alias(f"_v_{c}") for c in inputs])
    give = base.select(*keys, (F.col("_blk") + 1).alias("_grp"), F.col("_off").alias("_k"), F.lit(0).alias("_ask"),
                       F.lit(None).cast(ask.schema["_row"].dataType).alias("_row"),
                       *[F.col(c).alias(f"_v_{c}") for c in inputs])
    w_suf = Window.partitionBy(*keys, "_grp").orderBy(F.col("_k").desc(), F.col("_ask")) \
                  .rowsBetween(Window.unboundedPreceding, 0)
    u = ask.unionByName(give)
    for o, (kind, c) in aggs.items():
        u = u.withColumn(f"_suf_{o}", fn[kind](f"_v_{c}").over(w_suf))
    u = u.where(F.col("_ask") == 1)
    outs = []
    for o, (kind, _) in aggs.items():
        pre, suf = F.col(f"_row._pre_{o}"), F.col(f"_suf_{o}")
        if kind in ("sum", "count"):
            val = F.when(pre.isNull() & suf.isNull(), None if kind == "sum" else F.lit(0)) \
                   .otherwise(F.coalesce(pre, F.lit(0)) + F.coalesce(suf, F.lit(0)))
            if kind == "count":
                val = val.cast("bigint")
        else:
            val = F.greatest(pre, suf) if kind == "max" else F.least(pre, suf)
        outs.append(val.alias(o))
    return u.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns], *outs)
