"""Column helpers (F1-F15, U2). All are built-in expressions: they stay inside
whole-stage codegen and never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return col_(c).cast("double")


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)`` in double arithmetic (null instead of an error)."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def round2(x) -> Column:
    """Round a double to 2 decimals, half away from zero.

    Written as ``sign * floor(|x| * 100 + 0.5) / 100`` so the result is the
    same double in every engine (``round`` on doubles differs in the last
    cent between engines on near-ties), and ``-0.0`` never appears.
    """
    x = as_double(x)
    mag = F.floor(F.abs(x) * 100 + 0.5) / 100
    return F.when(x < 0, -mag).otherwise(mag + F.lit(0.0))


def pct_change(new, old) -> Column:
    """Percent change ``(new - old) / old * 100``; null for a null or zero old value."""
    return safe_div(as_double(new) - as_double(old), old) * 100


def signed_qty(type_col="type", qty_col="quantity") -> Column:
    """+quantity for BUY, -quantity otherwise."""
    q = col_(qty_col)
    return F.when(col_(type_col) == "BUY", q).otherwise(-q)


def weighted_mean(sum_wx, sum_w) -> Column:
    """``SUM(w*x) / NULLIF(SUM(w), 0)`` given the two sums."""
    return safe_div(sum_wx, sum_w)


def profit_label(x) -> Column:
    """'profit' for ``x >= 0``, 'loss' otherwise (null stays null)."""
    return F.when(col_(x) >= 0, "profit").when(col_(x) < 0, "loss")


def fmt2(x) -> Column:
    """Fixed two-decimal text; 'N/A' for null."""
    # format_string renders null as the text 'null', so test for null first.
    return F.when(col_(x).isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", as_double(x)))


def parse_display_number(text) -> Column:
    """Numeric value of display text: keep digits, dot and minus, then parse (null if unparseable)."""
    return F.regexp_replace(col_(text), r"[^0-9.\-]", "").try_cast("double")


def norm_ticker(x) -> Column:
    return F.upper(F.trim(col_(x)))


def norm_name(x) -> Column:
    """Case-insensitive name key: ``lower(trim(name))``."""
    return F.lower(F.trim(col_(x)))


def day(ts) -> Column:
    """``date_trunc('day', ts)::date``."""
    return col_(ts).cast("date")


def ymd(d) -> Column:
    return F.date_format(col_(d), "yyyy-MM-dd")
