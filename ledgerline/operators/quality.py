"""Table audits (K1-K5): the declared keys and constraints, checked after the
fact since Spark does not enforce them on write.

Every check returns violating rows as ``(table, rule, key, value)`` strings;
an empty result means the table satisfies the rule. K1 is one aggregation and
K2 one anti join over all tables; the others are filters in one pass a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import CONSTRAINTS

AUDIT_COLUMNS = ["table", "rule", "key", "value"]


def _key(cols) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def _out(df: DataFrame, table: str, rule: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"),
                     key.alias("key"), value.cast("string").alias("value"))


def _union(parts: list[DataFrame], spark_df: DataFrame) -> DataFrame:
    if not parts:
        return _out(spark_df.limit(0), "", "", F.lit(""), F.lit(""))
    return reduce(DataFrame.unionByName, parts)


def _values(cols) -> Column:
    """Key values as text, kept apart: equal exactly where all of them are."""
    return F.array(*[F.col(c).cast("string") for c in cols])


def _shown(values: str) -> Column:
    return F.array_join(F.col(values), "|", "NULL")


def check_primary_keys(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """K1: duplicate or null primary keys, and duplicate UNIQUE values.

    Every row tells its key under each rule of its table, and all rules of
    all tables are one aggregation, so a table is read once and the counts
    meet in one exchange, combined map-side. Rows with a null in the primary
    key are counted in groups of bounded size and told one by one."""
    parts = []
    for name, spec in constraints.items():
        if name not in tables:
            continue
        pk = spec["pk"]
        groups = [("primary_key", pk)] + [("unique:" + ",".join(u), u) for u in spec.get("unique", [])]
        whole = {rule: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]) for rule, cols in groups}
        group = F.shiftright(F.monotonically_increasing_id(), 16).cast("long")
        told = [F.when(whole[rule], F.struct(F.lit(rule + ":duplicate").alias("rule"), _values(cols).alias("values"),
                                             F.lit(0).cast("long").alias("group"))) for rule, cols in groups]
        told.append(F.when(~whole["primary_key"], F.struct(F.lit("primary_key:null").alias("rule"), _values(pk).alias("values"), group.alias("group"))))
        row = tables[name].select(F.explode(F.array_compact(F.array(*told))).alias("t"))
        parts.append(row.select(F.lit(name).alias("table"), "t.*"))
    if not parts:
        return _union([], next(iter(tables.values())))
    n = reduce(DataFrame.unionByName, parts).groupBy("table", "rule", "values", "group").agg(F.count(F.lit(1)).alias("n"))
    null = F.col("rule") == "primary_key:null"
    times = F.when(null, F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(F.array(F.col("n")))
    return n.where(null | (F.col("n") > 1)).select(
        "table", "rule", _shown("values").alias("key"), F.explode(times).alias("_n")).select(
        "table", "rule", "key", F.when(F.col("rule") != "primary_key:null", F.col("_n")).cast("string").alias("value"))


def check_foreign_keys(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """K2: orphans - non-null foreign keys with no parent row.

    All references of all tables are one side of one anti join, all keys that
    are referred to the other: a table is read once for what it refers to and
    once, if others refer to it, for its keys. A reference that very many rows
    share lies on the side whose skewed partitions Spark splits."""
    refs, keys = [], {}
    for name, spec in constraints.items():
        own = [(cols, parent, pcols) for cols, parent, pcols in spec.get("fk", []) if parent in tables]
        if name not in tables or not own:
            continue
        told = [F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]),
                       F.struct(F.lit(f"foreign_key:{','.join(cols)}->{parent}").alias("rule"),
                                F.lit(f"{parent}:{','.join(pcols)}").alias("domain"), _values(cols).alias("values")))
                for cols, parent, pcols in own]
        row = tables[name].select(_key(spec["pk"]).alias("key"), F.explode(F.array_compact(F.array(*told))).alias("t"))
        refs.append(row.select(F.lit(name).alias("table"), "t.rule", "key", "t.domain", "t.values"))
        keys.update({(parent, tuple(pcols)): None for _, parent, pcols in own})
    if not refs:
        return _union([], next(iter(tables.values())))
    by_parent: dict[str, list] = {}
    for parent, pcols in keys:
        by_parent.setdefault(parent, []).append(F.struct(F.lit(f"{parent}:{','.join(pcols)}").alias("domain"), _values(pcols).alias("values")))
    known = reduce(DataFrame.unionByName, [tables[parent].select(F.explode(F.array(*told)).alias("t")).select("t.*")
                                           for parent, told in by_parent.items()])
    orphans = reduce(DataFrame.unionByName, refs).join(known, ["domain", "values"], "left_anti")
    return orphans.select("table", "rule", "key", _shown("values").alias("value"))


def _row_rules(df: DataFrame, table: str, pk, rules: list[tuple[str, Column, Column]]) -> DataFrame | None:
    """Evaluate several row-level rules in one pass over ``df``.

    ``rules`` are ``(rule, violated, value)``; each row yields an array of
    the rules it breaks, exploded into audit rows. One scan per table, however
    many rules it has."""
    if not rules:
        return None
    flags = [F.coalesce(bad, F.lit(False)) for _, bad, _ in rules]
    # Filter on the OR of all rules first (cheap, code-generated); build the
    # per-rule array only for the few rows that break something.
    any_bad = reduce(lambda a, b: a | b, flags)
    hits = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), f.alias("bad"), v.cast("string").alias("value"))
                              for (r, _, v), f in zip(rules, flags)]), lambda x: x["bad"])
    ex = df.where(any_bad).select(_key(pk).alias("key"), F.explode(hits).alias("_h"))
    return ex.select(F.lit(table).alias("table"), F.col("_h.rule").alias("rule"), "key",
                     F.col("_h.value").alias("value"))


def _domain_rules(spec) -> list[tuple[str, Column, Column]]:
    # SQL CHECK: a condition that evaluates to null passes.
    return [("check:" + rule, ~F.expr(cond), F.lit(cond)) for rule, cond in spec.get("check", {}).items()]


def _not_null_rules(spec) -> list[tuple[str, Column, Column]]:
    return [("not_null:" + c, F.col(c).isNull(), F.lit(None)) for c in spec.get("not_null", [])]


def _precision_rules(spec) -> list[tuple[str, Column, Column]]:
    # A NUMERIC column rounds extra decimals on write, so only integer digits can overflow.
    out = []
    for c, (p, s) in spec.get("numeric", {}).items():
        over = F.abs(F.round(F.col(c).cast("double"), s)) >= F.lit(float(10 ** (p - s)))
        out.append((f"numeric({p},{s}):{c}", over, F.col(c).cast("decimal(38,4)")))
    for c, n in spec.get("varchar", {}).items():
        out.append((f"varchar({n}):{c}", F.length(F.col(c)) > n, F.length(F.col(c))))
    return out


def _row_check(tables, constraints, make_rules) -> DataFrame:
    parts = []
    for name, spec in constraints.items():
        if name in tables:
            part = _row_rules(tables[name], name, spec["pk"], make_rules(spec))
            if part is not None:
                parts.append(part)
    return _union(parts, next(iter(tables.values())))


def check_domains(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """K3: CHECK constraints; like SQL, a check that evaluates to null passes."""
    return _row_check(tables, constraints, _domain_rules)


def check_not_null(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """K4: NOT NULL columns holding nulls."""
    return _row_check(tables, constraints, _not_null_rules)


def check_precision(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """K5: values too large for NUMERIC(p, s) and strings longer than VARCHAR(n)."""
    return _row_check(tables, constraints, _precision_rules)


def check_rows(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """K3 + K4 + K5 in a single pass per table."""
    return _row_check(tables, constraints,
                      lambda spec: _domain_rules(spec) + _not_null_rules(spec) + _precision_rules(spec))


def audit_tables(tables: dict[str, DataFrame], constraints=CONSTRAINTS) -> DataFrame:
    """All checks K1-K5 in one result."""
    return reduce(DataFrame.unionByName, [
        check_primary_keys(tables, constraints), check_foreign_keys(tables, constraints),
        check_rows(tables, constraints)])
