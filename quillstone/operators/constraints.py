"""Data-quality constraints as operators: each gives the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, values: Sequence[str], nullable: bool = True) -> DataFrame:
    bad = ~F.col(column).isin(*values)
    return df.where(F.coalesce(bad, F.lit(not nullable)))


def breaking(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; null counts as passed, as in SQL."""
    return df.where(~F.coalesce(check, F.lit(True)))


def missing(df: DataFrame, *columns: str) -> DataFrame:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return df.where(out)


def repeated(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """Keys that more than one row has (of those that `where` takes in). Null keys never clash."""
    rows = df if where is None else df.where(where)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).count().where("count > 1")


def dangling(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't null and has no parent."""
    refs = parent.select(F.col(key).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(refs, column, "left_anti")


def open_versions(df: DataFrame, key: str, end: str = "superseded_date") -> DataFrame:
    """Keys with more than one open version."""
    return repeated(df, key, where=F.col(end).isNull())


def bad_intervals(df: DataFrame, start: str = "effective_date", end: str = "superseded_date") -> DataFrame:
    return breaking(df, F.col(end) > F.col(start))


def natural_key(df: DataFrame, columns: Sequence[str], long_text: Sequence[str] = ()) -> Column:
    """One key from many columns: nulls count as one value, long texts go in by their md5."""
    parts = [F.coalesce(F.md5(F.lower(F.trim(F.col(c).cast("string")))) if c in long_text else F.lower(F.trim(F.col(c).cast("string"))), F.lit("\x00")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def drop_repeats(df: DataFrame, columns: Sequence[str], order: Sequence[Column], long_text: Sequence[str] = ()) -> DataFrame:
    """The first row of each natural key."""
    keyed = df.withColumn("__k", natural_key(df, columns, long_text))
    return keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).where("__r = 1").drop("__k", "__r")


def report(**violations: DataFrame) -> DataFrame:
    """(rule, violations) for all rules, in one frame."""
    out = None
    for rule, rows in sorted(violations.items()):
        part = rows.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


def require_none(**violations: DataFrame) -> None:
    """An error that names every rule with violations; call it before a write."""
    found = [r for r in report(**violations).collect() if r.violations]  # one row for each rule
    if found:
        raise ValueError("; ".join(f"{r.rule}: {r.violations} rows" for r in found))
