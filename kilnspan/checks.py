"""Checks that fail loudly: violations are counted in one job, then raised together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(RuntimeError):
    """Stored rows break a rule that the analysis relies on."""


def violations(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, int]:
    """Number of rows that break each rule (a rule is true, or null, for rows in order); one aggregation."""
    if not rules:
        return {}
    row = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())]).first()
    return {name: row[i] for i, name in enumerate(rules) if row[i]}


def require(df: DataFrame, rules: Mapping[str, Column], what: str) -> DataFrame:
    """The rows themselves, if all are in order."""
    if broken := violations(df, rules):
        raise DataError(f"{what}: " + "; ".join(f"{name}: {n} rows" for name, n in broken.items()))
    return df


def require_empty(df: DataFrame, what: str, show: int = 5) -> None:
    """Raise if there is any row, naming a few."""
    if rows := df.limit(show).collect():
        raise DataError(f"{what}: {[tuple(r) for r in rows]}")


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows themselves, if no key occurs twice."""
    require_empty(df.groupBy(*keys).count().where("count > 1").select(*keys), f"Duplicate {what}")
    return df


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with ``side``; empty for equal sets."""
    gone = left.exceptAll(right).withColumn("side", F.lit("left"))
    return gone.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur on one side only, with ``side``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    gone = a.join(b, keys, "left_anti").withColumn("side", F.lit("left"))
    return gone.unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
