"""As-of joins: each fact with the latest state strictly before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import require_empty


def latest_before(facts: DataFrame, states: DataFrame, on: str, by: Sequence[str] = (), take: Sequence[str] = (), required: bool = False, lanes: int = 1) -> DataFrame:
    """Facts with the columns ``take`` (and ``state_{on}``) of the latest state with a smaller ``on``.

    Both sides are laid into one stream per group and swept once: no range join, no pairs.
    ``lanes`` > 1 splits each group's axis into so many ranges that are swept apart; the
    last state of the ranges before is carried in (for groups that hold much of the data).
    States with equal ``on`` are ties: the largest of ``take`` wins.  Facts whose ``on`` is null have no state.
    """
    by, take = list(by), list(take)
    state_cols = [F.col(on).alias(f"state_{on}"), *[F.col(c) for c in take]]
    best = states.where(F.col(on).isNotNull()).select(*by, on, F.struct(*take, F.lit(1).alias("__one")).alias("__t"))
    best = best.groupBy(*by, on).agg(F.max("__t").alias("__t")).select(*by, on, *[F.col("__t")[c].alias(c) for c in take])
    rest = [c for c in facts.columns if c not in (*by, on)]
    left = facts.select(*by, on, F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in rest], F.lit(1).alias("__one")).alias("__fact"), F.lit(None).alias("__state"))
    right = best.select(*by, on, F.lit(1).alias("__side"), F.lit(None).alias("__fact"), F.struct(*state_cols).alias("__state"))
    both = left.unionByName(right)
    lane = []
    if lanes > 1:
        both = both.withColumn("__x", _axis(both, on))
        ends = both.groupBy(*by).agg(F.min("__x").alias("__a"), F.max("__x").alias("__b"))
        width = F.greatest(F.lit(1.0), (F.col("__b") - F.col("__a") + 1) / lanes)
        both = both.join(ends.select(*[F.col(c).alias(f"__k{c}") for c in by], "__a", "__b"), _same(both, by))
        both = both.withColumn("__lane", F.coalesce(F.floor((F.col("__x") - F.col("__a")) / width), F.lit(0))).drop("__a", "__b", "__x", *[f"__k{c}" for c in by])
        lane = ["__lane"]
    sweep = Window.partitionBy(*by, *lane).orderBy(F.col(on).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, -1)
    swept = both.withColumn("__s", F.last("__state", ignorenulls=True).over(sweep))
    if lanes > 1:
        carry = Window.partitionBy(*by).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
        ends = both.groupBy(*by, "__lane").agg(F.max_by("__state", F.when(F.col("__side") == 1, F.col(on))).alias("__e"))
        ends = ends.withColumn("__c", F.last("__e", ignorenulls=True).over(carry)).select(*[F.col(c).alias(f"__k{c}") for c in by], F.col("__lane").alias("__k"), "__c")
        swept = swept.join(ends, _same(swept, by) & (F.col("__lane") == F.col("__k")), "left").withColumn("__s", F.coalesce("__s", "__c"))
    out = swept.where("__side = 0").select(*by, on, *[F.col("__fact")[c].alias(c) for c in rest], F.when(F.col(on).isNotNull(), F.col("__s")).alias("__s"))
    out = out.select(*facts.columns, f"__s.state_{on}", *[f"__s.{c}" for c in take])
    if required:
        require_empty(out.where(F.col(f"state_{on}").isNull()).select(*by, on), "no state before")
    return out


def _axis(df: DataFrame, on: str):
    """The ordering column as a double (times in microseconds)."""
    kind = dict(df.dtypes)[on]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(on).cast("timestamp")).cast("double")
    return F.col(on).cast("double")


def _same(df: DataFrame, by: Sequence[str]):
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k{c}"))
    return same
