"""Exact percentiles of groups of any size, by ranks over distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, small_side


def linear_percentiles(rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """(by, q): exact percentiles of each group, linearly interpolated between the two ranks around (n - 1) fraction.

    Equal values are counted before anything moves, so ties are one row; distinct values are
    sorted in ranges, and ranks come from the ranges' counts, so no group is one task's work.
    Nulls don't count; a group without values does not come out.
    """
    by = list(by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    spread = cut(counted.repartitionByRange(*[F.col(c) for c in (*by, "v")]).withColumn("part", F.spark_partition_id()))
    parts = spread.groupBy(*by, "part").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy(*by).orderBy("part")
    parts = parts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("part").alias("__part"), (F.sum("c").over(upto) - F.col("c")).alias("base"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    same = F.col("part") == F.col("__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*by, "part").orderBy("v")
    ranked = spread.withColumn("r", F.sum("c").over(within)).join(small_side(cut(parts)), same)
    ranked = ranked.select(*by, "v", "n", (F.col("base") + F.col("r") - F.col("c")).alias("lo"), (F.col("base") + F.col("r")).alias("hi"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(f) * (F.col("n") - 1)).alias("x")) for i, f in enumerate(fractions)])
    ends = F.flatten(F.transform(at, lambda t: F.array(F.struct(t["i"].alias("i"), t["x"].alias("x"), F.floor(t["x"]).alias("k")), F.struct(t["i"].alias("i"), t["x"].alias("x"), F.ceil(t["x"]).alias("k")))))
    hits = ranked.select(*by, "v", F.explode(F.filter(ends, lambda e: (F.col("lo") <= e["k"]) & (e["k"] < F.col("hi")))).alias("e"))
    low, high = F.min("v"), F.max("v")
    each = hits.groupBy(*by, F.col("e.i").alias("i")).agg((low + (F.max("e.x") - F.floor(F.max("e.x"))) * (high - low)).alias("p"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("q"))
