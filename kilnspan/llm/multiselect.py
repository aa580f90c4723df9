"""Exact percentiles per group by distributed multi-select, and day results that combine.

A target is a rank within a group.  Each round, the partitions propose local quantiles
(their medians among them) of the values still in a target's range; the weighted median
of the proposals, shifted to the target's rank, becomes the pivot, with one more pivot on
either side; all values are counted below, at and above each pivot; the ranges that
cannot hold the rank are discarded.  Rounds go on until a target is met by a pivot or its
range holds at most ``FINISH`` values, which are then sorted.  All groups and targets
advance together, a round being two passes.  The rank error is 0.

Values are read from the table once: groups get numbers, and rows with their group's
numbers and values are cut to a narrow table (:class:`Numbered`), over which the rounds
pass.  A pass looks only at the scopes that still have ranges to narrow.

A percentile p of n values is the value of rank ceil(p n / 100), ties and repeated rows
counting each.  Values that are null, NaN, infinite or out of bounds don't count; a group
without values does not come out.  A null group key is a group of its own.

``summarise`` keeps m + 1 exact quantiles of each part (a day, a partition); ``combine``
merges parts of any number with a rank error of at most n / m + (number of parts).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, small_side, written

#: Local quantiles that a partition proposes for a range, while PROPOSED of all partitions allow.
PROPOSALS, PROPOSED = 64, 131_072
#: Values of a partition from which it proposes at a time; bounds what a task holds.
STRETCH = 1_000_000
#: A range of at most so many values is sorted; bounds what is gathered for one range.
FINISH = 4096
#: Rounds after which the operator gives up with an error; the range shrinks about tenfold a round.
MAX_ROUNDS = 60
#: Pivots of a group up to which they stand in columns of their own, for generated code; more stand in an array.
PIVOT_COLUMNS = 24


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


class Numbered:
    """Values with numbered groups: several columns of a table, grouped by all of ``keys`` and, as a second scope, by the first alone.

    ``sizes``: gid, n, the keys, scope (0: all keys, 1: the first alone) and metric of each
    group with values.  ``values(scopes)``: (gid, v) of the rows, for some of the scopes.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], keys: Sequence[str], low: float, high: float, scopes: Sequence[int] = (0,)) -> None:
        self.columns, self.width = list(columns), 2 * len(columns)
        good = [F.when(F.col(c).cast("double").between(low, high) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0) for c in columns]
        narrow = df.select(*keys, *[v.alias(f"v{k}") for k, v in enumerate(good)])
        counts = narrow.groupBy(*keys).agg(*[F.count(f"v{k}").alias(f"n{k}") for k in range(len(columns))])
        counts = cut(counts.withColumn("g0", F.monotonically_increasing_id()))
        if 1 in scopes:
            firsts = counts.groupBy(keys[0]).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(columns))])
            firsts = cut(firsts.withColumn("g1", F.monotonically_increasing_id()))
            ids = cut(counts.join(firsts.select(F.col(keys[0]).alias("__first"), "g1"), F.col(keys[0]).eqNullSafe(F.col("__first"))).select(*keys, "g0", "g1"))
        else:
            firsts, ids = None, counts.select(*keys, "g0", F.lit(None).cast("bigint").alias("g1"))
        self.sizes = cut(self._sizes(counts, firsts, keys))
        side = small_side(ids)
        self.rows = written(narrow.join(side, _on(narrow, side, keys)).select("g0", "g1", *[f"v{k}" for k in range(len(columns))]))

    def gid(self, scope: int, k: int) -> Column:
        """The number of a row's group in a scope and metric."""
        return F.col(f"g{scope}") * self.width + (2 * k + scope)

    def _sizes(self, counts: DataFrame, firsts: DataFrame | None, keys: Sequence[str]) -> DataFrame:
        parts = []
        for scope, table in ((0, counts), (1, firsts)):
            if table is not None:
                own = [F.col(c) if scope == 0 or c == keys[0] else F.lit(None).cast(dict(counts.dtypes)[c]).alias(c) for c in keys]
                each = F.inline(F.array(*[F.struct(self.gid(scope, k).alias("gid"), F.col(f"n{k}").alias("n"), F.lit(c).alias("metric")) for k, c in enumerate(self.columns)]))
                parts.append(table.select(*own, F.lit(scope).alias("scope"), each).where("n > 0"))
        return reduce(DataFrame.unionByName, parts)

    def values(self, scopes: Sequence[int]) -> DataFrame:
        each = [F.struct(self.gid(s, k).alias("gid"), F.col(f"v{k}").alias("v")) for s in scopes for k in range(len(self.columns))]
        return self.rows.select(F.inline(F.array(*each))).where("v is not null")


def multi_select(sizes: DataFrame, values: Callable[[Sequence[int]], DataFrame], ranks: Sequence[int], scale: int = 100, finish: int = FINISH, proposals: int | None = None) -> DataFrame:
    """(gid, i, value): for each group and each r of ranks, the value of rank ceil(r n / scale), at least 1.

    ``sizes`` holds gid, n and scope of each group (a cut table), ``values`` gives (gid, v)
    of some scopes, in cheap passes.  i is the place of r in ``ranks``.
    """
    wanted = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(ranks)]))
    targets = sizes.select("gid", "scope", "n", wanted).select(
        "gid",
        "scope",
        "i",
        F.greatest(F.lit(1), F.expr(f"(r * n + {scale - 1}) div {scale}")).alias("k"),
        F.lit(float("-inf")).alias("lo"),
        F.lit(float("inf")).alias("hi"),
        F.lit(0).cast("bigint").alias("below"),
        F.col("n").alias("left"),
        F.lit(None).cast("double").alias("value"),
    )
    targets = cut(targets)
    for _ in range(MAX_ROUNDS):
        wide = targets.where(F.col("value").isNull() & (F.col("left") > finish))
        scopes = [r["scope"] for r in wide.select("scope").distinct().collect()]  # at most two
        if not scopes:
            break
        targets = _round(values(scopes), targets, wide, len(ranks), proposals)
    else:
        raise RuntimeError("ranges did not shrink")
    last = targets.where("value is null")
    ranges = cut(last.select("gid", "lo", "hi", "below").distinct().withColumn("rid", F.monotonically_increasing_id()))
    whole = (F.col("lo") == float("-inf")) & (F.col("hi") == float("inf"))
    spans = ranges.groupBy("gid").agg(F.max(F.when(whole, F.col("rid"))).alias("whole"), F.collect_list(F.struct("lo", "hi", "rid")).alias("spans"))
    held = F.transform(F.filter("spans", lambda s: (s["lo"] < F.col("v")) & (F.col("v") < s["hi"])), lambda s: s["rid"])
    inside = values([0, 1] if _has(sizes, 1) else [0]).join(small_side(cut(spans)), "gid")
    inside = inside.select("v", F.explode(F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(held)).alias("rid"))
    # A range holds at most ``finish`` values, so sorting one is one small task.
    place = F.row_number().over(Window.partitionBy("rid").orderBy("v")).cast("bigint")
    placed = inside.select("rid", "v", place.alias("place"))
    asked = last.join(ranges, ["gid", "lo", "hi", "below"]).select("gid", "i", F.col("rid"), (F.col("k") - F.col("below")).alias("place"))
    ended = placed.join(small_side(cut(asked)), ["rid", "place"]).select("gid", "i", F.col("v").alias("value"))
    return targets.where("value is not null").select("gid", "i", "value").unionByName(ended)


def _has(sizes: DataFrame, scope: int) -> bool:
    return not sizes.where(F.col("scope") == scope).isEmpty()


def _proposer(proposals: int):
    """Of each stretch of a partition: for each range its quantiles 0/p, 1/p ... p/p with the number of values that each stands for."""

    def propose(held: list[pd.DataFrame]) -> pd.DataFrame:
        gid, lo, hi, v = (np.concatenate([h[c].to_numpy() for h in held]) for c in ("gid", "lo", "hi", "v"))
        order = np.lexsort([v, lo, gid])
        gid, lo, hi, v = gid[order], lo[order], hi[order], v[order]
        starts = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (lo[1:] != lo[:-1])])
        counts = np.diff(np.r_[starts, len(v)])
        several = np.minimum(proposals, counts - 1) + 1  # no more than there are values
        of = np.repeat(np.arange(len(starts)), several)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(several) - several, several)
        at = starts[of] + (nth * (counts[of] - 1)) // np.maximum(several[of] - 1, 1)
        return pd.DataFrame({"gid": gid[at], "lo": lo[at], "hi": hi[at], "q": v[at], "weight": counts[of] / several[of]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= STRETCH:
                yield propose(held)
                held.clear()
        if held:
            yield propose(held)

    return run


def _round(long: DataFrame, targets: DataFrame, wide: DataFrame, ranks: int, proposals: int | None) -> DataFrame:
    """One round: local quantiles, pivots, counts, narrower ranges."""
    proposals = proposals or max(3, min(PROPOSALS, PROPOSED // max(1, long.rdd.getNumPartitions())))
    spans = cut(wide.select("gid", "lo", "hi").distinct().groupBy("gid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    first = F.get("spans", F.lit(0))
    held = F.filter("spans", lambda s: (s["lo"] < F.col("v")) & (F.col("v") < s["hi"]))
    in_first = F.when((first["lo"] < F.col("v")) & (F.col("v") < first["hi"]), F.array(first)).otherwise(F.array().cast("array<struct<lo:double,hi:double>>"))
    inside = long.join(small_side(spans), "gid").select("gid", "v", F.explode(F.when(F.size("spans") == 1, in_first).otherwise(held)).alias("s"))
    local = inside.select("gid", "s.lo", "s.hi", "v").mapInPandas(_proposer(proposals), "gid bigint, lo double, hi double, q double, weight double")
    local = local.groupBy("gid", "lo", "hi", "q").agg(F.sum("weight").alias("weight"))
    run = Window.partitionBy("gid", "lo", "hi").orderBy("q")
    local = local.select("gid", "lo", "hi", "q", (F.sum("weight").over(run) / F.sum("weight").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("f"))
    at = (F.col("k") - F.col("below")) / F.col("left")
    margin = 1.5 / proposals
    picked = wide.withColumn("at", at).join(local, ["gid", "lo", "hi"]).groupBy("gid", "i").agg(
        F.coalesce(F.max(F.when(F.col("f") <= F.col("at") - margin, F.col("q"))), F.min("q")).alias("p1"),
        F.coalesce(F.min(F.when(F.col("f") >= F.col("at"), F.col("q"))), F.max("q")).alias("p2"),
        F.coalesce(F.min(F.when(F.col("f") >= F.col("at") + margin, F.col("q"))), F.max("q")).alias("p3"),
    )
    picked = picked.groupBy("gid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("p1", "p2", "p3"))))).alias("pivots"))
    pivots = cut(picked)
    # Slot 2 j lies below pivot j, slot 2 j + 1 is pivot j itself: below, at and above, for all pivots at once.
    v = F.col("v")
    if 3 * ranks <= PIVOT_COLUMNS:
        each = [f"__p{j}" for j in range(3 * ranks)]
        side = pivots.select("gid", *[F.get("pivots", F.lit(j)).alias(c) for j, c in enumerate(each)])
        slot = reduce(lambda a, b: a + b, [F.when(F.col(c) < v, 2).when(F.col(c) == v, 1).otherwise(0) for c in each])
    else:
        side = pivots
        under = F.size(F.filter("pivots", lambda p: p < v))
        slot = 2 * under + F.when(F.get("pivots", under) == v, 1).otherwise(0)
    counts = long.join(small_side(side), "gid").groupBy("gid", slot.alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("gid").orderBy("slot")
    counts = counts.select("gid", "slot", "c", (F.sum("c").over(upto) - F.col("c")).alias("before"))
    slots = counts.join(pivots, "gid").select(
        "gid",
        "before",
        "c",
        F.when(F.col("slot") % 2 == 1, F.get("pivots", ((F.col("slot") - 1) / 2).cast("int"))).alias("hit"),
        F.coalesce(F.get("pivots", F.floor(F.col("slot") / 2).cast("int") - 1), F.lit(float("-inf"))).alias("from"),
        F.coalesce(F.get("pivots", F.floor(F.col("slot") / 2).cast("int")), F.lit(float("inf"))).alias("to"),
    )
    moved = wide.drop("value").join(slots, "gid").where((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("c")))
    moved = moved.select("gid", "scope", "i", "k", F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("before").alias("below"), F.col("c").alias("left"), F.col("hit").alias("value"))
    rest = targets.join(wide.select("gid", "i"), ["gid", "i"], "left_anti")
    return cut(rest.select(moved.columns).unionByName(moved))


# ---------------------------------------------------------------- percentiles of a report


def percentiles(df: DataFrame, columns: Sequence[str], group: str, part: str, percents: Sequence[int] = (25, 50, 75, 99), low: float = -1.0, high: float = 1.0, finish: int = FINISH) -> DataFrame:
    """Percentiles of several columns per group, and per group and part (a day).

    Columns out: group, part (null in rows over all parts), all_parts, metric, n, rank_error, p25, ...
    """
    table = Numbered(df, columns, [group, part], low, high, scopes=(0, 1))
    found = multi_select(table.sizes, table.values, percents, finish=finish)
    wide = found.groupBy("gid").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"p{p}") for i, p in enumerate(percents)])
    keyed = table.sizes.join(wide, "gid")
    return keyed.select(group, part, (F.col("scope") == 1).alias("all_parts"), "metric", "n", F.lit(0).alias("rank_error"), *[f"p{p}" for p in percents])


def summarise(df: DataFrame, columns: Sequence[str], keys: Sequence[str], m: int = 64, low: float = -1.0, high: float = 1.0, finish: int = FINISH) -> DataFrame:
    """(keys, metric, n, m, points): the exact quantiles 0/m, 1/m ... m/m of each part; a summary combines with any other of its m."""
    table = Numbered(df, columns, keys, low, high)
    found = multi_select(table.sizes, table.values, range(m + 1), scale=m, finish=finish)
    points = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"])
    return table.sizes.join(found.groupBy("gid").agg(points.alias("points")), "gid").select(*keys, "metric", "n", "points", F.lit(m).alias("m"))


def combine(summaries: DataFrame, keys: Sequence[str], percents: Sequence[int] = (25, 50, 75, 99)) -> DataFrame:
    """Percentiles of the union of the parts, from their summaries alone.

    Each point but the first stands for the values since the point before it, so a part's
    counts are off by less than n_part / m + 1 at any value; ``rank_error`` states the sum.
    """
    keys = [*keys, "metric"]
    points = summaries.select(*keys, "n", "m", F.posexplode("points").alias("i", "v")).where("i > 0")
    share = F.col("n") / F.col("m")
    weight = F.ceil(F.col("i") * share) - F.ceil((F.col("i") - 1) * share)
    values = points.groupBy(*keys, "v").agg(F.sum(weight).alias("w"))
    totals = summaries.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.ceil(F.col("n") / F.col("m")) + 1).alias("rank_error"))
    upto = Window.partitionBy(*keys).orderBy("v")
    ranked = values.select(*keys, "v", F.sum("w").over(upto).alias("upto"))
    both = ranked.alias("r").join(totals.alias("t"), _on(ranked, totals, keys))
    pick = [F.min(F.when(F.col("upto") >= F.expr(f"({p} * t.n + 99) div 100"), F.col("v"))).alias(f"p{p}") for p in percents]
    return both.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("t.n").alias("n"), F.col("t.rank_error").alias("rank_error")).agg(*pick)
