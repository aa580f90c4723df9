"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule: a step function of training time, made of the
decisions' weights.  Integrating it gives the source's cumulative token demand
``D(t)``; its rows, laid end to end, occupy token offsets, and the row at offset ``c``
trains at the time ``t`` with ``D(t) = c`` (the demand inverted: the schedule stands as a
prefix-summed table of all its changes, with which the offsets are merged).  Rows are then
range-sorted by that position.  A source whose demand exceeds its tokens is passed over
again, at most ``max_repeats`` times in all.

Windows already drawn are judged by the same means (:func:`judge_windows`): laid end to end, a
run's windows are its schedule over positions; it is integrated to each source's cumulative
demand, and the demand inverted at the draws of each window tells by how many positions a
source is ahead or behind.  What comes near the tolerance is then checked exactly, against
the normalised weight.

Defined results: weights are usable when there are exactly as many as sources, all finite,
none null or negative; with no usable weights all sources weigh the same.  Rows of null,
zero or negative size hold nothing to train on and are not drawn; neither are rows whose
dataset is null or of no source.  Null, repeated and unsorted rows are no error.  Weights
that sum to 0 give no target share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Most rows of mixture_sources, which is read to the driver: it has one row per source.
MAX_SOURCES = 10_000
#: Rows of a source per block of the two-level prefix sum and per range of the merge; times per range of the schedule.
BLOCK_ROWS = 50_000


def sources_of(sources: DataFrame) -> list[dict]:
    """The source table on the driver, sorted by dataset_id; its size is checked, repeated ids keep the smallest caps."""
    table = sources.groupBy("dataset_id").agg(F.min("record_count").alias("record_count"), F.min("max_repeats").alias("max_repeats"))
    rows = table.where("dataset_id is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted((r.asDict() for r in rows), key=lambda r: r["dataset_id"])


def usable(weights: Column, n: int) -> Column:
    """Whether an array of weights has one finite weight of at least 0 for each of n sources."""
    good = F.forall(weights, lambda w: w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf")))
    return F.coalesce((F.size(weights) == n) & good, F.lit(False))


def shares(weights: Column) -> Column:
    """Weights over their sum, the demand of one unit of the schedule; null elements where the sum is 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.transform(weights, lambda w: F.try_divide(w, total))


# ---------------------------------------------------------------- windows already drawn


def judge_windows(windows: DataFrame, decisions: DataFrame, sources: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Faults of drawn windows: (run_id, window_id, dataset_id, fault), distinct.

    Arrays are reduced to counts inside their row before anything is shuffled; expressions
    are as large for many sources as for few.
    """
    src = sources_of(sources)
    n, ids = len(src), [s["dataset_id"] for s in src]
    if not src:
        return windows.select("run_id", "window_id", F.lit(None).cast("int").alias("dataset_id"), F.lit(None).cast("string").alias("fault")).where("false")
    table = F.create_map(*[x for s in src for x in (F.lit(s["dataset_id"]), F.struct(F.lit(s["record_count"]).cast("bigint").alias("records"), F.lit(s["max_repeats"]).cast("int").alias("cap")))])
    of = lambda d: F.element_at(table, d)
    pairs = F.filter(F.arrays_zip(F.col("dataset_index").alias("d"), F.col("dataset_sample_index").alias("s")), lambda x: x["d"].isin(ids))
    record = F.transform(pairs, lambda x: F.struct(x["d"].alias("d"), F.when(of(x["d"])["records"] > 0, F.pmod(x["s"], of(x["d"])["records"])).alias("r")))
    rows = windows.select("run_id", "window_id", "decision_id", F.when(usable(F.col("weights"), n), F.col("weights")).alias("weights"), F.array_sort(record).alias("drawn"))
    # In sorted order, a record drawn more than m times equals the one m places further on.
    again = lambda x, i: F.when(x["r"].isNotNull() & (F.get("drawn", i + of(x["d"])["cap"]) == x), x["d"])
    # ... and a source's draws are neighbours: its count is the way to the next source's first.
    places = F.when(F.size("drawn") > 0, F.sequence(F.lit(0), F.size("drawn") - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(places, lambda i: (i == 0) | (F.get("drawn", i)["d"] != F.get("drawn", i - 1)["d"]))
    rows = rows.withColumn("firsts", firsts)
    counted = F.map_from_entries(F.transform("firsts", lambda i, j: F.struct(F.get("drawn", i)["d"], F.coalesce(F.get("firsts", j + 1), F.size("drawn")) - i)))
    rows = rows.withColumn("counted", counted)
    compact = rows.select(
        "run_id",
        "window_id",
        "decision_id",
        "weights",
        F.size("drawn").alias("positions"),
        F.transform(F.array(*map(F.lit, ids)), lambda d: F.coalesce(F.element_at("counted", d), F.lit(0))).alias("counts"),
        F.array_distinct(F.filter(F.transform("drawn", again), lambda d: d.isNotNull())).alias("repeated"),
    )
    latest = decisions.groupBy("run_id", "decision_id").agg(F.max_by("weights", F.coalesce("produced_at_unix_ns", F.lit(0))).alias("decided"))
    decided = latest.where(usable(F.col("decided"), n))
    judged = cut(compact.join(decided, ["run_id", "decision_id"], "left").withColumn("target", shares(F.coalesce("weights", "decided"))).drop("weights", "decided"))
    repeats = judged.select("run_id", "window_id", F.explode("repeated").alias("dataset_id"), F.lit("repeats").alias("fault"))
    off = _off_demand(judged, tolerance)
    share = off.select("run_id", "window_id", F.element_at(F.array(*map(F.lit, ids)), F.col("i") + 1).alias("dataset_id"), F.lit("share").alias("fault"))
    return repeats.unionByName(share).distinct()


def _off_demand(judged: DataFrame, tolerance: float) -> DataFrame:
    """(run_id, window_id, i): sources whose draws in a window are off the demand by more than a tolerance of its positions."""
    each = F.posexplode(F.arrays_zip(F.col("counts").alias("drawn"), F.col("target").alias("share"))).alias("i", "x")
    spans = judged.where("positions > 0 and target is not null").select("run_id", "window_id", "positions", each)
    spans = spans.select("run_id", "window_id", "i", "positions", F.col("x.drawn").alias("drawn"), F.col("x.share").alias("share")).where("share is not null")
    spans = spans.withColumns({"part": (F.col("share") * F.col("positions")).cast("decimal(28,12)"), "length": F.col("positions").cast("decimal(28,12)")})
    laid = cumulated(spans, ["run_id", "i"], "window_id", {"part": "c", "length": "t"})
    reached = invert(F.col("c0") + F.col("drawn"), *(F.col(x) for x in ("c0", "c1", "t0", "t1")))
    ahead = F.when(F.col("c1") > F.col("c0"), (reached - F.col("t1")) * (F.col("c1") - F.col("c0")) / (F.col("t1") - F.col("t0"))).otherwise(F.col("drawn").cast("double"))
    near = laid.where(F.abs(ahead) > (tolerance - 1e-6) * F.col("positions"))
    exact = F.abs(F.col("drawn").cast("double") / F.col("positions").cast("double") - F.col("share")) > tolerance
    return near.where(exact).select("run_id", "window_id", "i")


def invert(x: Column, c0: Column, c1: Column, t0: Column, t1: Column) -> Column:
    """The time at which a demand that grows in a straight line from (t0, c0) to (t1, c1) reaches x (t0 where it doesn't grow)."""
    return t0 + F.coalesce(F.try_divide(x - c0, c1 - c0), F.lit(0.0)) * (t1 - t0)


def cumulated(parts: DataFrame, by: Sequence[str], at: str, columns: Mapping[str, str]) -> DataFrame:
    """Running sums of decimal columns in the order of ``at`` within ``by``: name -> prefix gives prefix0 (before the row) and prefix1 (with it), in double.

    In two levels, ranges of ``at`` and rows within a range, so no group is one task's work.
    """
    ranges = max(1, -(-parts.count() // BLOCK_ROWS))
    spread = cut(parts.repartitionByRange(ranges, at).withColumn("__range", F.spark_partition_id())) if ranges > 1 else parts.withColumn("__range", F.lit(0))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    sums = sums.select(*by, "__range", *[F.coalesce(F.sum(f"__{c}").over(upto), F.lit(0)).alias(f"__{c}") for c in columns])
    within = Window.partitionBy(*by, "__range").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    run = spread.select("*", *[F.sum(c).over(within).alias(f"__w_{c}") for c in columns])
    both = run.join(sums, [*by, "__range"]) if ranges > 1 else run.withColumns({f"__{c}": F.lit(0) for c in columns})
    ends = {f"{prefix}1": (F.col(f"__{c}") + F.col(f"__w_{c}")).cast("double") for c, prefix in columns.items()}
    starts = {f"{prefix}0": (F.col(f"__{c}") + F.col(f"__w_{c}") - F.col(c)).cast("double") for c, prefix in columns.items()}
    return both.withColumns(starts | ends).drop("__range", *[f"__{c}" for c in columns], *[f"__w_{c}" for c in columns])


# ---------------------------------------------------------------- a mix along the curriculum


def held_weights(decisions: DataFrame, n: int) -> DataFrame:
    """From when (a) until when (b) each usable decision holds, with its weights w summing to 1.

    A decision holds from its effective_training_iteration to the run's next one, the last
    as long as the one before it.
    """
    fit = decisions.where(usable(F.col("weights"), n) & F.col("effective_training_iteration").isNotNull())
    fit = fit.groupBy("run_id", F.col("effective_training_iteration").alias("a")).agg(F.max_by("weights", F.struct("produced_at_unix_ns", "decision_id")).alias("weights"))
    order = Window.partitionBy("run_id").orderBy("a")
    spans = fit.select("*", F.lead("a").over(order).alias("b"), (F.col("a") - F.lag("a").over(order)).alias("before"))
    return spans.select("a", F.coalesce("b", F.col("a") + F.coalesce("before", F.lit(1))).alias("b"), shares(F.col("weights")).alias("w")).where("w[0] is not null")


def demand_segments(decisions: DataFrame, n: int) -> DataFrame:
    """The integrated schedule, exact at the decisions' own times: (i, t0, t1, c0, c1).

    Between two neighbouring times at which any decision begins or ends, the demand of source i
    grows in a straight line from c0 to c1, as shares of all tokens, while the position grows
    from t0 to t1; stretches without demand are left out.  Runs weigh the same at every time,
    and times at which none holds get the mean of all.  Sums are decimal, so that what a
    decision adds at its beginning is taken away at its end, to the last digit.  Prefix sums
    are taken in two levels, ranges of time and times within a range.
    """
    spark = decisions.sparkSession
    spans = cut(held_weights(decisions, n))
    ends = spans.agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum(F.col("b") - F.col("a")).alias("held")).first()
    if ends["a"] is None:
        return spark.range(n).select(F.col("id").cast("int").alias("i"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(0.0).alias("c0"), F.lit(1 / n).alias("c1"))
    low, length = ends["a"], float(ends["b"] - ends["a"])
    each = spans.select("a", "b", F.posexplode("w").alias("i", "w")).withColumn("w", F.col("w").cast("decimal(20,18)"))
    mean = each.groupBy("i").agg((F.sum(F.col("w").cast("double") * (F.col("b") - F.col("a"))) / F.lit(float(ends["held"]))).alias("mean"))
    turns = each.select("i", F.inline(F.array(F.struct(F.col("a").alias("t"), F.col("w").alias("dw"), F.lit(1).alias("dn")), F.struct(F.col("b").alias("t"), (-F.col("w")).alias("dw"), F.lit(-1).alias("dn")))))
    turns = cut(turns.groupBy("i", "t").agg(F.sum("dw").cast("decimal(28,18)").alias("dw"), F.sum("dn").alias("dn")))
    times = -(-turns.count() // n)
    turns = cut(turns.repartitionByRange(-(-times // BLOCK_ROWS), "t").withColumn("__range", F.spark_partition_id()))

    per_source = Window.partitionBy("i").orderBy("__range")
    upto = per_source.rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("i", "__range").orderBy("t")
    ranges = turns.groupBy("i", "__range").agg(F.min("t").alias("first"), F.sum("dw").alias("dw"), F.sum("dn").alias("dn"))
    ranges = ranges.select("i", "__range", F.lead("first").over(per_source).alias("next"), F.coalesce(F.sum("dw").over(upto), F.lit(0)).alias("w_base"), F.coalesce(F.sum("dn").over(upto), F.lit(0)).alias("n_base"))
    turns = turns.select("*", F.lead("t").over(within).alias("later"), F.sum("dw").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("w"), F.sum("dn").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    holding = turns.join(ranges, ["i", "__range"]).join(F.broadcast(mean), "i").withColumn("u", F.coalesce("later", "next")).where("u is not null")
    rate = F.when(F.col("n") + F.col("n_base") > 0, (F.col("w") + F.col("w_base")).cast("double") / (F.col("n") + F.col("n_base"))).otherwise(F.col("mean"))
    parts = cut(holding.select("i", "__range", "t", "u", (rate * (F.col("u") - F.col("t")) / F.lit(length)).cast("decimal(28,24)").alias("part")))

    at = lambda t: (F.col(t) - F.lit(low)) / F.lit(length)
    upon = cumulated(parts.drop("__range"), ["i"], "t", {"part": "c"}).where("part > 0")
    return cut(upon.select("i", at("t").alias("t0"), at("u").alias("t1"), "c0", "c1"))


def place(drawn: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows with ``position``, the time at which their source's demand reaches their ``x``.

    Rows and segments are merged in order of demand, in ``bins`` ranges per source, so no
    source is one task's work; a segment lies in each range that it touches.  Both carry
    ``bins`` and the source's whole demand, ``share``.
    """
    bin_of = lambda x: F.least(F.floor(F.col(x) / F.col("share") * F.col("bins")), F.col("bins") - 1)
    cover = segments.withColumn("__bin", F.explode(F.sequence(bin_of("c0"), bin_of("c1"))))
    cover = cover.select("dataset_id", "__bin", F.col("c0").alias("x"), F.struct("c1", "c0", "t0", "t1").alias("__segment"))
    both = drawn.withColumn("__bin", bin_of("x")).withColumn("__row", F.lit(True)).unionByName(cover, allowMissingColumns=True)
    order = Window.partitionBy("dataset_id", "__bin").orderBy("x", F.col("__row").asc_nulls_first(), "__segment.c1").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__segment", F.last("__segment", ignorenulls=True).over(order)).where("__row")
    c1, c0, t0, t1 = (F.col(f"__segment.{f}") for f in ("c1", "c0", "t0", "t1"))
    return met.withColumn("position", F.least(t1, invert(F.col("x"), c0, c1, t0, t1)))


def mix(rows: DataFrame, decisions: DataFrame, sources: DataFrame, key: str = "row_id", size: str = "target_token_count", total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(schedule, shares) of a mix.

    schedule: position in [0, 1), row_id, dataset_id, copy, tokens, range-sorted by position.
    shares: dataset_id, target_share, actual_share, tokens, repeats, pool_tokens.

    Without ``total_tokens`` the mix is as large as the caps allow while every source keeps
    its share.  With more than that, capped sources give what they may and the report
    shows the smaller share.  Rows of a source follow a hash of their key; its prefix sums
    are taken in two levels, blocks and rows within a block, so no source is one task's work.
    """
    src = sources_of(sources)
    spark = rows.sparkSession
    if not src:
        empty = spark.createDataFrame([], f"position double, {key} bigint, dataset_id int, copy int, tokens bigint")
        return empty, spark.createDataFrame([], "dataset_id int, target_share double, actual_share double, tokens bigint, repeats int, pool_tokens bigint")
    ids = [s["dataset_id"] for s in src]
    pool = rows.where(F.col("dataset_id").isin(ids) & (F.col(size) > 0)).select(F.col(key).alias("__key"), "dataset_id", F.col(size).cast("bigint").alias("tokens"))
    sums = {r["dataset_id"]: (r["tokens"], r["rows"]) for r in pool.groupBy("dataset_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()}
    segments = demand_segments(decisions, len(src))
    share = np.zeros(len(src))
    for r in segments.groupBy("i").agg(F.max("c1").alias("c1")).collect():
        share[r["i"]] = r["c1"]
    have = np.array([float(sums.get(d, (0, 0))[0]) for d in ids])
    cap = np.array([np.inf if s["max_repeats"] is None else max(0, s["max_repeats"]) for s in src])
    most = min((float(h * c / w) for h, c, w in zip(have, cap, share, strict=True) if w > 0), default=0.0)
    total = float(total_tokens) if total_tokens is not None else (most if np.isfinite(most) else float(have.sum()))
    wanted = np.minimum(share * total, have * np.where(np.isfinite(cap), cap, share * total + 1))
    bins = [1 + int(sums.get(d, (0, 0))[1] * x / h / BLOCK_ROWS) if h else 1 for d, h, x in zip(ids, have, wanted, strict=True)]
    plan = spark.createDataFrame(
        [(i, d, float(h), float(x), float(w), b) for i, (d, h, x, w, b) in enumerate(zip(ids, have, wanted, share, bins, strict=True))],
        "i int, dataset_id int, pool double, wanted double, share double, bins bigint",
    )

    bits = int(np.ceil(np.log2(max(1, max((r for _, r in sums.values()), default=1) / BLOCK_ROWS)))) if sums else 0
    copied = pool.groupBy("__key", "dataset_id", "tokens").agg(F.count(F.lit(1)).alias("__n")).withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    hashed = copied.withColumn("__h", F.xxhash64("__key", "__nth", F.lit(seed))).withColumn("__block", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    blocks = hashed.groupBy("dataset_id", "__block").agg(F.sum("tokens").alias("__sum"))
    before = Window.partitionBy("dataset_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("dataset_id", "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("dataset_id", "__block").orderBy("__h", "__key", "tokens", "__nth").rowsBetween(Window.unboundedPreceding, -1)
    laid = hashed.join(blocks, ["dataset_id", "__block"]).withColumn("__offset", F.col("__base") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    copies = F.ceil((F.col("wanted") - F.col("__offset")) / F.col("pool")).cast("int")
    drawn = laid.join(F.broadcast(plan), "dataset_id").withColumn("__copies", copies).where("__copies > 0")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))

    offset = F.col("__offset") + F.col("copy") * F.col("pool")
    drawn = drawn.select(F.col("__key").alias(key), "dataset_id", "copy", "tokens", (offset / F.lit(total or 1.0)).alias("x"), "share", "bins")
    placed = place(drawn, segments.join(F.broadcast(plan), "i")).select("position", key, "dataset_id", "copy", "tokens")
    schedule = placed.orderBy("position", "dataset_id", key, "copy")
    got = drawn.groupBy("dataset_id").agg(F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("repeats"))
    target = spark.createDataFrame([(d, float(w), int(h)) for d, w, h in zip(ids, share, have, strict=True)], "dataset_id int, target_share double, pool_tokens bigint")
    report = F.broadcast(target).join(got, "dataset_id", "left").select(
        "dataset_id",
        "target_share",
        F.expr("coalesce(try_divide(cast(coalesce(tokens, 0) as double), cast(sum(tokens) over () as double)), 0D)").alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
        "pool_tokens",
    )
    return schedule, report
