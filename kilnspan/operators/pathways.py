"""Routing pathways: per-sample sequences, and consistency and edit distance over iteration windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import one_sided, require, require_empty
from ..functions.arrays import consistency, pathway_sequence, pathway_tokens, project, token_word
from ..session import cut, small_side

#: Different pathways of one dataset and iteration that are compared with as many at a time.
PAIR_BLOCK = 2_000
SAMPLE = ["model_id", "phase", "global_batch_id", "dp_rank", "microbatch_id", "sample_index"]


def assemble_samples(rows: DataFrame, layers: int, sample: Sequence[str] = SAMPLE, vector: str = "probs", strict: bool = True) -> DataFrame:
    """(sample, dataset_id, layers): each sample's vectors in layer order; strict: every layer once, one dataset."""
    out = rows.groupBy(*sample).agg(
        F.array_sort(F.collect_list(F.struct("layer_no", F.col(vector).alias("v")))).alias("__l"), F.min("dataset_id").alias("dataset_id"), F.max("dataset_id").alias("__d")
    )
    if strict:
        complete = F.transform("__l", lambda x: x["layer_no"]) == F.sequence(F.lit(0), F.lit(layers - 1))
        require(out, {"layers missing or repeated": complete, "several datasets": F.col("dataset_id").eqNullSafe(F.col("__d"))}, "samples")
    return out.select(*sample, "dataset_id", F.transform("__l", lambda x: x["v"]).alias("layers"))


def pathways(samples: DataFrame, threshold: float) -> DataFrame:
    """Add ``pathway``: the token sequence over all layers."""
    return samples.withColumn("pathway", pathway_sequence(F.transform("layers", lambda p: pathway_tokens(p, threshold))))


def sample_consistency(samples: DataFrame, states: DataFrame, eps: float, sample: Sequence[str] = SAMPLE, state: str = "state_id") -> DataFrame:
    """(sample, dataset_id, score): layers projected by their state's weights (state, layer_no, weights flat), then compared."""
    long = samples.select(*sample, "dataset_id", state, F.posexplode("layers").alias("layer_no", "probs"))
    projected = long.join(small_side(states.select(state, "layer_no", "weights")), [state, "layer_no"]).select(*sample, "dataset_id", "layer_no", project().alias("v"))
    stacked = projected.groupBy(*sample, "dataset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer_no", "v"))), lambda x: x["v"]).alias("vectors"))
    return stacked.select(*sample, "dataset_id", consistency(F.col("vectors"), eps).alias("score"))


def dense_iterations(iterations: DataFrame, iteration: str = "global_batch_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, iteration, rn): distinct iterations numbered from 1 without gaps."""
    order = Window.partitionBy(*by).orderBy(iteration) if by else Window.orderBy(iteration)
    return iterations.select(*by, iteration).distinct().withColumn("rn", F.row_number().over(order))


def window_members(samples: DataFrame, iterations: DataFrame, sizes: Sequence[int], iteration: str = "global_batch_id", by: Sequence[str] = ()) -> DataFrame:
    """Per (by, iteration, dataset) groups within growing, then sliding windows over the list of completed iterations.

    Each iteration is spread over the windows that hold it (an equi-key, no range join);
    samples must be reduced to one row per (by, iteration, dataset_id) before.
    """
    ranked = dense_iterations(iterations, iteration, by)
    last = ranked.groupBy(*by).agg(F.max("rn").alias("last")) if by else ranked.agg(F.max("rn").alias("last"))
    joined = samples.join(ranked, [*by, iteration])
    joined = joined.join(last, list(by)) if by else joined.crossJoin(F.broadcast(last))
    spread = joined.withColumn("window_size_iterations", F.explode(F.array(*map(F.lit, sizes))))
    spread = spread.withColumn("__end", F.explode(F.sequence("rn", F.least("last", F.col("rn") + F.col("window_size_iterations") - 1))))
    ends = ranked.select(*by, F.col("rn").alias("__end"), F.col(iteration).alias("window_end_iteration"))
    starts = ranked.select(*by, F.col("rn").alias("__start"), F.col(iteration).alias("window_start_iteration"))
    spread = spread.join(ends, [*by, "__end"]).withColumn("__start", F.greatest(F.lit(1), F.col("__end") - F.col("window_size_iterations") + 1)).join(starts, [*by, "__start"])
    return spread.withColumn("effective_window_size_iterations", F.col("__end") - F.col("__start") + 1)


_WINDOW = ["dataset_id", "window_size_iterations", "effective_window_size_iterations", "window_start_iteration", "window_end_iteration"]


def window_consistency(scores: DataFrame, iterations: DataFrame, sizes: Sequence[int], iteration: str = "global_batch_id", by: Sequence[str] = ()) -> DataFrame:
    """Samples, sum and mean of scores per window and dataset; scores are summed per iteration first."""
    per = scores.groupBy(*by, iteration, "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    out = window_members(per, iterations, sizes, iteration, by).groupBy(*by, *_WINDOW).agg(F.sum("n").alias("sample_count"), F.sum("s").alias("consistency_sum"))
    return out.withColumn("mean_pathway_consistency", F.col("consistency_sum") / F.col("sample_count"))


def window_distances(samples: DataFrame, iterations: DataFrame, sizes: Sequence[int], iteration: str = "global_batch_id", by: Sequence[str] = ()) -> DataFrame:
    """Pairs, sum and mean edit distance per window and dataset (mean null where there is no pair).

    Equal pathways of an iteration are one weighted row; the distance of two pathways is
    computed once per pair of iterations, in the JVM, whatever the number of windows that hold it:
    sums per (iteration, iteration) pair within the largest window are what the windows add up.
    Iterations with many different pathways are compared in blocks of about PAIR_BLOCK by as many,
    so that no pair of iterations is one task's work.
    """
    ranked = dense_iterations(iterations, iteration, by)
    words = samples.select(*by, iteration, "dataset_id", token_word(F.col("pathway")).alias("pathway"))
    rows = words.join(ranked, [*by, iteration]).groupBy(*by, "dataset_id", "rn", "pathway").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows)
    most = rows.groupBy(*by, "dataset_id", "rn").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-most // PAIR_BLOCK)
    every, own = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.pmod(F.xxhash64("pathway"), F.lit(blocks)).cast("int")
    span = max(sizes)
    left = rows.withColumn("bi", own).withColumn("bj", every).select(*by, "dataset_id", F.col("rn").alias("i"), F.col("pathway").alias("a"), F.col("n").alias("na"), "bi", "bj")
    # Partner iterations are named explicitly, so the join is on equal keys.
    left = left.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("i") + span - 1)))
    right = rows.withColumn("bj", own).withColumn("bi", every).select(*by, "dataset_id", F.col("rn").alias("j"), F.col("pathway").alias("b"), F.col("n").alias("nb"), "bi", "bj")
    pairs = left.join(right, [*by, "dataset_id", "j", "bi", "bj"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    sums = pairs.select(*by, "dataset_id", "i", "j", (F.levenshtein("a", "b").cast("bigint") * F.col("na") * F.col("nb")).alias("d"))
    sums = sums.groupBy(*by, "dataset_id", "i", "j").agg(F.sum("d").alias("d"))
    last = ranked.groupBy(*by).agg(F.max("rn").alias("last")) if by else ranked.agg(F.max("rn").alias("last"))
    sums = sums.join(last, list(by)) if by else sums.crossJoin(F.broadcast(last))
    sums = sums.withColumn("window_size_iterations", F.explode(F.array(*map(F.lit, sizes)))).where("j - i < window_size_iterations")
    sums = sums.withColumn("__end", F.explode(F.sequence("j", F.least("last", F.col("i") + F.col("window_size_iterations") - 1))))
    sums = sums.groupBy(*by, "dataset_id", "window_size_iterations", "__end").agg(F.sum("d").alias("d"))
    per = samples.groupBy(*by, iteration, "dataset_id").agg(F.count(F.lit(1)).alias("n"))
    counts = window_members(per, iterations, sizes, iteration, by).groupBy(*by, *_WINDOW, "__end").agg(F.sum("n").alias("sample_count"))
    out = counts.join(sums, [*by, "dataset_id", "window_size_iterations", "__end"], "left")
    pair_count = F.expr("sample_count * (sample_count - 1) div 2")
    total = F.when(pair_count > 0, F.coalesce("d", F.lit(0))).otherwise(F.lit(0)).cast("double")
    return out.select(*by, *_WINDOW, "sample_count", pair_count.alias("pair_count"), total.alias("pathway_edit_distance_sum"), F.try_divide(total, pair_count).alias("mean_pathway_edit_distance"))


def require_same_groups(scores: DataFrame, samples: DataFrame, keys: Sequence[str]) -> None:
    """Consistency and pathway groups must be the same."""
    require_empty(one_sided(scores, samples, list(keys)), "pathway consistency and sequence groups do not match")
