"""Expert load, drops, and router entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import require, require_empty

SLICE = ["model_id", "phase", "global_batch_id", "layer_no"]


def sum_vectors(rows: DataFrame, by: Sequence[str], vector: str = "counts") -> DataFrame:
    """Element-wise sum of arrays: (by, expert_id, token_count), partially summed before the shuffle."""
    return rows.select(*by, F.posexplode(vector).alias("expert_id", "c")).groupBy(*by, "expert_id").agg(F.sum("c").alias("token_count"))


def require_counts(rows: DataFrame, experts: int) -> DataFrame:
    """Count vectors in order: forward rows, one value per expert, none negative; at least one row."""
    if rows.isEmpty():
        raise ValueError("no expert-count rows")
    return require(rows, {"not forward": F.col("direction") == "fwd", "vector size": F.size("counts") == experts, "negative": F.forall("counts", lambda c: c >= 0)}, "expert counts")


def expert_load(pre: DataFrame, post: DataFrame, by: Sequence[str] = SLICE, strict: bool = True) -> DataFrame:
    """(by, expert_id, load_kind, token_count) for pre_drop, post_drop and dropped; pre and post hold token_count per expert."""
    keys = [*by, "expert_id"]
    both = pre.select(*keys, F.col("token_count").alias("pre_drop")).join(post.select(*keys, F.col("token_count").alias("post_drop")), keys, "full_outer" if strict else "inner")
    if strict:
        require_empty(both.where("pre_drop is null or post_drop is null or post_drop > pre_drop"), "pre- and post-drop counts disagree")
    wide = both.withColumn("dropped", F.col("pre_drop") - F.col("post_drop"))
    return wide.unpivot(keys, ["pre_drop", "post_drop", "dropped"], "load_kind", "token_count")


def coefficient_of_variation(x: Column) -> Column:
    """Population standard deviation over mean; 0 where the mean is 0 or there is no value."""
    return F.when(F.coalesce(F.avg(x), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.try_divide(F.stddev_pop(x), F.avg(x)))


def load_summary(load: DataFrame, by: Sequence[str] = SLICE) -> DataFrame:
    """Active and dead experts, CV, largest share and drop rate of a layer; 0 where a denominator is 0."""
    n = F.col("token_count").cast("double")
    of = lambda kind: F.when(F.col("load_kind") == kind, n)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    post = of("post_drop")
    return load.groupBy(*by).agg(
        F.count_if(post > 0).cast("int").alias("active_expert_count"),
        F.count_if(post == 0).cast("int").alias("dead_expert_count"),
        coefficient_of_variation(post).alias("load_cv"),
        ratio(F.max(post), F.sum(post)).alias("max_load_share"),
        ratio(F.sum(of("dropped")), F.sum(of("pre_drop"))).alias("drop_rate"),
    )


def router_entropy(rows: DataFrame, by: Sequence[str] = SLICE, expected_samples: int | None = None) -> DataFrame:
    """Mean entropy of a layer; with ``expected_samples``, any other number of samples is an error."""
    out = rows.groupBy(*by).agg(F.avg("value").alias("entropy_mean"), F.count(F.lit(1)).alias("sample_count"))
    if expected_samples is not None:
        require_empty(out.where(F.col("sample_count") != expected_samples), "entropy samples")
    return out
