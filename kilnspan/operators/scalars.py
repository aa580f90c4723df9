"""Per-iteration scalars: token-weighted loss, gradient norm, and their coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import DataError, is_finite, one_sided, require, require_empty, require_unique

LOSS, LOSS_TOKENS, GRAD_NORM = "lm_per_sample_loss", "lm_per_sample_loss_token_count", "grad_norm"
#: The columns on which a sample's loss and its token count agree.
SAMPLE_KEY = ["model_id", "phase", "global_batch_id", "dp_rank", "microbatch_id", "sample_index", "layer_no", "shard_rank", "token_start", "token_end", "attempt_id", "invocation_id", "dataset_id"]


def pair_losses(losses: DataFrame, counts: DataFrame, keys: Sequence[str] = SAMPLE_KEY, strict: bool = True) -> DataFrame:
    """(keys, loss, tokens): both sides of every sample; strict: no sample lacks either, none is stored twice."""
    keys = list(keys)
    left, right = losses.select(*keys, F.col("value").alias("loss")), counts.select(*keys, F.col("value").alias("tokens"))
    if strict:
        require_unique(left, keys, f"{LOSS} raw row")
        require_unique(right, keys, f"{LOSS_TOKENS} raw row")
        require(left, {"loss not finite": is_finite(F.col("loss"))}, LOSS)
        require(right, {"negative token count": F.col("tokens") >= 0}, LOSS_TOKENS)
        require_empty(one_sided(left, right, keys), "loss and token count do not pair")
    return left.join(right, keys)


def dataset_mismatches(losses: DataFrame, counts: DataFrame, keys: Sequence[str] = SAMPLE_KEY) -> DataFrame:
    """Samples whose two sides agree on their place (the keys but dataset_id) and not on their dataset; online, any such is an error."""
    place = [k for k in keys if k not in ("dataset_id", "layer_no", "shard_rank", "token_start", "token_end")]
    both = losses.select(*place, "dataset_id").join(counts.select(*place, F.col("dataset_id").alias("count_dataset_id")), place)
    return both.where(~F.col("dataset_id").eqNullSafe(F.col("count_dataset_id")))


def weighted_loss(pairs: DataFrame, by: Sequence[str] = ("model_id", "phase", "global_batch_id"), strict: bool = True) -> DataFrame:
    """(by, metric_value): the token-weighted mean loss; an iteration without tokens is an error, or null if not strict."""
    sums = pairs.groupBy(*by).agg(F.sum(F.col("loss") * F.col("tokens")).alias("s"), F.sum("tokens").alias("n"))
    if strict:
        require_empty(sums.where("n = 0").select(*by), "no loss tokens")
    return sums.select(*by, F.try_divide("s", "n").alias("metric_value"))


def direct_scalar(rows: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """A per-iteration scalar: one finite row with the per-iteration identity for each iteration, at least one."""
    out = rows.where(F.col("act_name") == name)
    if strict:
        if out.isEmpty():
            raise DataError(f"no {name} rows")
        identity = (F.col("dp_rank") == -1) & (F.col("microbatch_id") == -1) & (F.col("sample_index") == -1) & (F.col("layer_no") == -1) & (F.col("token_start") == 0) & (F.col("token_end") == 1)
        require(out, {"unexpected identity": identity, "not finite": is_finite(F.col("value"))}, name)
        require_unique(out, ["model_id", "phase", "global_batch_id"], f"{name} row")
    return out.select("model_id", "phase", "global_batch_id", F.col("value").alias("metric_value"))


def training_scalar(run_name: str, **metrics: DataFrame) -> DataFrame:
    """The derived table: one row per iteration and metric."""
    parts = [
        m.select("model_id", F.lit(run_name).alias("run_name"), "phase", F.col("global_batch_id").alias("training_iteration_id"), "global_batch_id", F.lit(n).alias("metric_name"), "metric_value")
        for n, m in metrics.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def uncovered(output: DataFrame, accepted: DataFrame, keys: Sequence[str] = ("model_id", "global_batch_id")) -> DataFrame:
    """Iterations of the output or the accepted set that the other lacks."""
    return one_sided(output, accepted, list(keys))


def metric_gaps(scalars: DataFrame, accepted: DataFrame, metrics: Sequence[str] = ("lm_loss_iteration", "grad_norm")) -> DataFrame:
    """(model_id, global_batch_id, metric_name, rows) wherever a required metric does not have exactly one row."""
    spread = accepted.select("model_id", "global_batch_id", F.explode(F.array(*map(F.lit, metrics))).alias("metric_name"))
    have = scalars.groupBy("model_id", "global_batch_id", "metric_name").agg(F.count(F.lit(1)).alias("rows"))
    return spread.join(have, ["model_id", "global_batch_id", "metric_name"], "left").na.fill({"rows": 0}).where("rows <> 1")


def require_iterations(accepted: DataFrame, expected: int | None) -> int:
    """The number of accepted iterations; none at all, or another number than expected, is an error."""
    n = accepted.count()
    if n == 0:
        raise DataError("no accepted iterations")
    if expected is not None and n != expected:
        raise DataError(f"accepted iterations: {n}, expected {expected}")
    return n
