"""Scans of the tensor table: decoded, checked, and shaped for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import is_finite, require, require_empty, require_unique
from ..functions.arrays import decode_tensor
from ..operators.asof import latest_before
from ..operators.attempts import visible
from ..operators.reconstruct import ACTS
from ..schema import STATUS_IDENTITY

PRE, POST, PROBS, WEIGHTS = "pre_drop_token_count", "post_drop_token_count", "router_probs_mean", "router_projection_weight"


def decoded(raw: DataFrame, *acts: str) -> DataFrame:
    """Rows of the named measures with ``values``, the flat numbers; other measures' bytes are never read."""
    rows = raw.where(F.col("act_name").isin(*acts))
    return rows.withColumn("values", decode_tensor("dtype", "shape", "bytes")).drop("bytes")


def matrices(rows: DataFrame, kind: str = "double") -> DataFrame:
    """``matrix``: the flat values as rows of the last dimension."""
    width = F.element_at("shape", 2).cast("int")
    cut = lambda i: F.slice(F.col("values"), i * width + 1, width)
    made = F.transform(F.sequence(F.lit(0), F.element_at("shape", 1).cast("int") - 1), cut)
    return rows.withColumn("matrix", F.when(F.element_at("shape", 1) > 0, made).otherwise(F.array().cast("array<array<double>>")).cast(f"array<array<{kind}>>"))


def expert_counts(raw: DataFrame, accepted: DataFrame, experts: int) -> dict[str, DataFrame]:
    """Count vectors of accepted training rows before and after drops (forward, one value per expert, none negative)."""
    rows = decoded(visible(raw.where("phase = 'train'"), accepted), PRE, POST).withColumn("counts", F.transform("values", lambda v: v.cast("bigint")))
    rules = {"not forward": F.col("direction") == "fwd", "size": F.size("counts") == experts, "negative": F.forall("counts", lambda c: c >= 0)}
    require(rows, rules, "expert counts")
    return {act: rows.where(F.col("act_name") == act) for act in (PRE, POST)}


def router_samples(raw: DataFrame, accepted: DataFrame, experts: int) -> DataFrame:
    """Router probabilities per sample and layer as floats (finite, one per expert)."""
    rows = decoded(visible(raw.where("phase = 'train'"), accepted), PROBS).withColumn("probs", F.transform("values", lambda v: v.cast("float")))
    require(rows, {"not forward": F.col("direction") == "fwd", "size": F.size("probs") == experts, "not finite": F.forall("probs", is_finite)}, "router probabilities")
    return rows.drop("values")


def weight_states(raw: DataFrame, layers: int, experts: int, hidden: int) -> DataFrame:
    """Router weights of every stored state: (model_id, state_id, attempt_id, layer_no, weights), identity and shape checked."""
    rows = decoded(raw.where("invocation_id = 0"), WEIGHTS)
    identity = F.lit(True)
    for c, v in STATUS_IDENTITY.items():
        if c != "layer_no":
            identity = identity & (F.col(c) == v)
    identity = identity & (F.col("direction") == "iter") & (F.col("phase") == "train")
    require(rows, {"identity": identity & (F.col("shard_rank") == STATUS_IDENTITY["shard_rank"]), "shape": F.col("shape") == F.array(F.lit(experts).cast("bigint"), F.lit(hidden).cast("bigint"))}, "router weights")
    states = rows.select("model_id", F.col("global_batch_id").alias("state_id"), "attempt_id", "layer_no", F.col("values").alias("weights"))
    require_unique(states, ["model_id", "state_id", "layer_no"], "router weight row")
    whole = states.groupBy("model_id", "state_id").agg(F.array_sort(F.collect_set("layer_no")).alias("l"))
    require_empty(whole.where(F.col("l") != F.sequence(F.lit(0), F.lit(layers - 1))), "router weight layers")
    return states


def state_of_iterations(iterations: DataFrame, states: DataFrame, accepted: DataFrame) -> DataFrame:
    """(model_id, global_batch_id, state_id): the latest usable weight state before each iteration, one as-of join for all.

    State 0 counts with attempt 0, any other with its accepted attempt; none is an error.
    """
    own = states.select("model_id", "state_id", "attempt_id").distinct()
    good = own.join(accepted.withColumnRenamed("global_batch_id", "state_id"), ["model_id", "state_id", "attempt_id"], "left_semi")
    usable = own.where("state_id = 0 and attempt_id = 0").unionByName(good)
    latest = latest_before(iterations.select("model_id", "global_batch_id").distinct(), usable.select("model_id", F.col("state_id").alias("global_batch_id")), "global_batch_id", ["model_id"], required=True)
    return latest.select("model_id", "global_batch_id", F.col("state_global_batch_id").alias("state_id"))


def primary_forward(raw: DataFrame, accepted: DataFrame) -> dict[str, DataFrame]:
    """The four measures of a reconstruction, accepted and primary, shaped for ``operators.reconstruct``."""
    rows = visible(raw.where("direction = 'fwd'"), accepted)
    one = lambda act: decoded(rows, act)
    ids, weights, maps, packed = ACTS
    flat = F.transform("values", lambda v: v.cast("bigint"))
    return {
        "ids": matrices(one(ids), "int"),
        "weights": matrices(one(weights)),
        "maps": one(maps).withColumn("flat_map", flat),
        "packed": matrices(one(packed)).withColumnRenamed("matrix", "rows"),
    }
