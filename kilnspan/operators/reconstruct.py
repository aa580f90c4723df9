"""Putting expert-parallel captures back together: token, slot, and its weighted expert output.

Sharded rows of one execution (model, phase, iteration, attempt, microbatch, layer,
direction) are joined by their place: the n-th route of an expert-tensor-parallel group in
layout order is the n-th packed row.  All windows run within one execution and rank
(bounded by the tokens of a microbatch), so executions spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import DataError, one_sided, require, require_empty, require_unique
from ..session import cut
from .topology import Manifest

EXECUTION = ["model_id", "phase", "global_batch_id", "attempt_id", "microbatch_id", "layer_no", "direction"]
_PAIR = [*EXECUTION, "shard_rank", "dp_rank", "sample_index", "token_start", "token_end", "dataset_id"]
ACTS = ("router_topk_expert_ids", "router_topk_weights", "moe_inverse_map", "moe_packed_weighted_output")


def incomplete_executions(rows: DataFrame, acts: Sequence[str] = ACTS) -> DataFrame:
    """Executions that lack one of the acts."""
    found = rows.where(F.col("act_name").isin(*acts)).groupBy(*EXECUTION).agg(F.collect_set("act_name").alias("acts"))
    return found.where(F.size("acts") < len(acts))


def route_table(ids: DataFrame, weights: DataFrame, manifest: Manifest, strict: bool = True) -> DataFrame:
    """One row per (execution, producer rank, token, slot): coordinates, expert, weight and route number.

    ids and weights hold ``matrix`` ([local_seq][top_k]) per (execution, rank, sample).
    """
    spark = ids.sparkSession
    left, right = ids.select(*_PAIR, F.col("matrix").alias("ids")), weights.select(*_PAIR, F.col("matrix").alias("weights"))
    if strict:
        require_unique(left, _PAIR, "router row")
        require_unique(right, _PAIR, "router row")
        require_empty(one_sided(left, right, _PAIR), "router ids and weights do not pair")
    ranks = F.broadcast(manifest.rank_table(spark).withColumnRenamed("rank", "shard_rank").withColumnRenamed("dp_rank", "dense_dp_rank").select("shard_rank", "tp_group", "tp_rank", "tp_size", "dense_dp_rank"))
    rows = left.join(right, _PAIR).join(ranks, "shard_rank")
    here = Window.partitionBy(*EXECUTION, "shard_rank")
    rows = rows.withColumn("batch", F.count(F.lit(1)).over(here)).withColumn("seq", F.size("ids"))
    if strict:
        rows = cut(rows)  # checked, then read again
        count = F.col("token_end") - F.col("token_start")
        rules = {
            "wrong data-parallel rank": F.col("dp_rank") == F.col("dense_dp_rank"),
            "shape": (F.size("weights") == F.col("seq")) & F.forall("ids", lambda r: F.size(r) == manifest.top_k),
            "experts not strictly increasing": F.forall("ids", lambda r: F.array_sort(F.array_distinct(r)) == r),
            "valid tokens": (count > 0) & (count <= F.col("seq") * F.col("tp_size")),
            "sample index": (F.col("sample_index") >= 0) & (F.col("sample_index") < F.col("batch")),
            "tensor parallel rows need sequence parallelism": (F.col("tp_size") == 1) | F.lit(manifest.sequence_parallel),
        }
        require(rows, rules, "router rows")
        peers = rows.groupBy(*EXECUTION, "tp_group", "shard_rank").agg(F.sort_array(F.collect_list(F.struct("sample_index", "token_start", "token_end", "dataset_id"))).alias("meta"), F.collect_set("seq").alias("seqs"))
        odd = peers.groupBy(*EXECUTION, "tp_group").agg(F.count_distinct("meta").alias("m"), F.count_distinct("seqs").alias("s"), F.max(F.size("seqs")).alias("e")).where("m > 1 or s > 1 or e > 1")
        require_empty(odd, "tensor-parallel peers disagree")
    tokens = rows.select(*_PAIR, "batch", "seq", "tp_rank", F.posexplode(F.arrays_zip("ids", "weights")).alias("i", "t"))
    tokens = tokens.withColumn("token_index", F.col("token_start") + F.col("tp_rank") * F.col("seq") + F.col("i")).where("token_index < token_end")
    order = here.orderBy("i", "sample_index")
    tokens = tokens.withColumn("token_no", F.row_number().over(order) - 1).withColumn("flat", F.col("i") * F.col("batch") + F.col("sample_index"))
    keep = [*EXECUTION, "shard_rank", "dp_rank", "dataset_id", "sample_index", "token_index", "token_no", "flat"]
    slots = tokens.select(*keep, F.posexplode(F.arrays_zip(F.col("t.ids").alias("expert_id"), F.col("t.weights").alias("weight"))).alias("slot", "r"))
    return slots.select(*keep, "slot", F.col("r.expert_id").cast("int").alias("expert_id"), F.col("r.weight").cast("double").alias("weight"), (F.col("token_no") * manifest.top_k + F.col("slot")).alias("route_no"))


def require_inverse_maps(routes: DataFrame, maps: DataFrame) -> None:
    """Each rank's stored map must be its tokens' flat places in expert-major order."""
    require_unique(maps, [*EXECUTION, "shard_rank"], "inverse-map row")
    order = Window.partitionBy(*EXECUTION, "shard_rank").orderBy("expert_id", "route_no")
    ours = routes.select(*EXECUTION, "shard_rank", (F.row_number().over(order) - 1).alias("pos"), F.col("flat").cast("bigint").alias("flat"))
    theirs = maps.select(*EXECUTION, "shard_rank", F.posexplode("flat_map").alias("pos", "flat")).withColumn("flat", F.col("flat").cast("bigint"))
    if not ours.exceptAll(theirs).isEmpty() or not theirs.exceptAll(ours).isEmpty():
        raise DataError("inverse map disagrees with routing")


def place_routes(routes: DataFrame, manifest: Manifest) -> DataFrame:
    """Add etp_group and ``pos``: the packed row of each route in its destination group.

    One sort replaces the two stable ones: local expert, then the receiving rank's place
    in its group, then the sending rank's, then the route's number.
    """
    spark = routes.sparkSession
    ranks = manifest.rank_table(spark)
    source = F.broadcast(ranks.select(F.col("rank").alias("shard_rank"), "ep_group", F.col("ep_rank").alias("source_ep_rank")))
    dest = F.broadcast(ranks.select("ep_group", F.col("ep_rank").alias("dest_ep_rank"), F.col("etp_group"), F.col("etp_rank")))
    placed = routes.join(source, "shard_rank").join(F.broadcast(manifest.expert_table(spark)), "expert_id").join(dest, ["ep_group", "dest_ep_rank"])
    order = Window.partitionBy(*EXECUTION, "etp_group").orderBy("expert_pos", "etp_rank", "source_ep_rank", "expert_id", "route_no")
    return placed.withColumn("pos", F.row_number().over(order) - 1)


def add_vectors(vectors):
    """Element-wise sum of a column of equally long arrays (an aggregate over few rows)."""
    listed = F.collect_list(vectors)
    return F.aggregate(F.slice(listed, F.lit(2), F.size(listed)), F.element_at(listed, 1), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))


def packed_rows(packed: DataFrame, manifest: Manifest) -> DataFrame:
    """(execution, etp_group, pos, output): packed rows, partial sums of a group's ranks added up."""
    ranks = F.broadcast(manifest.rank_table(packed.sparkSession).select(F.col("rank").alias("shard_rank"), "etp_group"))
    long = packed.join(ranks, "shard_rank").select(*EXECUTION, "etp_group", "shard_rank", F.posexplode("rows").alias("pos", "row"))
    return long.groupBy(*EXECUTION, "etp_group", "pos").agg(add_vectors(F.col("row")).alias("output"), F.count(F.lit(1)).alias("partials"))


def reconstruct(ids: DataFrame, weights: DataFrame, maps: DataFrame, packed: DataFrame, manifest: Manifest, strict: bool = True) -> DataFrame:
    """Every route with its output: (execution, dp_rank, dataset_id, sample_index, token_index, slot, expert_id, weight, output)."""
    manifest.require_supported()
    routes = route_table(ids, weights, manifest, strict)
    if strict:
        routes = cut(routes)
        require_inverse_maps(routes, maps)
        require_unique(packed, [*EXECUTION, "shard_rank"], "packed row")
    placed, rows = place_routes(routes, manifest), packed_rows(packed, manifest)
    keys = [*EXECUTION, "etp_group", "pos"]
    joined = placed.join(rows, keys, "full_outer" if strict else "inner")
    if strict:
        joined = cut(joined)
        size = len(manifest.etp_groups[0])
        require(joined, {"route without packed row or the reverse": F.col("output").isNotNull() & F.col("expert_id").isNotNull(), "partials": F.col("partials") == size}, "route bijection")
        # Without pipeline stages every rank of the group captures the same tokens' rows once.
        require_unique(joined, [*EXECUTION, "dp_rank", "dataset_id", "sample_index", "token_index", "slot"], "global token")
    return joined.select(*EXECUTION, "dp_rank", "dataset_id", "sample_index", "token_index", "slot", "expert_id", "weight", "output")


TOKEN = [*EXECUTION, "dp_rank", "dataset_id", "sample_index", "token_index"]


def token_table(routes: DataFrame) -> DataFrame:
    """One row per token: its slots in order, and the sum of their outputs."""
    slots = F.array_sort(F.collect_list(F.struct("slot", "expert_id", "weight", "output")))
    tokens = routes.groupBy(*TOKEN).agg(slots.alias("slots"))
    total = F.aggregate(F.slice("slots", F.lit(2), F.size("slots")), F.element_at("slots", 1)["output"], lambda a, s: F.zip_with(a, s["output"], lambda p, q: p + q))
    return tokens.withColumn("combined", total)
