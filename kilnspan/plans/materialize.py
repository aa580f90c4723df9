"""Batch materialisation: from raw scalars to the derived tables of one run.

``python -m kilnspan.plans.materialize --raw FOLDER --out FOLDER --model-id M --run-name R``
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import require_empty
from ..operators import attempts, experts, pathways, scalars
from ..sources import sinks, tensors


def _ids(df: DataFrame, run_name: str, *columns) -> DataFrame:
    return df.select("model_id", F.lit(run_name).alias("run_name"), "phase", F.col("global_batch_id").alias("training_iteration_id"), "global_batch_id", F.col("layer_no").alias("layer_id"), *columns)


def derive_load(raw: DataFrame, accepted: DataFrame, run_name: str, expert_count: int) -> dict[str, DataFrame]:
    """expert_load and expert_load_summary out of the tensor table."""
    counts = tensors.expert_counts(raw, accepted, expert_count)
    load = experts.expert_load(*[experts.sum_vectors(counts[a], experts.SLICE) for a in (tensors.PRE, tensors.POST)])
    summary = experts.load_summary(load)
    require_empty(scalars.uncovered(summary, accepted), "expert load coverage")
    return {
        "expert_load": _ids(load, run_name, "expert_id", "load_kind", "token_count"),
        "expert_load_summary": _ids(summary, run_name, "active_expert_count", "dead_expert_count", "load_cv", "max_load_share", "drop_rate"),
    }


def derive_pathways(raw: DataFrame, accepted: DataFrame, run_name: str, layers: int, expert_count: int, hidden: int, sizes: list[int], threshold: float = 0.7, eps: float = 1e-6) -> dict[str, DataFrame]:
    """pathway_consistency and pathway_edit_distance: each iteration against the latest weights before it."""
    samples = pathways.assemble_samples(tensors.router_samples(raw, accepted, expert_count), layers)
    states = tensors.weight_states(raw, layers, expert_count, hidden)
    stated = samples.join(tensors.state_of_iterations(samples, states, accepted), ["model_id", "global_batch_id"])
    scores = pathways.sample_consistency(stated, states.drop("attempt_id", "model_id"), eps)
    paths = pathways.pathways(samples, threshold)
    pathways.require_same_groups(scores, paths, ["dataset_id", "global_batch_id"])
    its, by = accepted.select("model_id", F.lit("train").alias("phase"), "global_batch_id"), ["model_id", "phase"]
    common = lambda df, *columns: df.select(
        "model_id", F.lit(run_name).alias("run_name"), "phase", F.col("window_end_iteration").alias("training_iteration_id"), "dataset_id", "window_size_iterations",
        "effective_window_size_iterations", "window_start_iteration", "window_end_iteration", "sample_count", *columns,
    )
    return {
        "pathway_consistency": common(pathways.window_consistency(scores, its, sizes, by=by), "consistency_sum", "mean_pathway_consistency", F.lit(eps).alias("consistency_eps")),
        "pathway_edit_distance": common(pathways.window_distances(paths, its, sizes, by=by), "pair_count", "pathway_edit_distance_sum", "mean_pathway_edit_distance", F.lit(threshold).alias("pathway_threshold")),
    }


def derive(floats: DataFrame, ints: DataFrame, model_id: str, run_name: str, expected_iterations: int | None = None, raw: DataFrame | None = None, shape: dict | None = None, sizes: list[int] | None = None) -> dict[str, DataFrame]:
    """The derived tables of one model's accepted training iterations, coverage checked.

    Always training_scalar and router_entropy; with ``raw`` and ``shape`` (layers, experts,
    hidden) the expert loads, and with window ``sizes`` the pathways.
    """
    mine = F.col("model_id") == model_id
    floats, ints = floats.where(mine), ints.where(mine)
    accepted = attempts.accepted_attempts(ints)
    scalars.require_iterations(accepted, expected_iterations)
    attempts.require_status(attempts.represented_iterations(floats, ints), attempts.resolve(attempts.status_rows(ints)))
    train = F.col("phase") == "train"
    seen = attempts.visible(floats.where(train), accepted)
    counts = attempts.visible(ints.where(train & (F.col("act_name") == scalars.LOSS_TOKENS)), accepted)
    pairs = scalars.pair_losses(seen.where(F.col("act_name") == scalars.LOSS), counts)
    table = scalars.training_scalar(run_name, lm_loss_iteration=scalars.weighted_loss(pairs), grad_norm=scalars.direct_scalar(seen, scalars.GRAD_NORM))
    require_empty(scalars.metric_gaps(table, accepted), "required metrics")
    entropy = experts.router_entropy(seen.where(F.col("act_name") == "router_token_entropy_mean"))
    require_empty(scalars.uncovered(entropy, accepted), "router entropy coverage")
    out = {"training_scalar": table, "router_entropy": _ids(entropy, run_name, "entropy_mean")}
    if raw is not None and shape:
        raw = raw.where(mine)
        out |= derive_load(raw, accepted, run_name, shape["experts"])
        if sizes:
            out |= derive_pathways(raw, accepted, run_name, shape["layers"], shape["experts"], shape["hidden"], sizes)
    return out


def main(argv: list[str] | None = None) -> dict[str, int]:
    """Derive and write; prints the number of rows per table as JSON."""
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("--raw", "--out", "--model-id", "--run-name"):
        p.add_argument(name, required=True)
    for name in ("--expected-iterations", "--layers", "--experts", "--hidden"):
        p.add_argument(name, type=int)
    p.add_argument("--window", type=int, action="append", help="a window size in iterations; may be given again")
    p.add_argument("--phase", default="train", choices=["train"])
    p.add_argument("--drop", action="store_true")
    a = p.parse_args(argv)
    if any(v is not None and v < 1 for v in (a.expected_iterations, a.layers, a.experts, a.hidden, *(a.window or []))):
        p.error("counts and windows must be positive")
    if a.window and not (a.layers and a.experts and a.hidden):
        p.error("windows need --layers, --experts and --hidden")
    spark = SparkSession.builder.getOrCreate()
    read = lambda t: spark.read.parquet(f"{a.raw}/{t}.parquet")
    shape = {"layers": a.layers, "experts": a.experts, "hidden": a.hidden} if a.experts else None
    tables = derive(read("raw_scalar_float"), read("raw_scalar_int"), a.model_id, a.run_name, a.expected_iterations, read("raw") if shape else None, shape, a.window)
    sinks.create_tables(spark, a.out, list(tables), a.drop)
    run = {"model_id": a.model_id, "run_name": a.run_name, "phase": a.phase}
    written = {t: sinks.replace_run(df, a.out, t, run) for t, df in tables.items()}
    print(json.dumps(written, sort_keys=True))
    return written


if __name__ == "__main__":
    main()
