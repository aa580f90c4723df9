"""Expert contribution: dominance ranks, ties, and alignment of the top route with the combined output."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import DataError
from ..functions.arrays import cosine, norm
from .ranks import linear_percentiles

COLUMNS = (
    "global_moe_layer", "valid_token_count", "magnitude_tie_token_count", "router_rank_dominance_counts",
    "top_weight_tie_token_count", "top_route_alignment_q1", "top_route_alignment_median", "top_route_alignment_q3",
)


def token_metrics(tokens: DataFrame, strict: bool = True) -> DataFrame:
    """Per token: unique_magnitude, dominant_rank (0-based, among unique ones), unique_top, alignment (of unique ones), top_k.

    ``slots``: structs with weight and output in slot order; ``combined``: their sum.  A zero
    norm is an error, or a null alignment if not strict.
    """
    norms = F.transform("slots", lambda s: norm(s["output"]))
    with_norms = tokens.withColumn("__n", norms).withColumn("__w", F.transform("slots", lambda s: s["weight"].cast("double")))
    best = F.array_max("__n")
    top = F.array_max("__w")
    marked = with_norms.select(
        "*",
        (F.size(F.filter("__n", lambda x: x == best)) == 1).alias("unique_magnitude"),
        (F.size(F.filter("__w", lambda x: x == top)) == 1).alias("unique_top"),
        F.element_at("__w", F.array_position("__n", best).cast("int")).alias("__winning"),
        F.element_at("slots", F.array_position("__w", top).cast("int"))["output"].alias("__top"),
    )
    rank = F.size(F.filter("__w", lambda w: w > F.col("__winning")))
    return marked.select(
        *tokens.columns,
        "unique_magnitude",
        "unique_top",
        F.when(F.col("unique_magnitude"), rank).alias("dominant_rank"),
        F.when(F.col("unique_top"), cosine(F.col("__top"), F.col("combined"), strict)).alias("alignment"),
        F.size("slots").alias("top_k"),
    )


def contribution_report(tokens: DataFrame, layer: str = "layer_no", strict: bool = True) -> DataFrame:
    """One row per layer; quartiles are exact with linear interpolation, ranks filled up with 0 to top_k."""
    m = token_metrics(tokens, strict)
    ranks = m.groupBy(layer, "dominant_rank").agg(F.count(F.lit(1)).alias("c")).where("dominant_rank is not null")
    counts = ranks.groupBy(layer).agg(F.map_from_entries(F.collect_list(F.struct("dominant_rank", "c"))).alias("m"))
    sums = m.groupBy(layer).agg(
        F.count(F.lit(1)).alias("valid_token_count"),
        F.count_if(~F.col("unique_magnitude")).alias("magnitude_tie_token_count"),
        F.count_if(~F.col("unique_top")).alias("top_weight_tie_token_count"),
        F.max("top_k").alias("top_k"),
    )
    dense = F.transform(F.sequence(F.lit(0), F.col("top_k") - 1), lambda r: F.coalesce(F.element_at("m", r), F.lit(0)).cast("bigint"))
    quartiles = linear_percentiles(m.select(layer, "alignment"), [layer], "alignment", [0.25, 0.5, 0.75])
    return sums.join(counts, layer, "left").join(quartiles, layer, "left").select(
        F.col(layer).alias("global_moe_layer"),
        "valid_token_count",
        "magnitude_tie_token_count",
        dense.alias("router_rank_dominance_counts"),
        "top_weight_tie_token_count",
        *[F.get("q", F.lit(i)).alias(f"top_route_alignment_{n}") for i, n in enumerate(("q1", "median", "q3"))],
    )


def grid_gaps(observed: DataFrame, steps: Sequence[int], layers: Sequence[int], microbatches: int) -> DataFrame:
    """(global_batch_id, layer_no, invocations, problem) wherever the run's grid is not as planned: missing, extra or wrong count."""
    spark = observed.sparkSession
    plan = spark.createDataFrame([(int(s),) for s in steps], "global_batch_id bigint").crossJoin(F.broadcast(spark.createDataFrame([(int(x),) for x in layers], "layer_no int")))
    have = observed.groupBy("global_batch_id", "layer_no").agg(F.count_distinct("microbatch_id").alias("invocations"))
    both = plan.withColumn("planned", F.lit(True)).join(have, ["global_batch_id", "layer_no"], "full_outer")
    problem = F.when(F.col("planned").isNull(), "extra").when(F.col("invocations").isNull(), "missing").when(F.col("invocations") != microbatches, "invocations")
    return both.withColumn("problem", problem).where("problem is not null").select("global_batch_id", "layer_no", "invocations", "problem")


def model_grid_gaps(observed: DataFrame, microbatches: int) -> DataFrame:
    """The same for every model against its own grid: each step that it has should have every layer that it has.

    The grid comes from what is there, never from a largest number, so a stray step adds one row per layer.
    """
    rows = observed.where("global_batch_id is not null and layer_no is not null")
    have = rows.groupBy("model_id", "global_batch_id", "layer_no").agg(F.count_distinct("microbatch_id").alias("invocations"))
    layers = have.groupBy("model_id").agg(F.collect_set("layer_no").alias("layers"))
    steps = have.select("model_id", "global_batch_id").distinct()
    plan = steps.join(layers, "model_id").select("model_id", "global_batch_id", F.explode("layers").alias("layer_no"))
    both = plan.join(have, ["model_id", "global_batch_id", "layer_no"], "left")
    problem = F.when(F.col("invocations").isNull(), "missing").when(F.col("invocations") != microbatches, "invocations")
    return both.withColumn("problem", problem).where("problem is not null").select("model_id", "global_batch_id", "layer_no", "invocations", "problem")


def validation_record(tokens: DataFrame, gaps: DataFrame, model_id: str) -> dict:
    """The run's validation as one record; ``status`` is passed or failed."""
    row = tokens.agg(
        F.count_distinct("global_batch_id").alias("observed_step_count"),
        F.count_distinct("layer_no").alias("observed_layer_count"),
        F.count(F.lit(1)).alias("valid_token_count"),
    ).first()
    broken = [r.asDict() for r in gaps.limit(100).collect()]
    return {"schema_version": 1, "status": "failed" if broken else "passed", "model_id": model_id, **row.asDict(), "grid_problems": broken}


def write_report(report: DataFrame, folder: str | Path, validation: dict) -> None:
    """contribution.csv (integer lists as compact JSON; one row per layer) and validation.json (sorted keys); a failed grid is raised after both are written."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "validation.json").write_text(json.dumps(validation, sort_keys=True, indent=2) + "\n")
    with (folder / "contribution.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS)
        for r in report.orderBy("global_moe_layer").toLocalIterator():
            out.writerow([json.dumps(list(v), separators=(",", ":")) if isinstance(v, list) else v for v in r])
    if validation["status"] != "passed":
        raise DataError("the run's grid is not as planned")
