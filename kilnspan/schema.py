"""The record model: coordinates, tables, sentinels, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The 15 coordinates of a record in order; all but the last form the key.
COORDINATES = (
    ("model_id", T.StringType()),
    ("act_name", T.StringType()),
    ("direction", T.StringType()),
    ("phase", T.StringType()),
    ("global_batch_id", T.LongType()),
    ("dp_rank", T.IntegerType()),
    ("microbatch_id", T.IntegerType()),
    ("sample_index", T.IntegerType()),
    ("layer_no", T.IntegerType()),
    ("shard_rank", T.IntegerType()),
    ("token_start", T.LongType()),
    ("token_end", T.LongType()),
    ("attempt_id", T.IntegerType()),
    ("invocation_id", T.IntegerType()),
    ("dataset_id", T.IntegerType()),
)
KEY = tuple(name for name, _ in COORDINATES[:14])
STATUS_ACT = "iteration_attempt_status"
ABORTED, REJECTED, ACCEPTED = -1, 0, 1
#: The coordinates that a status row must have (fixed values).
STATUS_IDENTITY = {
    "dp_rank": -1, "microbatch_id": -1, "sample_index": -1, "layer_no": -1, "shard_rank": -1,
    "token_start": 0, "token_end": 1, "invocation_id": 0, "dataset_id": -1,
}
PHASES, DIRECTIONS = ("train", "valid", "test"), ("fwd", "bwd", "iter")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_D, _L, _I, _S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()
_IDS = (("model_id", _S), ("run_name", _S), ("phase", _S), ("training_iteration_id", _L))
_WINDOW = (*_IDS, ("dataset_id", _I), ("window_size_iterations", _I), ("effective_window_size_iterations", _I), ("window_start_iteration", _L), ("window_end_iteration", _L), ("sample_count", _L))
_CONTROL = (("controller_mode", _S), ("run_id", _S), ("model_id", _S))

#: All tables by name: raw, derived and audit.
TABLES = {
    "raw": _struct(*COORDINATES, ("dtype", _S), ("shape", T.ArrayType(_L)), ("bytes", T.BinaryType())),
    "raw_scalar_float": _struct(*COORDINATES, ("value", _D)),
    "raw_scalar_int": _struct(*COORDINATES, ("value", _L)),
    "raw_eval_phase_boundary": _struct(("model_id", _S), ("training_iteration_id", _L), ("phase", _S), ("eval_index", _I), ("boundary_type", _S), ("next_global_batch_id", _L)),
    "training_scalar": _struct(*_IDS, ("global_batch_id", _L), ("metric_name", _S), ("metric_value", _D)),
    "expert_load": _struct(*_IDS, ("global_batch_id", _L), ("layer_id", _I), ("expert_id", _I), ("load_kind", _S), ("token_count", _L)),
    "expert_load_summary": _struct(*_IDS, ("global_batch_id", _L), ("layer_id", _I), ("active_expert_count", _I), ("dead_expert_count", _I), ("load_cv", _D), ("max_load_share", _D), ("drop_rate", _D)),
    "router_entropy": _struct(*_IDS, ("global_batch_id", _L), ("layer_id", _I), ("entropy_mean", _D)),
    "pathway_consistency": _struct(*_WINDOW, ("consistency_sum", _D), ("mean_pathway_consistency", _D), ("consistency_eps", _D)),
    "pathway_edit_distance": _struct(*_WINDOW, ("pair_count", _L), ("pathway_edit_distance_sum", _D), ("mean_pathway_edit_distance", _D), ("pathway_threshold", _D)),
    "loss_slope_iteration_metrics": _struct(*_CONTROL, ("dataset_id", _I), ("window_id", _L), ("training_iteration_id", _L), ("status", _S), ("incomplete_reason", _S), ("sample_count", _L), ("positive_loss_sample_count", _L), ("target_token_count", _L), ("loss_value", _D), ("processed_at_unix_ns", _L)),
    "loss_slope_window_indicators": _struct(*_CONTROL, ("dataset_id", _I), ("window_id", _L), ("window_start_iteration", _L), ("window_end_iteration", _L), ("terminal_window", T.BooleanType()), ("status", _S), ("incomplete_reason", _S), ("iteration_point_count", _L), ("expected_iteration_point_count", _L), ("sample_count", _L), ("positive_loss_sample_count", _L), ("target_token_count", _L), ("loss_slope", _D), ("indicator", _D), ("eta", _D), ("uniform_smoothing", _D), ("processed_at_unix_ns", _L)),
    "loss_slope_realized_mixture": _struct(*_CONTROL, ("training_iteration_id", _L), ("dataset_id", _I), ("sample_count", _L)),
    "loss_slope_mixture_decisions": _struct(*_CONTROL, ("decision_id", _L), ("decision_type", _S), ("source_window_id", _L), ("source_window_end_iteration", _L), ("effective_window_id", _L), ("effective_training_iteration", _L), ("weights", T.ArrayType(_D)), ("reason", _S), ("eta", _D), ("uniform_smoothing", _D), ("produced_at_unix_ns", _L)),
    "loss_slope_decision_requests": _struct(*_CONTROL, ("effective_window_id", _L), ("client_id", _S), ("status", _S), ("event_at_unix_ns", _L)),
}
#: Value ranges by column (inclusive); there are no unsigned types, so bounds are checked.
RANGES = {"attempt_id": (0, 2**31 - 1), "invocation_id": (0, 2**31 - 1), "dataset_id": (-1, 2**31 - 1), "global_batch_id": (0, 2**63 - 1)}


class SchemaMismatch(ValueError):
    """A table does not have the declared columns."""


def require_schema(df: DataFrame, table: str, extra_ok: bool = False) -> DataFrame:
    """The table itself, if names, types and order are as declared (``extra_ok``: more columns may follow or lie between)."""
    want = [(f.name, f.dataType.simpleString()) for f in TABLES[table].fields]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if extra_ok:
        names = {n for n, _ in want}
        have = [x for x in have if x[0] in names]
        want, have = sorted(want), sorted(have)
    if want != have:
        raise SchemaMismatch(f"{table}: expected {want}, got {have}")
    return df
