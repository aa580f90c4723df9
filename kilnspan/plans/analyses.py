"""Queries of the engine's own operators over the stored tables, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from ..functions import arrays
from ..operators import asof, attempts, contribution, experts, lineage, logs, loss_slope, pathways, reconstruct, router, scalars, segments, topology, transports
from ..schema import KEY
from ..session import cut, shared_folder
from ..sources import records, tensors
from ..streaming import controller
from . import bridge
from .bridge import LOAD_SQL, SAMPLES_SQL, TELEMETRY_SQL, TURNS_SQL, VECTORS_SQL, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
PREFIX = ("olm-aurora-8x", "lm_per_sample_loss", "fwd", "train")
_KEYS = ", ".join(KEY)


def query(sql: str | None = None):
    """Register a query, and the SQL that states the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    return attempts.resolve(bridge.status(spark, folder)).where("accepted_count = 1").select("model_id", "global_batch_id", F.col("accepted_attempt").alias("attempt_id"))


def _visible(spark: SparkSession, folder: str, accepted: DataFrame | None = None) -> DataFrame:
    return attempts.visible(bridge.clean_floats(spark, folder), accepted if accepted is not None else cut(_accepted(spark, folder)))


def _pairs(spark: SparkSession, folder: str, accepted: DataFrame) -> DataFrame:
    losses = _visible(spark, folder, accepted).where((F.col("act_name") == scalars.LOSS) & (F.col("phase") == "train") & checks.is_finite(F.col("value")))
    counts = attempts.visible(bridge.clean_ints(spark, folder), accepted).where((F.col("act_name") == scalars.LOSS_TOKENS) & (F.col("phase") == "train"))
    return scalars.pair_losses(losses, counts, strict=False)


def _grad_norm(spark: SparkSession, folder: str, accepted: DataFrame) -> DataFrame:
    rows = _visible(spark, folder, accepted).where((F.col("phase") == "train") & checks.is_finite(F.col("value")) & (F.col("dataset_id") == -1))
    return scalars.direct_scalar(rows, scalars.GRAD_NORM, strict=False)


def _training_scalar(spark: SparkSession, folder: str, accepted: DataFrame) -> DataFrame:
    losses = scalars.weighted_loss(_pairs(spark, folder, accepted), strict=False)
    return scalars.training_scalar("run", lm_loss_iteration=losses, grad_norm=_grad_norm(spark, folder, accepted))


_LOSS_SQL = TELEMETRY_SQL + """,
pr as (select l.model_id, l.phase, l.global_batch_id, l.value loss, c.value tokens from vis l join visi c
  on l.model_id = c.model_id and l.phase = c.phase and l.global_batch_id = c.global_batch_id and l.dp_rank = c.dp_rank and l.microbatch_id = c.microbatch_id and l.sample_index = c.sample_index
  and l.layer_no = c.layer_no and l.shard_rank = c.shard_rank and l.token_start = c.token_start and l.token_end = c.token_end and l.attempt_id = c.attempt_id and l.invocation_id = c.invocation_id and l.dataset_id = c.dataset_id
  where l.act_name = 'lm_per_sample_loss' and c.act_name = 'lm_per_sample_loss_token_count' and l.phase = 'train' and l.value is not null and isfinite(l.value)),
ll as (select model_id, phase, global_batch_id, case when sum(tokens) <> 0 then sum(loss * tokens) / sum(tokens) end metric_value from pr group by 1, 2, 3),
gn as (select model_id, phase, global_batch_id, value metric_value from vis where act_name = 'grad_norm' and phase = 'train' and value is not null and isfinite(value) and dataset_id = -1),
ts as (select *, 'lm_loss_iteration' metric_name from ll union all select *, 'grad_norm' from gn)
"""

# ---------------------------------------------------------------- scans and visibility


@query(TELEMETRY_SQL + f"select {_KEYS}, dataset_id, round(value, 6) \"value\" from vis where model_id = '{PREFIX[0]}' and act_name = '{PREFIX[1]}' and direction = '{PREFIX[2]}' and phase = '{PREFIX[3]}'")
def scan_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted primary rows under a key prefix."""
    rows = attempts.visible(records.by_prefix(bridge.clean_floats(spark, folder), PREFIX), cut(_accepted(spark, folder)))
    return rows.select(*KEY, "dataset_id", F.round("value", 6).alias("value"))


@query(TELEMETRY_SQL + f"select {_KEYS}, dataset_id, round(value, 6) \"value\" from cf where model_id = '{PREFIX[0]}' and act_name = '{PREFIX[1]}' and direction = '{PREFIX[2]}' and phase = '{PREFIX[3]}'")
def scan_prefix_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The same for all attempts and invocations."""
    return records.by_prefix(bridge.clean_floats(spark, folder), PREFIX).select(*KEY, "dataset_id", F.round("value", 6).alias("value"))


@query(TELEMETRY_SQL + "select * from res")
def attempt_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and aborted attempts of every iteration."""
    return attempts.resolve(bridge.status(spark, folder))


@query(TELEMETRY_SQL + "select * from acc")
def accepted_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Iterations with one accepted attempt."""
    return _accepted(spark, folder)


_REP = TELEMETRY_SQL + """, rep as (
  select distinct model_id, global_batch_id from cf where phase = 'train' and global_batch_id <> 0 and act_name <> 'iteration_attempt_status'
  union select distinct model_id, global_batch_id from ci where phase = 'train' and global_batch_id <> 0 and act_name <> 'iteration_attempt_status')
"""


def _represented(spark: SparkSession, folder: str) -> DataFrame:
    return attempts.represented_iterations(bridge.clean_floats(spark, folder), bridge.clean_ints(spark, folder))


@query(_REP + "select * from rep")
def represented_iterations(spark: SparkSession, folder: str) -> DataFrame:
    """Iterations that have payload in either table."""
    return _represented(spark, folder)


@query(_REP + "select * from rep where (model_id, global_batch_id) not in (select model_id, global_batch_id from res where accepted_count > 0 or aborted_count > 0)")
def iterations_without_status(spark: SparkSession, folder: str) -> DataFrame:
    """Represented iterations that nothing accepted or aborted."""
    return attempts.without_status(_represented(spark, folder), attempts.resolve(bridge.status(spark, folder)))


@query(
    TELEMETRY_SQL
    + """, a as (select model_id, global_batch_id, list(attempt_id order by attempt_id) ids, list(value order by attempt_id, value) vs from st group by 1, 2)
select model_id, global_batch_id, len(ids)::integer attempt_count, ids <> list_transform(range(len(ids)), lambda x: x::integer) attempts_not_consecutive,
  len(list_filter(vs, lambda x: x <> 0)) <> 1 not_exactly_one_accepted_or_aborted, vs[len(vs)] = 0 ends_without_a_decision from a"""
)
def iteration_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Which rules the attempts of each iteration break."""
    return attempts.iteration_ends(bridge.status(spark, folder))


@query(TELEMETRY_SQL + "select model_id, act_name, direction, phase, count(*) \"rows\", min(global_batch_id) first_iteration, max(global_batch_id) last_iteration from vis group by all")
def visible_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Visible rows per model, measure, direction and phase."""
    out = _visible(spark, folder).groupBy("model_id", "act_name", "direction", "phase")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.min("global_batch_id").alias("first_iteration"), F.max("global_batch_id").alias("last_iteration"))


@query("select phase, count(*) \"rows\" from raw_scalar_float group by 1")
def phase_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows per phase."""
    return read(spark, folder, "raw_scalar_float").groupBy("phase").agg(F.count(F.lit(1)).alias("rows"))


@query(
    TELEMETRY_SQL
    + """, b as (select model_id, phase, min(global_batch_id) a, max(global_batch_id) b from cf where phase <> 'train' group by 1, 2)
select model_id, phase, 'entry' boundary_type, a next_global_batch_id from b union all select model_id, phase, 'exit', b + 1 from b"""
)
def eval_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Entry and exit of evaluation phases."""
    return transports.boundaries_of(bridge.clean_floats(spark, folder))


_W3 = [k for k in KEY if k not in ("invocation_id", "attempt_id")]


@query(
    TELEMETRY_SQL
    + f"select row_id, row_number() over (partition by {', '.join(_W3)}, attempt_id order by row_id) - 1 occurrence from cf"
)
def invocation_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrence of each execution within its attempt, by arrival."""
    rows = bridge.clean_floats(spark, folder).drop("invocation_id")
    return transports.invocation_ids(rows, [*_W3, "attempt_id"], ["row_id"]).select("row_id", F.col("invocation_id").alias("occurrence"))


@query("select o_orderkey, o_custkey, round(o_totalprice, 6) o_totalprice from orders order by o_orderkey limit 1000 offset 2000")
def table_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of a table in key order."""
    return records.page(read(spark, folder, "orders"), ["o_orderkey"], 2000, 1000).select("o_orderkey", "o_custkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("select event_type, count(*) n, sum(json_extract_string(props, '$.k')::bigint) k from events group by 1")
def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events' JSON properties by a declared schema."""
    rows = read(spark, folder, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


# ---------------------------------------------------------------- scalars


@query(_LOSS_SQL + "select model_id, phase, global_batch_id, round(metric_value, 6) lm_loss from ll")
def lm_loss_iteration(spark: SparkSession, folder: str) -> DataFrame:
    """Token-weighted loss of accepted training iterations."""
    out = scalars.weighted_loss(_pairs(spark, folder, cut(_accepted(spark, folder))), strict=False)
    return out.select("model_id", "phase", "global_batch_id", F.round("metric_value", 6).alias("lm_loss"))


@query(_LOSS_SQL + "select model_id, phase, global_batch_id, round(metric_value, 6) grad_norm from gn")
def grad_norm_iteration(spark: SparkSession, folder: str) -> DataFrame:
    """Gradient norm of accepted training iterations."""
    return _grad_norm(spark, folder, cut(_accepted(spark, folder))).select("model_id", "phase", "global_batch_id", F.round("metric_value", 6).alias("grad_norm"))


@query(_LOSS_SQL + "select model_id, 'run' run_name, phase, global_batch_id training_iteration_id, global_batch_id, metric_name, round(metric_value, 6) metric_value from ts")
def training_scalar(spark: SparkSession, folder: str) -> DataFrame:
    """The derived table of both."""
    return _training_scalar(spark, folder, cut(_accepted(spark, folder))).withColumn("metric_value", F.round("metric_value", 6))


@query(
    TELEMETRY_SQL
    + """, l as (select distinct model_id, phase, global_batch_id, dp_rank, microbatch_id, sample_index, attempt_id, invocation_id from cf where act_name = 'lm_per_sample_loss'),
c as (select distinct model_id, phase, global_batch_id, dp_rank, microbatch_id, sample_index, attempt_id, invocation_id from ci where act_name = 'lm_per_sample_loss_token_count')
select *, 'left' side from (select * from l except select * from c) union all select *, 'right' from (select * from c except select * from l)"""
)
def unpaired_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Samples that have a loss or a token count but not both."""
    keys = ["model_id", "phase", "global_batch_id", "dp_rank", "microbatch_id", "sample_index", "attempt_id", "invocation_id"]
    return checks.one_sided(bridge.clean_floats(spark, folder).where(F.col("act_name") == scalars.LOSS), bridge.clean_ints(spark, folder).where(F.col("act_name") == scalars.LOSS_TOKENS), keys)


@query(
    _LOSS_SQL
    + """, o as (select distinct model_id, global_batch_id from ts), a as (select model_id, global_batch_id from acc)
select *, 'left' side from (select * from o except select * from a) union all select *, 'right' from (select * from a except select * from o)"""
)
def uncovered_iterations(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted iterations without output, and the reverse."""
    accepted = cut(_accepted(spark, folder))
    return scalars.uncovered(_training_scalar(spark, folder, accepted), accepted)


@query(
    _LOSS_SQL
    + """, g as (select model_id, global_batch_id, unnest(['lm_loss_iteration', 'grad_norm']) metric_name from acc),
h as (select model_id, global_batch_id, metric_name, count(*) "rows" from ts group by 1, 2, 3)
select g.*, coalesce(h."rows", 0) "rows" from g left join h using (model_id, global_batch_id, metric_name) where coalesce(h."rows", 0) <> 1"""
)
def metric_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted iterations in which a required metric is not there exactly once."""
    accepted = cut(_accepted(spark, folder))
    return scalars.metric_gaps(_training_scalar(spark, folder, accepted), accepted)


@query(TELEMETRY_SQL + "select model_id, phase, global_batch_id, layer_no, round(avg(value), 6) entropy_mean, count(*) sample_count from vis where act_name = 'router_token_entropy_mean' and value is not null and isfinite(value) group by 1, 2, 3, 4")
def router_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Mean router entropy per layer."""
    rows = _visible(spark, folder).where((F.col("act_name") == "router_token_entropy_mean") & checks.is_finite(F.col("value")))
    return experts.router_entropy(rows).withColumn("entropy_mean", F.round("entropy_mean", 6))


@query(
    _LOSS_SQL
    + """select l.model_id, l.global_batch_id, max(g.global_batch_id) state_global_batch_id, round(arg_max(g.metric_value, g.global_batch_id), 6) state_value
from ll l left join gn g on g.model_id = l.model_id and g.global_batch_id < l.global_batch_id group by 1, 2"""
)
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """Each iteration's loss with the latest gradient norm before it."""
    accepted = cut(_accepted(spark, folder))
    facts = scalars.weighted_loss(_pairs(spark, folder, accepted), strict=False).select("model_id", "global_batch_id")
    states = _grad_norm(spark, folder, accepted).withColumnRenamed("metric_value", "state_value")
    out = asof.latest_before(facts, states, "global_batch_id", ["model_id"], ["state_value"])
    return out.withColumn("state_value", F.round("state_value", 6))


@query(
    """with e as (select *, event_id % 3 = 0 st from events)
select f.event_id, f.user_id, f.ts, s.ts state_ts, s.event_id state_event from (select * from e where not st) f asof left join (select user_id, ts, max(event_id) event_id from e where st group by 1, 2) s on f.user_id = s.user_id and f.ts > s.ts"""
)
def asof_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with its user's latest state event before it; groups swept in lanes."""
    e = read(spark, folder, "events")
    facts, states = e.where("event_id % 3 <> 0").select("event_id", "user_id", "ts"), e.where("event_id % 3 = 0").select("user_id", "ts", F.col("event_id").alias("state_event"))
    return asof.latest_before(facts, states, "ts", ["user_id"], ["state_event"], lanes=4)


# ---------------------------------------------------------------- experts


@query(LOAD_SQL + "select * from load")
def expert_load(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per expert before and after drops, and dropped."""
    return experts.expert_load(*bridge.expert_counts(spark, folder))


@query(
    LOAD_SQL
    + """, p as (select model_id, phase, global_batch_id, layer_no, max(token_count) filter (load_kind = 'post_drop') mx, sum(token_count) filter (load_kind = 'post_drop') sm, avg(token_count) filter (load_kind = 'post_drop') av,
  stddev_pop(token_count) filter (load_kind = 'post_drop') sd, count(*) filter (load_kind = 'post_drop' and token_count > 0) ac, count(*) filter (load_kind = 'post_drop' and token_count = 0) de,
  sum(token_count) filter (load_kind = 'dropped') dr, sum(token_count) filter (load_kind = 'pre_drop') pr from load group by 1, 2, 3, 4)
select model_id, phase, global_batch_id, layer_no, ac::integer active_expert_count, de::integer dead_expert_count, round(case when av = 0 then 0 else sd / av end, 6) load_cv,
  round(case when sm = 0 then 0 else mx / sm end, 6) max_load_share, round(case when pr = 0 then 0 else dr / pr end, 6) drop_rate from p"""
)
def expert_load_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Activity, imbalance and drops of each layer."""
    out = experts.load_summary(experts.expert_load(*bridge.expert_counts(spark, folder)))
    return out.withColumns({c: F.round(c, 6) for c in ("load_cv", "max_load_share", "drop_rate")})


@query(
    """with x as (select label, unnest(range(64))::integer expert_id, unnest(embedding)::double v from embeddings)
select label, expert_id, round(sum(floor(abs(v) * 100)), 6)::bigint token_count from x group by 1, 2"""
)
def summed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Element-wise sums of vectors per label."""
    rows = read(spark, folder, "embeddings").select("label", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("bigint")).alias("counts"))
    return experts.sum_vectors(rows, ["label"])


# ---------------------------------------------------------------- arrays


@query(
    """with x as (select vec_id, embedding[1:32] a, embedding[33:64] b from embeddings)
select vec_id, round(list_dot_product(list_transform(a, lambda v: v::double), list_transform(a, lambda v: v::double)) ** 0.5, 5) length,
  round(list_cosine_similarity(list_transform(a, lambda v: v::double), list_transform(b, lambda v: v::double)), 5) cosine from x"""
)
def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Length of one half of each vector, and cosine of both halves."""
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    return read(spark, folder, "embeddings").select("vec_id", F.round(arrays.norm(a), 5).alias("length"), F.round(arrays.cosine(a, b, strict=False), 5).alias("cosine"))


@query(VECTORS_SQL + "select vec_id, round(-sum(greatest(p, 1e-20) * ln(greatest(p, 1e-20))), 6) entropy, round(max(p), 6) top from vp group by 1")
def softmax_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy and largest probability of a softmax."""
    p = arrays.softmax(F.col("logits"))
    return bridge.router_vectors(spark, folder).select("vec_id", F.round(arrays.entropy(p), 6).alias("entropy"), F.round(F.array_max(p), 6).alias("top"))


@query(
    """with x as (select vec_id, unnest(range(64))::integer i, unnest(embedding) v from embeddings), r as (select *, row_number() over (partition by vec_id order by v desc, i) n from x)
select vec_id, list(round(v::double, 5) order by n) top_values, list(i order by n) indices from r where n <= 5 group by 1"""
)
def top_values(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest values and their places."""
    v, i = arrays.top_k(F.col("embedding"), 5)
    return read(spark, folder, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x.cast("double"), 5)).alias("top_values"), i.alias("indices"))


@query(
    """with u as (select run_id, decision_id, row_number() over () r, weights w from (select distinct run_id, decision_id, weights from loss_slope_mixture_decisions)),
x as (select r, unnest(range(len(w)))::integer i, unnest(w) v from u where len(w) > 0), g as (select r, bool_and(v is not null and isfinite(v) and v > 0) ok, sum(v) s from x group by 1)
select u.run_id, u.decision_id, list(round(x.v / g.s, 6) order by x.i) weights from x join g using (r) join u using (r) where g.ok group by r, 1, 2"""
)
def normalized_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Positive weights over their sum."""
    d = read(spark, folder, "loss_slope_mixture_decisions").select("run_id", "decision_id", "weights").distinct()
    out = d.withColumn("weights", arrays.normalize_weights(F.col("weights"), strict=False)).where("weights is not null")
    return out.withColumn("weights", F.transform("weights", lambda x: F.round(x, 6)))


@query(
    """with d as (select distinct run_id, decision_id, weights w, eta, uniform_smoothing s from loss_slope_mixture_decisions where decision_type = 'UPDATE' and len(weights) = 6
  and len(list_filter(weights, lambda x: x is null or not isfinite(x) or x <= 0)) = 0 and eta is not null and uniform_smoothing is not null),
k as (select *, row_number() over () r from d), x as (select r, unnest(range(6)) i, unnest(w) v, eta, s from k),
z as (select *, ln(v) + eta * (0.1 * i) l from x), e as (select *, exp(l - max(l) over (partition by r)) e from z), p as (select *, (1 - s) * e / sum(e) over (partition by r) + s / 6 q from e)
select k.run_id, k.decision_id, list(round(q, 6) order by i) weights from p join k using (r) group by r, 1, 2"""
)
def updated_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture rule applied to stored weights, with indicators 0.0, 0.1 ... 0.5."""
    d = read(spark, folder, "loss_slope_mixture_decisions").where("decision_type = 'UPDATE' and eta is not null and uniform_smoothing is not null").select("run_id", "decision_id", "weights", "eta", "uniform_smoothing").distinct()
    good = d.where(F.col("weights").isNotNull() & (F.size("weights") == 6) & F.forall("weights", lambda w: checks.is_finite(w) & (w > 0)))
    indicators = F.array(*[F.lit(0.1 * i) for i in range(6)])
    out = good.withColumn("weights", arrays.updated_mixture(F.col("weights"), indicators, F.col("eta"), F.col("uniform_smoothing")))
    return out.select("run_id", "decision_id", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"))


# ---------------------------------------------------------------- router reductions


@query(
    """with t as (select vec_id, unnest(range(8)) s, unnest([embedding[i * 8 + 1 : i * 8 + 8] for i in range(8)]) l from embeddings),
x as (select vec_id, s, unnest(range(8))::integer expert_id, unnest(l)::double v from t), e as (select *, exp(v - max(v) over (partition by vec_id, s)) e from x), p as (select *, e / sum(e) over (partition by vec_id, s) p from e)
select vec_id, expert_id, round(coalesce(sum(p) filter (s < vec_id % 9), 0) / greatest(count(*) filter (s < vec_id % 9), 1), 6) prob from p group by 1, 2"""
)
def mean_router_probs(spark: SparkSession, folder: str) -> DataFrame:
    """Mean probabilities over a valid prefix (vectors as 8 tokens of 8 experts)."""
    return router.mean_probs(_tokens(spark, folder), ["vec_id"]).withColumn("prob", F.round("prob", 6))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.array(*[F.slice("embedding", 8 * i + 1, 8) for i in range(8)])
    long = read(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 9).alias("valid_count"), F.posexplode(parts).alias("seq", "logits"))
    return long


@query(
    """with t as (select vec_id, unnest(range(8)) s, unnest([embedding[i * 8 + 1 : i * 8 + 8] for i in range(8)]) l from embeddings),
x as (select vec_id, s, unnest(l)::double v from t), e as (select *, exp(v - max(v) over (partition by vec_id, s)) e from x), p as (select *, e / sum(e) over (partition by vec_id, s) p from e),
h as (select vec_id, s, -sum(p * ln(p)) h from p group by 1, 2)
select vec_id, round(coalesce(sum(h) filter (s < vec_id % 9), 0) / greatest(count(*) filter (s < vec_id % 9), 1), 6) entropy_mean from h group by 1"""
)
def mean_token_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Mean token entropy over a valid prefix."""
    return router.mean_entropy(_tokens(spark, folder), ["vec_id"]).withColumn("entropy_mean", F.round("entropy_mean", 6))


@query(
    """with x as (select vec_id, unnest(embedding)::double v from embeddings)
select vec_id, round(coalesce(sum(v) filter (v > 0), 0) / greatest(count(*) filter (v > 0), 1), 6) loss, count(*) filter (v > 0) token_count from x group by 1"""
)
def masked_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Mask-weighted mean and count per sample (values as losses, positive ones counted)."""
    rows = read(spark, folder, "embeddings").withColumn("mask", F.transform("embedding", lambda x: (x > 0).cast("int")))
    return router.sample_losses(rows, "embedding").select("vec_id", F.round("loss", 6).alias("loss"), "token_count")


# ---------------------------------------------------------------- pathways


@query(VECTORS_SQL + "select vec_id, list_transform(tokens, lambda x: x::integer) pathway from pw")
def pathway_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The experts that together reach half of the probability."""
    return _paths(spark, folder).select("vec_id", "pathway")


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return bridge.router_vectors(spark, folder).withColumn("pathway", arrays.pathway_sequence(F.array(arrays.pathway_tokens(F.col("probs"), 0.5)))).select("vec_id", "global_batch_id", "dataset_id", "pathway", F.get("probs", F.lit(0)).cast("double").alias("score"))


_WIN = VECTORS_SQL + """, it as (select global_batch_id, row_number() over (order by global_batch_id) rn from (select distinct global_batch_id from pw)),
wn as (select w.w, e.rn en, greatest(1, e.rn - w.w + 1) sn, e.global_batch_id window_end_iteration from it e cross join (values (1), (3), (8)) w(w)),
ws as (select wn.*, s.global_batch_id window_start_iteration from wn join it s on s.rn = wn.sn)
"""


@query(
    _WIN
    + """, sc as (select vec_id, q score from vr where i = 0)
select p.dataset_id, ws.w::integer window_size_iterations, (en - sn + 1)::integer effective_window_size_iterations, window_start_iteration, window_end_iteration, count(*) sample_count,
  round(sum(score), 6) consistency_sum, round(avg(score), 6) mean_pathway_consistency
from ws join it on it.rn between sn and en join pw p using (global_batch_id) join sc using (vec_id) group by all"""
)
def window_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Sum and mean of a score over growing, then sliding windows of 1, 3 and 8 iterations."""
    p = _paths(spark, folder)
    out = pathways.window_consistency(p, p.select("global_batch_id"), [1, 3, 8])
    return out.withColumns({c: F.round(c, 6) for c in ("consistency_sum", "mean_pathway_consistency")}).withColumn("effective_window_size_iterations", F.col("effective_window_size_iterations").cast("int"))


@query(
    _WIN
    + """, mb as (select ws.*, p.vec_id, p.dataset_id, p.word from ws join it on it.rn between sn and en join pw p using (global_batch_id)),
n as (select dataset_id, w, en, sn, window_start_iteration, window_end_iteration, count(*) n from mb group by all),
d as (select a.dataset_id, a.w, a.en, sum(levenshtein(a.word, b.word)) d from mb a join mb b on a.dataset_id = b.dataset_id and a.w = b.w and a.en = b.en and a.vec_id < b.vec_id group by 1, 2, 3)
select n.dataset_id, n.w::integer window_size_iterations, (n.en - sn + 1)::integer effective_window_size_iterations, window_start_iteration, window_end_iteration, n.n sample_count, n.n * (n.n - 1) // 2 pair_count,
  coalesce(d.d, 0)::double pathway_edit_distance_sum, round(case when n.n > 1 then coalesce(d.d, 0) / (n.n * (n.n - 1) // 2) end, 6) mean_pathway_edit_distance
from n left join d on n.dataset_id = d.dataset_id and n.w = d.w and n.en = d.en"""
)
def window_edit_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Mean edit distance of all pairs of pathways in those windows."""
    p = _paths(spark, folder)
    out = pathways.window_distances(p, p.select("global_batch_id"), [1, 3, 8])
    return out.withColumn("mean_pathway_edit_distance", F.round("mean_pathway_edit_distance", 6)).withColumn("effective_window_size_iterations", F.col("effective_window_size_iterations").cast("int"))


# ---------------------------------------------------------------- loss slope


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    s = bridge.samples(spark, folder)
    return s.select("run_id", "training_iteration_id").distinct().withColumn("dataset_id", F.explode(F.array(*[F.lit(i) for i in range(4)])))


_METRIC = SAMPLES_SQL + """, im as (
  select g.run_id, g.dataset_id, g.training_iteration_id, count(event_id) sample_count, count(event_id) filter (tokens > 0) positive_loss_sample_count, coalesce(sum(tokens) filter (tokens > 0), 0)::bigint target_token_count, sum(loss * tokens) filter (tokens > 0) wt
  from (select distinct run_id, training_iteration_id, d dataset_id from smp cross join (values (0), (1), (2), (3)) x(d)) g left join smp s on s.training_iteration_id = g.training_iteration_id and s.dataset_id = g.dataset_id group by 1, 2, 3),
mt as (select *, case when sample_count = 0 then 'no_samples' when target_token_count <= 0 then 'no_target_tokens' else '' end incomplete_reason, case when target_token_count > 0 then wt / target_token_count end loss_value from im)
"""


@query(_METRIC + "select run_id, dataset_id, training_iteration_id, case when incomplete_reason = '' then 'COMPLETE' else 'INCOMPLETE' end status, incomplete_reason, sample_count, positive_loss_sample_count, target_token_count, round(loss_value, 6) loss_value from mt")
def iteration_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of each dataset and iteration, complete or not."""
    out = loss_slope.iteration_losses(bridge.samples(spark, folder), _grid(spark, folder))
    return out.withColumn("loss_value", F.round("loss_value", 6))


_IND = _METRIC + """, wi as (select run_id, dataset_id, (training_iteration_id - 1) // 5 + 1 window_id, count(*) ob, list(training_iteration_id order by training_iteration_id) filter (loss_value is null) ms, count(loss_value) pt,
  sum(sample_count)::bigint sample_count, sum(positive_loss_sample_count)::bigint positive_loss_sample_count, sum(target_token_count)::bigint target_token_count, regr_slope(loss_value, training_iteration_id) sl from mt group by 1, 2, 3),
wr as (select *, concat_ws(';', case when ob <> 5 then 'observed_iterations=' || ob || '<5' end, case when len(ms) > 0 then 'missing_loss_iterations=' || array_to_string(ms, ',') end) incomplete_reason from wi)
"""


@query(
    _IND
    + """select run_id, dataset_id, window_id, (window_id - 1) * 5 + 1 window_start_iteration, window_id * 5 window_end_iteration, window_id = 6 terminal_window, case when incomplete_reason = '' then 'COMPLETE' else 'INCOMPLETE' end status,
  incomplete_reason, pt iteration_point_count, 5::integer expected_iteration_point_count, sample_count, positive_loss_sample_count, target_token_count,
  round(case when incomplete_reason = '' then sl end, 6) loss_slope, round(case when incomplete_reason = '' then -sl end, 6) indicator from wr"""
)
def window_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """Slope of each dataset's losses in windows of five iterations."""
    out = loss_slope.window_indicators(loss_slope.iteration_losses(bridge.samples(spark, folder), _grid(spark, folder)), 5, 6)
    return out.withColumns({c: F.round(c, 6) for c in ("loss_slope", "indicator")})


@query(
    _IND.replace("with smp", "with recursive smp", 1)
    + """, wl as (select window_id w, list(-sl order by dataset_id) i, string_agg(case when incomplete_reason <> '' then 'dataset=' || dataset_id || ':' || incomplete_reason end, '|' order by dataset_id) br from wr group by 1),
fold as (select 0::bigint w, [0.25::double, 0.25, 0.25, 0.25] ws, null::varchar br
  union all
  select w, case when br is not null then old else list_transform(q, lambda x: x / list_sum(q)) end, br from (
    select *, list_transform(e, lambda x: 0.9 * x / list_sum(e) + 0.1 / 4) q from (
      select *, list_transform(z, lambda x: exp(x - list_max(z))) e from (
        select l.w, l.br, f.ws old, list_transform([0, 1, 2, 3], lambda k: ln(f.ws[k + 1]) + 0.5 * l.i[k + 1]) z from fold f join wl l on l.w = f.w + 1 where l.w < 6))))
select 'run' run_id, w decision_id, case when br is null then 'UPDATE' else 'HOLD_INCOMPLETE' end decision_type, w source_window_id, 5 * w source_window_end_iteration, w + 1 effective_window_id, 5 * w + 1 effective_training_iteration,
  list_transform(ws, lambda x: round(x, 6)) weights, coalesce(br, 'loss_slope') reason from fold where w > 0"""
)
def mixture_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions that follow, window by window."""
    indicators = loss_slope.window_indicators(loss_slope.iteration_losses(bridge.samples(spark, folder), _grid(spark, folder)), 5, 6)
    made = loss_slope.decisions_made(loss_slope.decide(indicators, loss_slope.Settings(5, 6, 0.5, 0.1)))
    return made.withColumn("weights", F.transform("weights", lambda w: F.round(w, 6)))


@query(SAMPLES_SQL + "select run_id, training_iteration_id, dataset_id, count(*) sample_count from smp group by 1, 2, 3")
def realized_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of each dataset per iteration."""
    return loss_slope.realized_mixture(bridge.samples(spark, folder))


@query("select run_id, dataset_id, window_id, round(case when isfinite(regr_slope(loss_value, training_iteration_id)) then regr_slope(loss_value, training_iteration_id) end, 6) slope, count(*) points from loss_slope_iteration_metrics where loss_value is not null and isfinite(loss_value) group by 1, 2, 3")
def stored_loss_slopes(spark: SparkSession, folder: str) -> DataFrame:
    """Slope of the stored losses per run, dataset and window."""
    rows = read(spark, folder, "loss_slope_iteration_metrics").where(checks.is_finite(F.col("loss_value")))
    return rows.groupBy("run_id", "dataset_id", "window_id").agg(F.round(F.regr_slope("loss_value", F.col("training_iteration_id").cast("double")), 6).alias("slope"), F.count(F.lit(1)).alias("points"))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "selection_windows").dropDuplicates(["run_id", "window_id"])


_SEL = """with w as (select * exclude (n) from (select *, row_number() over (partition by run_id, window_id) n from selection_windows) where n = 1),
dr as (select run_id, window_id, first_training_iteration, unnest(range(len(dataset_index)))::integer pos, unnest(dataset_index) dataset_id, unnest(dataset_sample_index) sample from w)
"""


@query(_SEL + """, it as (select distinct run_id, first_training_iteration + pos // 16 training_iteration_id from dr)
select it.run_id, it.training_iteration_id, d::integer dataset_id, count(dr.pos) draws from it cross join (select unnest(range(6)) d) left join dr on dr.run_id = it.run_id and dr.first_training_iteration + dr.pos // 16 = it.training_iteration_id and dr.dataset_id = d group by 1, 2, 3""")
def selection_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Draws per iteration of 16 samples and dataset."""
    return loss_slope.selection_counts(_windows(spark, folder), 16, 6)


@query(_SEL + ", r as (select *, row_number() over (partition by run_id, dataset_id order by window_id, pos) - 1 expected from dr) select run_id, window_id, pos, dataset_id, sample, expected from r where sample <> expected")
def misnumbered_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Draws whose running number is not the number of draws before."""
    return loss_slope.running_samples(_windows(spark, folder)).where("sample <> expected").select("run_id", "window_id", "pos", "dataset_id", "sample", "expected")


@query(
    _SEL
    + """select distinct w.run_id, w.window_id, w.decision_id, d.decision_id made_decision_id from w join loss_slope_mixture_decisions d on d.run_id = w.run_id and d.effective_window_id = w.window_id"""
)
def decisions_of_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows with the decision made for them."""
    out = loss_slope.decisions_for_windows(read(spark, folder, "loss_slope_mixture_decisions"), _windows(spark, folder))
    return out.select("run_id", "window_id", "decision_id", "made_decision_id").distinct()


@query(_SEL + """, p as (select *, lag(counters_after) over o prev, lag(window_id) over o pid from w window o as (partition by run_id order by window_id))
select run_id, window_id from p where pid = window_id - 1 and list_transform(range(len(counters_after)), lambda i: prev[i + 1] + len(list_filter(dataset_index, lambda d: d = i))) is distinct from counters_after""")
def counter_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Windows whose counters do not follow from the window before."""
    return lineage.counter_breaks(_windows(spark, folder)).select("run_id", "window_id")


@query(_SEL + """, x as (select run_id, first_training_iteration a, first_training_iteration + 49 b from w), y as (select *, lag(b) over (partition by run_id order by a, b) p from x)
select run_id, a valid_start, b valid_end, p previous_end from y where not coalesce(a = coalesce(p + 1, 1) and b >= a, false)""")
def lineage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that do not continue the one before, were each 50 iterations long."""
    parts = _windows(spark, folder).select("run_id", F.col("first_training_iteration").alias("valid_start"), (F.col("first_training_iteration") + 49).alias("valid_end"))
    return lineage.lineage_gaps(parts)


# ---------------------------------------------------------------- conversations


@query(TURNS_SQL + "select doc_id, turn, \"role\", sum(case when \"role\" = 'system' then 1 else 0 end) over (partition by doc_id order by turn rows unbounded preceding)::bigint segment from tn")
def conversation_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with the number of their segment."""
    return segments.segment_rows(bridge.turns(spark, folder), ["doc_id"], ["turn"]).select("doc_id", "turn", "role", "segment")


@query(TURNS_SQL + ", g as (select doc_id, count(*) turns, count(*) filter (\"role\" = 'system') s, arg_min(\"role\", turn) f from tn group by 1) select doc_id, turns, (s + case when f <> 'system' then 1 else 0 end)::integer conversations from g")
def conversation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations per document."""
    roles = bridge.turns(spark, folder).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return roles.select("doc_id", F.size("roles").cast("bigint").alias("turns"), segments.count_conversations(F.col("roles")).alias("conversations"))


@query(
    TURNS_SQL
    + """, g as (select doc_id, count(*) filter ("role" = 'system') + case when arg_min("role", turn) <> 'system' then 1 else 0 end n from tn group by 1), f as (select *, 'f' || doc_id % 5 file from g),
p as (select file, count(*) "rows", max(n)::integer max_conversations, arg_min(doc_id, (-n, doc_id)) first_line from f group by 1)
select file, "rows", max_conversations, first_line, file first_file from p union all select null, sum("rows")::bigint, max(max_conversations), arg_min(first_line, (-max_conversations, file)), arg_min(file, (-max_conversations, file)) from p"""
)
def conversation_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Most conversations in a row, per file and over all, and where first."""
    roles = bridge.turns(spark, folder).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    rows = roles.select(F.concat(F.lit("f"), F.col("doc_id") % 5).alias("file"), F.col("doc_id").alias("line"), "roles")
    return segments.conversation_bound(rows)


@query(
    TURNS_SQL
    + """, s as (select *, sum(case when "role" = 'system' or rn = 1 then 1 else 0 end) over (partition by doc_id order by turn rows unbounded preceding) seg from (select *, row_number() over (partition by doc_id order by turn) rn from tn)),
r as (select doc_id, seg, min(rn) - 1 a, max(rn) b from s group by 1, 2), l as (select doc_id, list(a::integer order by seg) a, list(b::integer order by seg) b from r group by 1)
select doc_id, list_resize(a, 4096, b[len(b)]) starts, list_resize(b, 4096, b[len(b)]) ends from l"""
)
def padded_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as ranges of a fixed number of places, 4096."""
    roles = bridge.turns(spark, folder).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    starts = roles.select("doc_id", segments.conversation_starts(F.col("roles")).alias("s"), F.size("roles").alias("n"))
    ranges = F.transform("s", lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get("s", i + 1), F.col("n")).alias("end")))
    padded = starts.select("doc_id", segments.padded_ranges(ranges, 4096).alias("p"))
    return padded.select("doc_id", "p.starts", "p.ends")


@query(
    """with e as (select user_id, event_id, event_id % 3 v from events)
select user_id, event_id, v, coalesce(sum(v) over w, 0)::bigint "offset", coalesce(sum((v > 0)::integer) over w, 0)::bigint active_index from e window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)"""
)
def packed_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where each sample lies in its packed payload."""
    e = read(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("v"))
    return transports.packed_offsets(e, ["user_id"], "event_id", "v")


# ---------------------------------------------------------------- logs and comparisons

_LINES = r"""with ln as (select doc_id, unnest(string_split_regex(text, '\r?\n')) line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 line_no from documents where source = 'run_log' and text is not null)
"""


@query(
    _LINES
    + r"""select * from (select doc_id, line_no::integer line_no, try_cast(regexp_extract(line, '(?i)\biteration +([0-9]+)', 1) as bigint) iteration, try_cast(regexp_extract(line, '(?i)\blm loss: *([0-9.eE+-]+)', 1) as double) lm_loss,
  try_cast(regexp_extract(line, '(?i)\bgrad norm: *([0-9.eE+-]+)', 1) as double) grad_norm, try_cast(regexp_extract(line, '(?i)\bskipped: *([0-9]+)', 1) as integer) skipped from ln) where iteration is not null and lm_loss is not null"""
)
def log_iterations(spark: SparkSession, folder: str) -> DataFrame:
    """Iteration lines of training logs."""
    return logs.iteration_lines(_lines(spark, folder))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return logs.log_lines(read(spark, folder, "documents").where("source = 'run_log' and text is not null"))


@query(
    _LINES
    + r""", f as (select try_cast(regexp_extract(line, '(?i)flush rows=([0-9]+)', 1) as bigint) r, try_cast(regexp_extract(line, '(?i)took=([0-9]+)ms', 1) as bigint) t, doc_id from ln),
g as (select doc_id % 10 shard, t, row_number() over (partition by doc_id % 10 order by t) n, count(*) over (partition by doc_id % 10) c from f where r is not null and t is not null)
select shard, max(c) n, round(avg(t), 6) mean, median(t)::double p50, max(t) filter (n = round_even((c - 1) * 0.95, 0)::bigint + 1) p95 from g group by 1"""
)
def flush_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median and nearest-rank p95 of flush times."""
    rows = logs.flush_lines(_lines(spark, folder)).withColumn("shard", F.col("doc_id") % 10)
    return logs.timing_stats(rows, ["shard"], "took_ms").withColumn("mean", F.round("mean", 6))


@query(_LINES + r""", f as (select doc_id, line_no iteration, try_cast(regexp_extract(line, '(?i)took=([0-9]+)ms', 1) as bigint) ms, try_cast(regexp_extract(line, '(?i)flush rows=([0-9]+)', 1) as bigint) r from ln)
select iteration % 5 = 0 flush_boundary, count(*) n, round(avg(ms), 6) mean from f where iteration >= 6 and ms is not null and r is not null group by 1""")
def flush_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Times on and off a boundary of five, after a warm-up."""
    rows = logs.flush_lines(_lines(spark, folder)).select(F.col("line_no").alias("iteration"), F.col("took_ms").alias("ms"))
    return logs.split_flushes(rows, 5).withColumn("mean", F.round("mean", 6))


@query(
    """with r as (select o_orderpriority pair, o_orderkey // 2 % 50 repetition, case when o_orderkey % 2 = 0 then 'off' else 'on' end mode, o_totalprice secs from orders),
b as (select pair, repetition, max(secs) filter (mode = 'off') f, max(secs) filter (mode = 'on') n from r group by 1, 2), q as (select pair, (n - f) / f x from b where f is not null and n is not null)
select pair, count(x) repetitions, round(avg(x), 6) mean_overhead, round(coalesce(stddev_samp(x), 0), 6) overhead_deviation from q group by 1"""
)
def paired_overheads(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of (on - off) / off over repetitions."""
    o = read(spark, folder, "orders").select(F.col("o_orderpriority").alias("pair"), F.expr("o_orderkey div 2 % 50").alias("repetition"), F.when(F.col("o_orderkey") % 2 == 0, "off").otherwise("on").alias("mode"), F.col("o_totalprice").alias("seconds"))
    return logs.overhead(o, ["pair"]).withColumns({c: F.round(c, 6) for c in ("mean_overhead", "overhead_deviation")})


_TIMED = """with o as (select o_custkey % 20 log, row_number() over (partition by o_custkey % 20 order by o_orderkey) - 1 n, o_totalprice ms, o_orderpriority pr from orders)
"""


def _timed_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as lines of twenty logs: an evaluation timer, a loss line that names a phase, or memory, by priority."""
    o = read(spark, folder, "orders").select((F.col("o_custkey") % 20).alias("doc_id"), "o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string").alias("ms"), F.substring("o_orderpriority", 1, 1).alias("p"))
    line = F.when(F.col("p") == "1", F.concat(F.lit("    evaluate ......................: (1.5, "), "ms", F.lit(")")))
    line = line.when(F.col("p") == "2", F.lit(" validation loss at iteration 10 on validation set | lm loss value: 1.0")).when(F.col("p") == "3", F.lit(" validation loss at iteration 10 on test set | lm loss value: 1.0"))
    line = line.when(F.col("p") == "4", F.concat(F.lit("[Rank 0] memory (MB) | allocated: 1.0 | max allocated: "), "ms", F.lit(" | reserved: 2.0 | max reserved: "), "ms")).otherwise("other")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"])
    return o.groupBy("doc_id").agg(listed.alias("lines")).select("doc_id", F.posexplode("lines").alias("line_no", "line"))


@query(
    _TIMED
    + """, t as (select *, substr(pr, 1, 1) p from o), w as (select *, list(case p when '2' then 'valid' when '3' then 'test' end) over (partition by log order by n rows between 1 following and 7 following) nx,
  row_number() over (partition by log, p order by n) - 1 block from t)
select log doc_id, coalesce(list_filter(nx, lambda x: x is not null)[1], 'unknown') phase, count(*) n, round(max(round(ms, 2)), 2) slowest_ms from w where p = '1' and block > 0 group by 1, 2"""
)
def eval_timers(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluations after the first of each log, by the phase that the lines after them name."""
    timers = logs.warmed(logs.eval_timers(_timed_logs(spark, folder)))
    return timers.groupBy("doc_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.max("max_ms").alias("slowest_ms"))


@query(_TIMED + "select log doc_id, max(round(ms, 2)) max_allocated_mb, max(round(ms, 2)) max_reserved_mb from o where pr[1] = '4' group by 1")
def memory_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """The most memory allocated and reserved in each log."""
    return logs.memory_peaks(_timed_logs(spark, folder))


# ---------------------------------------------------------------- contribution


def _contribution_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as tokens of four routes: 16 values each are a route's output, its weight their first value in tenths."""
    out = lambda i: F.transform(F.slice("embedding", 16 * i + 1, 16), lambda x: x.cast("double"))
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.round(F.get("embedding", F.lit(16 * i)).cast("double"), 1).alias("weight"), out(i).alias("output")) for i in range(4)])
    combined = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), [out(i) for i in range(4)])
    return read(spark, folder, "embeddings").select((F.col("label") % 4).cast("int").alias("layer_no"), "vec_id", slots.alias("slots"), combined.alias("combined"))


@query(
    """with s as (select vec_id, (label % 4)::integer layer, unnest(range(4)) slot, unnest([embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]]) o from embeddings),
x as (select vec_id, layer, slot, unnest(range(16)) j, unnest(o)::double v, round(o[1]::double, 1) w from s),
c as (select vec_id, j, sum(v) c from x group by 1, 2),
r as (select vec_id, layer, slot, any_value(w) w, sqrt(sum(v * v)) nrm, sum(v * c) dt, sqrt(sum(c * c)) cn from x join c using (vec_id, j) group by 1, 2, 3),
t as (select vec_id, layer, max(nrm) mn, max(w) mw from r group by 1, 2),
u as (select t.vec_id, t.layer, count(*) filter (r.nrm = mn) un, count(*) filter (r.w = mw) uw, max(r.w) filter (r.nrm = mn) ww, max(r.dt / (r.nrm * r.cn)) filter (r.w = mw) al from t join r using (vec_id) group by 1, 2),
k as (select u.*, (select count(*) from r where r.vec_id = u.vec_id and r.w > u.ww) rk from u)
select layer global_moe_layer, count(*) valid_token_count, count(*) filter (un <> 1) magnitude_tie_token_count, [count(*) filter (un = 1 and rk = 0), count(*) filter (un = 1 and rk = 1), count(*) filter (un = 1 and rk = 2), count(*) filter (un = 1 and rk = 3)] router_rank_dominance_counts,
  count(*) filter (uw <> 1) top_weight_tie_token_count, round(quantile_cont(al, 0.25) filter (uw = 1), 5) top_route_alignment_q1, round(quantile_cont(al, 0.5) filter (uw = 1), 5) top_route_alignment_median, round(quantile_cont(al, 0.75) filter (uw = 1), 5) top_route_alignment_q3
from k group by 1"""
)
def contribution_report(spark: SparkSession, folder: str) -> DataFrame:
    """Dominance ranks, ties and alignment quartiles of each layer."""
    out = contribution.contribution_report(_contribution_tokens(spark, folder), strict=False)
    return out.withColumns({c: F.round(c, 5) for c in ("top_route_alignment_q1", "top_route_alignment_median", "top_route_alignment_q3")})


@query(
    TELEMETRY_SQL
    + """, o as (select model_id, global_batch_id, layer_no, count(distinct microbatch_id) n from cf where model_id is not null and act_name = 'router_token_entropy_mean' and phase = 'train' and global_batch_id is not null and layer_no is not null group by 1, 2, 3),
p as (select * from (select distinct model_id, global_batch_id from o) join (select distinct model_id, layer_no from o) using (model_id))
select p.model_id, p.global_batch_id, p.layer_no, o.n invocations, case when o.n is null then 'missing' else 'invocations' end problem
from p left join o on p.model_id = o.model_id and p.global_batch_id = o.global_batch_id and p.layer_no = o.layer_no where o.n is null or o.n <> 2"""
)
def grid_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Steps at which a model lacks one of its layers, or has not two microbatches of it."""
    rows = bridge.clean_floats(spark, folder).where("model_id is not null and act_name = 'router_token_entropy_mean' and phase = 'train'")
    return contribution.model_grid_gaps(rows, 2)


# ---------------------------------------------------------------- tensors, packing, reconstruction


@query("select vec_id, 64::bigint elements, list_transform(embedding, lambda x: round(x::double, 5)) \"values\" from embeddings")
def decoded_tensors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors stored as bytes and read back by type and shape."""
    @F.pandas_udf("binary")
    def stored(v: pd.Series) -> pd.Series:
        return v.map(lambda x: x.astype("<f4").tobytes())

    rows = read(spark, folder, "embeddings").select("vec_id", F.lit("router_probs_mean").alias("act_name"), F.lit("torch.float32").alias("dtype"), F.array(F.lit(64).cast("bigint")).alias("shape"), stored("embedding").alias("bytes"))
    out = tensors.decoded(rows, tensors.PROBS)
    return out.select("vec_id", F.get("shape", F.lit(0)).alias("elements"), F.transform("values", lambda x: F.round(x, 5)).alias("values"))


@query(
    """with t as (select vec_id, unnest(range(8)) s, unnest([embedding[i * 8 + 1 : i * 8 + 8] for i in range(8)]) l from embeddings), x as (select vec_id, s, unnest(range(8)) b, unnest(l)::double v from t)
select vec_id, list(round(v, 5) order by b, s) packed from x where s < (vec_id + b) % 9 group by 1"""
)
def packed_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Valid prefixes of 8 samples packed one after another (vectors as [8 places][8 samples])."""
    parts = F.array(*[F.slice("embedding", 8 * i + 1, 8) for i in range(8)])
    valid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: ((F.col("vec_id") + b) % 9).cast("int"))
    out = read(spark, folder, "embeddings").select("vec_id", transports.seq_prefix_pack(parts, valid).alias("p"))
    return out.where(F.size("p") > 0).select("vec_id", F.transform("p", lambda x: F.round(x.cast("double"), 5)).alias("packed"))


@query(
    """with x as (select vec_id, unnest(range(64)) i, unnest(embedding)::double v from embeddings), g as (select vec_id, k, unnest([0, 10, 30, 30]) a, unnest([10, 20, 30, 64]) b, k2 from (select vec_id, 0 k, 0 k2 from embeddings)),
s as (select vec_id, a, b, row_number() over (partition by vec_id order by a, b) - 1 n from g)
select s.vec_id, s.n::integer segment, round(coalesce(sum(v) filter (v > 0), 0) / greatest(count(*) filter (v > 0), 1), 6) loss, count(*) filter (v > 0) token_count from s left join x on x.vec_id = s.vec_id and x.i >= a and x.i < b group by 1, 2"""
)
def segment_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Mask-weighted means of four segments of a packed sequence, one of them empty."""
    ints = lambda *v: F.array(*map(F.lit, v))
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("mask"), ints(0, 10, 30, 30).alias("starts"), ints(10, 20, 30, 64).alias("ends"))
    out = router.segment_losses(rows, "embedding").select("vec_id", F.posexplode("segments").alias("segment", "x"))
    return out.select("vec_id", "segment", F.round("x.loss", 6).alias("loss"), "x.token_count")


@query(
    """with x as (select label, vec_id, vec_id % 24 "row", unnest(range(16))::integer expert_id, unnest(embedding[1:16]) v from embeddings)
select label, "row" % 3 sample_index, expert_id, count(*) filter ("row" // 3 < [8, 4, 0][("row" % 3 + 1)::integer] and v > 0) token_count from x group by 1, 2, 3"""
)
def routed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per sample and expert out of a routing map (signs of vectors, three samples)."""
    rows = read(spark, folder, "embeddings").select("label", (F.col("vec_id") % 24).alias("row"), F.array(F.lit(8), F.lit(4), F.lit(0)).alias("valid"), F.transform(F.slice("embedding", 1, 16), lambda x: x > 0).alias("routed"))
    return router.routed_counts(rows, ["label"], 3, 16)


@query(
    TELEMETRY_SQL
    + """, e as (select distinct model_id, phase, global_batch_id, attempt_id, microbatch_id, layer_no, direction, act_name from (select * replace (-1 as layer_no) from cf where act_name in ('lm_per_sample_loss', 'router_token_entropy_mean')))
select model_id, phase, global_batch_id, attempt_id, microbatch_id, layer_no, direction from e group by all having count(*) < 2"""
)
def incomplete_executions(spark: SparkSession, folder: str) -> DataFrame:
    """Executions (layers taken together) that lack their loss or their entropy."""
    acts = ("lm_per_sample_loss", "router_token_entropy_mean")
    return reconstruct.incomplete_executions(bridge.clean_floats(spark, folder).withColumn("layer_no", F.lit(-1)), acts).drop("acts")


@query("select r::integer \"rank\", (r % 4)::integer tp, (r // 4 % 2)::integer cp, (r // 8 % 4)::integer dp, (r // 32)::integer pp from (select unnest(range(64)) r)")
def rank_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates of 64 ranks, tensor parallelism varying fastest."""
    ranks = spark.range(64).select(F.col("id").cast("int").alias("rank"))
    return ranks.select("rank", *topology.grid_coordinates(F.col("rank"), {"tp": 4, "cp": 2, "dp": 4, "pp": 2}))


def two_rank_manifest() -> topology.Manifest:
    own, both = [(0,), (1,)], [(0, 1)]
    return topology.Manifest("run", own, own, own, both, both, own, own, both, {0: 0}, [(0, 2), (1, 3)], 2)


@query(
    """with e as (select vec_id, vec_id // 40 mb, vec_id % 2 rk, row_number() over (partition by vec_id // 40, vec_id % 2 order by vec_id) - 1 tok, least(abs(embedding[1] * 1000)::bigint % 4, abs(embedding[2] * 1000)::bigint % 3) a, label from embeddings),
r as (select mb, rk, tok, 0 slot, a expert from e union all select mb, rk, tok, 1, a + 1 + (case when a < 2 then 1 else 0 end) * (tok % 2) from e),
q as (select *, case when expert in (0, 2) then 0 else 1 end dest, case when expert in (0, 1) then 0 else 1 end pos from r where expert < 4),
s as (select *, row_number() over (partition by mb, rk order by expert, tok * 2 + slot) src from q), p as (select *, row_number() over (partition by mb, dest order by pos, rk, src) - 1 n from s)
select mb microbatch_id, rk::integer dp_rank, tok token_index, sum(n + 1000 * dest)::double combined from p group by 1, 2, 3"""
)
def reconstructed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Two expert-parallel ranks put back together; a packed row holds its own place, so sums tell where routes were found."""
    topo = two_rank_manifest()
    e = read(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 40").alias("mb"), (F.col("vec_id") % 2).cast("int").alias("rk"), F.expr("least(cast(round(abs(embedding[0] * 1000)) as bigint) % 4, cast(round(abs(embedding[1] * 1000)) as bigint) % 3)").cast("int").alias("a"))
    at = [F.lit("run").alias("model_id"), F.lit("train").alias("phase"), F.lit(1).cast("bigint").alias("global_batch_id"), F.lit(0).alias("attempt_id"), F.col("mb").alias("microbatch_id"), F.lit(0).alias("layer_no"), F.lit("fwd").alias("direction")]
    listed = e.groupBy("mb", "rk").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "a"))), lambda x: x["a"]).alias("a"))
    second = lambda x, i: x + 1 + F.when(x < 2, i % 2).otherwise(0)
    made = listed.withColumn("ids", F.transform("a", lambda x, i: F.array(x, second(x, i)))).withColumn("n", F.size("a"))
    where = [*at, F.col("rk").alias("shard_rank"), F.col("rk").alias("dp_rank"), F.lit(0).alias("sample_index"), F.lit(0).cast("bigint").alias("token_start"), F.col("n").cast("bigint").alias("token_end"), F.lit(0).alias("dataset_id")]
    ids = made.select(*where, F.col("ids").alias("matrix"))
    weights = made.select(*where, F.transform("ids", lambda r: F.transform(r, lambda _: F.lit(0.5))).alias("matrix"))
    routes = reconstruct.route_table(ids, weights, topo, strict=False)
    dest = F.when(F.col("expert_id").isin(0, 2), 0).otherwise(1)
    packed = routes.withColumn("shard_rank", dest).groupBy(*reconstruct.EXECUTION, "shard_rank").agg(F.count(F.lit(1)).alias("c"))
    packed = packed.withColumn("rows", F.transform(F.sequence(F.lit(0), F.col("c").cast("int") - 1), lambda i: F.array((i + 1000 * F.col("shard_rank")).cast("double"))))
    found = reconstruct.token_table(reconstruct.reconstruct(ids, weights, ids.limit(0), packed, topo, strict=False))
    return found.select("microbatch_id", "dp_rank", "token_index", F.get("combined", F.lit(0)).alias("combined"))


# ---------------------------------------------------------------- a stream


@query(
    """with s as (select event_id // 40 + 1 it, (user_id % 4)::integer d, value v, event_id % 7 t from events), f as (select it from s group by 1 having count(*) = 40),
ok as (select it from (select it, row_number() over (order by it) n from f) where it = n), g as (select it, unnest([0, 1, 2, 3])::integer d from ok),
m as (select g.it, g.d, count(s.v) n, count(s.v) filter (t > 0) p, coalesce(sum(t) filter (t > 0), 0)::bigint k, sum(v * t) filter (t > 0) w from g left join s on s.it = g.it and s.d = g.d group by 1, 2)
select it training_iteration_id, d dataset_id, case when n = 0 then 'no_samples' when k = 0 then 'no_target_tokens' else '' end incomplete_reason, n sample_count, p positive_loss_sample_count, k target_token_count, round(case when k > 0 then w / k end, 9) loss_value from m"""
)
def streamed_iterations(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream through the online control: iterations of 40 events, emitted in order once complete."""
    source = read(spark, folder, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{folder}/event[s].parquet")  # a pattern, as a stream's own path must be a folder
    sample = lambda accepted, *rest: F.struct(F.lit(accepted).cast("boolean").alias("accepted"), *rest)
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    row = sample(None, (F.col("user_id") % 4).cast("int").alias("dataset_id"), F.col("event_id").alias("sample_key"), F.col("value").alias("loss"), (F.col("event_id") % 7).alias("tokens"))
    mark = sample(True, null("int", "dataset_id"), null("bigint", "sample_key"), null("double", "loss"), null("bigint", "tokens"))
    rows = F.when(F.col("event_id") % 40 == 0, F.array(row, mark)).otherwise(F.array(row))
    stream = events.select(F.lit("run").alias("run_id"), (F.expr("event_id div 40") + 1).alias("training_iteration_id"), F.inline(rows))
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = controller.complete_iterations(stream, 40, [0, 1, 2, 3])
    out.writeStream.option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").format("parquet").trigger(availableNow=True).start().awaitTermination()
    got = controller.in_order(spark.read.schema(out.schema).parquet(f"{at}/rows"))
    return got.select("training_iteration_id", "dataset_id", "incomplete_reason", "sample_count", "positive_loss_sample_count", "target_token_count", F.round("loss_value", 9).alias("loss_value"))
