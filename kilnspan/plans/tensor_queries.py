"""Queries over tensor rows, capture rules and resume states, with their SQL.

The tensor table is made of the embeddings: vector 16 (g - 1) + 4 s + l belongs to iteration
g, sample s and layer l, and is stored as bytes as captures are.  Every fifth iteration has
two attempts (its first two samples are of the rejected one), every seventh was aborted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import captures
from ..functions import arrays
from ..functions.names import same_name
from ..operators import experts, lineage, logs, loss_slope, pathways, reconstruct, router, scalars, topology, transports
from ..schema import COORDINATES, STATUS_ACT, TABLES
from ..session import cut, written
from ..sources import records, tensors
from . import bridge
from .analyses import query, two_rank_manifest
from .bridge import TELEMETRY_SQL, VECTORS_SQL, read

RUN, EXPERTS, LAYERS, HIDDEN, STATES = "run", 16, 4, 4, 20


@F.pandas_udf(T.BinaryType())
def _encoded(values: pd.Series, dtype: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, dtype=arrays.DTYPES[d.removeprefix("torch.")]).tobytes() for v, d in zip(values, dtype, strict=True)])


def _rows(df: DataFrame, act: str, dtype: str, shape: list[int], values: Column, direction: str = "fwd", **coordinates: Column | int) -> DataFrame:
    """Tensor rows of a measure, with the coordinates named and defaults for the others."""
    fixed = {"model_id": RUN, "act_name": act, "direction": direction, "phase": "train", "dp_rank": 0, "microbatch_id": 0, "sample_index": 0, "layer_no": -1, "shard_rank": 0, "token_start": 0, "token_end": 1, "attempt_id": 0, "invocation_id": 0, "dataset_id": 0}
    at = {**fixed, **coordinates}
    key = [(c if isinstance(c := at[name], Column) else F.lit(c)).cast(kind).alias(name) for name, kind in COORDINATES]
    shaped = df.select(*key, F.lit(dtype).alias("dtype"), F.array(*map(F.lit, shape)).cast("array<bigint>").alias("shape"), values.cast("array<double>").alias("v"))
    out = shaped.withColumn("bytes", _encoded("v", "dtype")).drop("v")
    return out.select(*[f.name for f in TABLES["raw"].fields])


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tensor rows and attempt statuses."""
    e = bridge.router_vectors(spark, folder).join(read(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")
    iteration, nth, layer = F.expr("vec_id div 16 + 1"), F.expr("vec_id div 4 % 4"), F.expr("vec_id % 4")
    attempt = F.when((iteration % 5 == 0) & (nth >= 2), 1).otherwise(0)
    sample = dict(global_batch_id=iteration, sample_index=nth, layer_no=layer, attempt_id=attempt, dataset_id=nth)
    pre = F.transform(F.slice("embedding", 1, EXPERTS), lambda x: F.floor(F.abs(x.cast("double")) * 100))
    post = F.transform(pre, lambda n: F.greatest(F.lit(0), n - F.when(n % 3 == 0, 1).otherwise(0)))
    raw = _rows(e, tensors.PROBS, "torch.float32", [EXPERTS], F.col("probs"), **sample)
    raw = raw.unionByName(_rows(e, tensors.PRE, "torch.int64", [EXPERTS], pre, **sample)).unionByName(_rows(e, tensors.POST, "torch.long", [EXPERTS], post, **sample))
    state = 3 * F.expr("vec_id div 4")
    identity = dict(dp_rank=-1, microbatch_id=-1, sample_index=-1, layer_no=layer, shard_rank=-1, attempt_id=F.when((state > 0) & (state % 5 == 0), 1).otherwise(0), dataset_id=-1)
    weights = _rows(e.where(F.col("vec_id") < 4 * STATES), tensors.WEIGHTS, "torch.float64", [EXPERTS, HIDDEN], F.col("embedding"), "iter", global_batch_id=state, **identity)
    its = e.select(iteration.alias("g")).distinct()
    marks = its.select("g", F.explode(F.when(F.col("g") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("a"))
    value = F.when((F.col("g") % 5 == 0) & (F.col("a") == 0), 0).when(F.col("g") % 7 == 0, -1).otherwise(1)
    fixed = {"model_id": F.lit(RUN), "act_name": F.lit(STATUS_ACT), "direction": F.lit("iter"), "phase": F.lit("train"), "global_batch_id": F.col("g"), "attempt_id": F.col("a"), "token_start": F.lit(0), "token_end": F.lit(1), "invocation_id": F.lit(0)}
    ints = marks.select(*[fixed.get(name, F.lit(-1)).cast(kind).alias(name) for name, kind in COORDINATES], value.cast("bigint").alias("value"))
    return {"raw": raw.unionByName(weights), "raw_scalar_int": cut(ints)}


def _accepted(tables: dict[str, DataFrame]) -> DataFrame:
    return cut(records.TrainingReader(tables).accepted())


_ENCODED = VECTORS_SQL + """,
en as (select vec_id, vec_id // 16 + 1 g, vec_id // 4 % 4 s, vec_id % 4 l, case when (vec_id // 16 + 1) % 5 = 0 and vec_id // 4 % 4 >= 2 then 1 else 0 end att, embedding from embeddings),
ok as (select * from en where g % 7 <> 0 and (g % 5 <> 0 or att = 1))
"""

# ---------------------------------------------------------------- tensor scans


def _scan(rows: DataFrame) -> DataFrame:
    out = tensors.decoded(rows, tensors.PROBS)
    return out.select("global_batch_id", "sample_index", "layer_no", "attempt_id", "dataset_id", F.transform("values", lambda p: F.round(p * 1024).cast("int")).alias("probs_1024"))


_SCAN = "select g global_batch_id, s::integer sample_index, l::integer layer_no, att attempt_id, s::integer dataset_id, list(round(q * 1024)::integer order by i) probs_1024 from {} join (select vec_id, i, q from vr) v using (vec_id) group by 1, 2, 3, 4, 5, vec_id"


@query(_ENCODED + _SCAN.format("ok"))
def tensor_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted, primary tensor rows under a key prefix, decoded."""
    return _scan(records.TrainingReader(_tables(spark, folder)).tensors((RUN, tensors.PROBS, "fwd", "train")))


@query(_ENCODED + _SCAN.format("en"))
def tensor_scan_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The same for all attempts and invocations."""
    return _scan(records.TrainingReader(_tables(spark, folder)).raw_tensors((RUN, tensors.PROBS)))


@query(
    _ENCODED
    + """, x as (select g, l, unnest(range(16))::integer e, unnest(list_transform(embedding[1:16], lambda v: floor(abs(v::double) * 100)::bigint)) pre from ok),
c as (select g, l, e, sum(pre)::bigint pre, sum(greatest(0, pre - case when pre % 3 = 0 then 1 else 0 end))::bigint post from x group by 1, 2, 3)
select 'run' model_id, 'train' phase, g global_batch_id, l::integer layer_no, e expert_id, unnest(['pre_drop', 'post_drop', 'dropped']) load_kind, unnest([pre, post, pre - post]) token_count from c"""
)
def tensor_expert_load(spark: SparkSession, folder: str) -> DataFrame:
    """Expert loads out of stored count vectors before and after drops."""
    t = _tables(spark, folder)
    counts = tensors.expert_counts(t["raw"], _accepted(t), EXPERTS)
    return experts.expert_load(*[experts.sum_vectors(counts[act], experts.SLICE) for act in (tensors.PRE, tensors.POST)])


def _samples(t: dict[str, DataFrame]) -> DataFrame:
    return pathways.assemble_samples(tensors.router_samples(t["raw"], _accepted(t), EXPERTS), LAYERS)


@query(
    _ENCODED
    + """, t as (select g, s, l, case when l > 0 then list_prepend(1000000 + l, list_transform(tokens, lambda x: x::bigint)) else list_transform(tokens, lambda x: x::bigint) end t from ok join pw using (vec_id))
select g global_batch_id, s::integer sample_index, s::integer dataset_id, flatten(list(t order by l)) pathway from t group by 1, 2, 3"""
)
def sample_pathways(spark: SparkSession, folder: str) -> DataFrame:
    """Pathways of samples over all their layers, with separators."""
    out = pathways.pathways(_samples(_tables(spark, folder)), 0.5)
    return out.select("global_batch_id", "sample_index", "dataset_id", F.transform("pathway", lambda x: x.cast("bigint")).alias("pathway"))


_STATE_SQL = """,
su as (select distinct 3 * (vec_id // 4) st from embeddings where vec_id < 80),
us as (select st from su where st = 0 or (st % 7 <> 0 and st <= (select max(g) from en))),
gs as (select o.g, max(us.st) st from (select distinct g from ok) o join us on us.st < o.g group by 1)
"""


@query(_ENCODED + _STATE_SQL + "select 'run' model_id, g global_batch_id, st state_id from gs")
def weight_state_of_iterations(spark: SparkSession, folder: str) -> DataFrame:
    """The latest usable router weights before each iteration: identity, shape and layers of all states checked."""
    t = _tables(spark, folder)
    accepted = _accepted(t)
    states = cut(tensors.weight_states(t["raw"], LAYERS, EXPERTS, HIDDEN))
    return tensors.state_of_iterations(accepted, states, accepted)


@query(
    _ENCODED
    + _STATE_SQL
    + """, pr as (select o.g, o.s, o.l, vr.i, vr.q from ok o join vr using (vec_id)),
wt as (select 3 * (vec_id // 4) st, vec_id % 4 l, unnest(range(64)) j, unnest(embedding)::double w from embeddings where vec_id < 80),
v as (select p.g, p.s, p.l, wt.j % 4 h, sum(p.q * wt.w) v from pr p join gs using (g) join wt on wt.st = gs.st and wt.l = p.l and wt.j // 4 = p.i group by 1, 2, 3, 4),
c as (select a.g, a.s, a.l, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) c from v a join v b on a.g = b.g and a.s = b.s and a.h = b.h and b.l = a.l + 1 group by 1, 2, 3),
m as (select *, max(c) over (partition by g, s) mx from c)
select g global_batch_id, s::integer sample_index, s::integer dataset_id, round(1 - avg(c / (mx + 1e-6)), 6) score from m group by 1, 2, 3"""
)
def sample_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Consistency of samples' routing over layers, projected by the weights in force."""
    t = _tables(spark, folder)
    samples, states, accepted = _samples(t), cut(tensors.weight_states(t["raw"], LAYERS, EXPERTS, HIDDEN)), _accepted(t)
    stated = samples.join(tensors.state_of_iterations(samples, states, accepted), ["model_id", "global_batch_id"])
    out = pathways.sample_consistency(stated, states.drop("attempt_id", "model_id"), 1e-6)
    return out.select("global_batch_id", "sample_index", "dataset_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- reconstruction, strictly


def _token_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two ranks per microbatch of 40 vectors: (mb, rk, a), a in 0 ... 2 in token order."""
    e = read(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 40").alias("mb"), (F.col("vec_id") % 2).cast("int").alias("rk"), F.expr("cast(round(abs(embedding[0] * 1000)) as bigint) % 3").cast("int").alias("a"))
    return e.groupBy("mb", "rk").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "a"))), lambda x: x["a"]).alias("a"))


def _stored(rows: DataFrame, act: str, dtype: str, matrix: str, columns: int, **at) -> DataFrame:
    """Tensor rows of matrices of some columns; the shape follows each row's own length."""
    flat = F.flatten(matrix) if columns else F.col(matrix)
    out = _rows(rows.withColumn("__flat", flat), act, dtype, [1], F.col("__flat"), **({"global_batch_id": 1, "microbatch_id": F.col("mb"), "layer_no": 0, "shard_rank": F.col("rk"), "dp_rank": F.col("rk"), "sample_index": 0} | at))
    width = {"torch.float64": 8, "torch.int64": 8}[dtype]
    n = F.expr(f"octet_length(bytes) div {width}")
    return out.withColumn("shape", F.array(F.expr(f"octet_length(bytes) div {width} div {max(columns, 1)}"), F.lit(columns).cast("bigint")) if columns else F.array(n.cast("bigint")))


def _reconstructed(raw: DataFrame, accepted: DataFrame, manifest: topology.Manifest) -> DataFrame:
    shaped = tensors.primary_forward(written(raw), accepted)
    found = reconstruct.token_table(reconstruct.reconstruct(shaped["ids"], shaped["weights"], shaped["maps"], shaped["packed"], manifest))
    return found.orderBy("dp_rank", "dataset_id", "sample_index", "token_index").select("microbatch_id", "dp_rank", "token_index", F.get("combined", F.lit(0)).alias("combined"))


def _one_attempt(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(RUN, 1, 0)], "model_id string, global_batch_id bigint, attempt_id int")


@query(
    """with e as (select vec_id, vec_id // 40 mb, vec_id % 2 rk, row_number() over (partition by vec_id // 40, vec_id % 2 order by vec_id) - 1 tok, abs(embedding[1] * 1000)::bigint % 3 a from embeddings),
r as (select mb, rk, tok, 0 slot, a expert from e union all select mb, rk, tok, 1, a + 1 + (case when a < 2 then 1 else 0 end) * (tok % 2) from e),
q as (select *, case when expert in (0, 2) then 0 else 1 end dest, case when expert in (0, 1) then 0 else 1 end pos from r),
s as (select *, row_number() over (partition by mb, rk order by expert, tok * 2 + slot) src from q), p as (select *, row_number() over (partition by mb, dest order by pos, rk, src) - 1 n from s)
select mb::integer microbatch_id, rk::integer dp_rank, tok token_index, sum(n + 1000 * dest)::double combined from p group by 1, 2, 3"""
)
def stored_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    """Two expert-parallel ranks put back together out of stored bytes, every check on: keys, shapes, inverse maps, bijection."""
    made = _token_routes(spark, folder)
    second = lambda x, i: x + 1 + F.when(x < 2, i % 2).otherwise(0)
    made = made.withColumn("ids", F.transform("a", lambda x, i: F.array(x, second(x, i)))).withColumn("n", F.size("a"))
    made = made.withColumn("weights", F.transform("ids", lambda r: F.transform(r, lambda _: F.lit(0.5))))
    routes = F.flatten(F.transform("ids", lambda r, i: F.transform(r, lambda e, k: F.struct(e.alias("e"), (2 * i + k).alias("n"), i.alias("i")))))
    made = cut(made.withColumn("map", F.transform(F.array_sort(routes), lambda x: x["i"])))
    dest = made.select("mb", F.explode(F.flatten("ids")).alias("e")).withColumn("rk", F.when(F.col("e").isin(0, 2), 0).otherwise(1)).groupBy("mb", "rk").agg(F.count(F.lit(1)).alias("c"))
    packed = dest.withColumn("rows", F.transform(F.sequence(F.lit(0), F.col("c").cast("int") - 1), lambda i: F.array((i + 1000 * F.col("rk")).cast("double"))))
    ids, weights, maps, out = reconstruct.ACTS
    whole = dict(token_end=F.col("n"))
    each = dict(dp_rank=-1, sample_index=-1, token_start=-1, token_end=-1, dataset_id=-1)
    raw = _stored(made, ids, "torch.int64", "ids", 2, **whole).unionByName(_stored(made, weights, "torch.float64", "weights", 2, **whole))
    raw = raw.unionByName(_stored(made, maps, "torch.int64", "map", 0, **each)).unionByName(_stored(packed, out, "torch.float64", "rows", 1, **each))
    return _reconstructed(raw, _one_attempt(spark), two_rank_manifest())


@query(
    """with e as (select vec_id, vec_id // 40 mb, vec_id % 2 rk, row_number() over (partition by vec_id // 40, vec_id % 2 order by vec_id) - 1 tok, count(*) over (partition by vec_id // 40, vec_id % 2) seq, abs(embedding[1] * 1000)::bigint % 2 a from embeddings),
p as (select *, row_number() over (partition by mb order by a, rk, tok) - 1 n from e)
select mb::integer microbatch_id, 0 dp_rank, rk * seq + tok token_index, 1001.0::double * n combined from p"""
)
def partial_sums_of_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """One expert-tensor-parallel group: both ranks hold partial sums of the same packed rows, and half of the sequence each."""
    topo = topology.Manifest(RUN, [(0, 1)], [(0,), (1,)], [(0,), (1,)], [(0,), (1,)], [(0,), (1,)], [(0, 1)], [(0,), (1,)], [(0,), (1,)], {0: 0}, [(0, 1)], 1, sequence_parallel=True)
    made = _token_routes_of_two(spark, folder)
    made = made.withColumn("ids", F.transform("a", lambda x: F.array(x))).withColumn("weights", F.transform("a", lambda _: F.array(F.lit(1.0)))).withColumn("n", 2 * F.size("a"))
    ordered = F.array_sort(F.transform("a", lambda x, i: F.struct(x.alias("e"), i.alias("i"))))
    made = cut(made.withColumn("map", F.transform(ordered, lambda x: x["i"])))
    rows = made.withColumn("rows", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array((i * F.when(F.col("rk") == 0, 1).otherwise(1000)).cast("double"))))
    ids, weights, maps, out = reconstruct.ACTS
    whole = dict(token_end=F.col("n"), dp_rank=0)
    each = dict(dp_rank=-1, sample_index=-1, token_start=-1, token_end=-1, dataset_id=-1)
    raw = _stored(made, ids, "torch.int64", "ids", 1, **whole).unionByName(_stored(made, weights, "torch.float64", "weights", 1, **whole))
    raw = raw.unionByName(_stored(made, maps, "torch.int64", "map", 0, **each)).unionByName(_stored(rows, out, "torch.float64", "rows", 1, **each))
    return _reconstructed(raw, _one_attempt(spark), topo)


def _token_routes_of_two(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 40").alias("mb"), (F.col("vec_id") % 2).cast("int").alias("rk"), F.expr("cast(round(abs(embedding[0] * 1000)) as bigint) % 2").cast("int").alias("a"))
    return e.groupBy("mb", "rk").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "a"))), lambda x: x["a"]).alias("a"))


# ---------------------------------------------------------------- packed and transposed payloads


def _square(column: str = "embedding") -> Column:
    """A vector as 8 places of 8 values."""
    return F.array(*[F.transform(F.slice(column, 8 * i + 1, 8), lambda x: x.cast("double")) for i in range(8)])


@query(
    """with x as (select vec_id, unnest(range(64)) j, unnest(embedding)::double v from embeddings), b as (select * from (values (0, 0, 2), (1, 2, 5), (2, 5, 5), (3, 5, 8)) t(n, a, b)),
m as (select vec_id, n, any_value(b.b - b.a) len, j % 8 e, sum(v) filter (j // 8 >= a and j // 8 < b.b) s from x cross join b group by 1, 2, 4)
select vec_id, n::integer segment, 3::integer active_count, list(round(coalesce(s, 0) / greatest(len, 1), 5) order by e) means from m group by 1, 2"""
)
def packed_segment_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vectors of the segments of a packed sequence, one of them empty."""
    ints = lambda *v: F.array(*map(F.lit, v))
    rows = read(spark, folder, "embeddings").select("vec_id", _square().alias("probs"), ints(0, 2, 5, 5).alias("starts"), ints(2, 5, 5, 8).alias("ends"))
    out = router.segment_means(rows).select("vec_id", "active_count", F.posexplode("segments").alias("segment", "m"))
    return out.select("vec_id", "segment", "active_count", F.transform("m", lambda v: F.round(v, 5)).alias("means"))


@query("""with x as (select vec_id, unnest(range(64)) j, unnest(embedding)::double v from embeddings)
select vec_id, (j % 8)::integer sample_index, list(round(v, 5) order by j) sequence from x group by 1, 2""")
def batch_major(spark: SparkSession, folder: str) -> DataFrame:
    """Captured [place][sample] payloads, one row per sample."""
    rows = router.to_batch_major(read(spark, folder, "embeddings").select("vec_id", _square().alias("sequence")), "sequence")
    return rows.select("vec_id", "sample_index", F.transform("sequence", lambda v: F.round(v, 5)).alias("sequence"))


# ---------------------------------------------------------------- boundaries, pairs, counts


@query(
    TELEMETRY_SQL
    + """, b as (select model_id, phase, min(global_batch_id) a, max(global_batch_id) b from cf where phase <> 'train' group by 1, 2),
t as (select model_id, phase, 'entry' boundary_type, a n from b union all select model_id, phase, 'exit', b + 1 from b)
select model_id, n training_iteration_id, phase, 0 eval_index, boundary_type, n next_global_batch_id from t where model_id = 'olm-aurora-8x' and phase = 'valid'"""
)
def eval_boundary_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Stored evaluation boundaries of one model and phase, in order."""
    found = transports.boundaries_of(bridge.clean_floats(spark, folder))
    stored = found.select("model_id", F.col("next_global_batch_id").alias("training_iteration_id"), "phase", F.lit(0).alias("eval_index"), "boundary_type", "next_global_batch_id")
    reader = records.TrainingReader({"raw_eval_phase_boundary": cut(transports.boundary_rows(cut(stored)))})
    return reader.eval_boundaries("olm-aurora-8x", phase="valid", eval_index=0)


@query(
    TELEMETRY_SQL
    + """, l as (select * from cf where act_name = 'lm_per_sample_loss'), c as (select * from ci where act_name = 'lm_per_sample_loss_token_count')
select l.model_id, l.global_batch_id, l.dp_rank, l.microbatch_id, l.sample_index, l.attempt_id, l.dataset_id, c.dataset_id count_dataset_id from l join c
  on l.model_id = c.model_id and l.phase = c.phase and l.global_batch_id = c.global_batch_id and l.dp_rank = c.dp_rank and l.microbatch_id = c.microbatch_id and l.sample_index = c.sample_index and l.attempt_id = c.attempt_id and l.invocation_id = c.invocation_id
where l.dataset_id is distinct from c.dataset_id"""
)
def dataset_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Samples whose loss and token count name different datasets."""
    losses = bridge.clean_floats(spark, folder).where(F.col("act_name") == scalars.LOSS)
    counts = bridge.clean_ints(spark, folder).where(F.col("act_name") == scalars.LOSS_TOKENS)
    out = scalars.dataset_mismatches(losses, counts)
    return out.select("model_id", "global_batch_id", "dp_rank", "microbatch_id", "sample_index", "attempt_id", "dataset_id", "count_dataset_id")


@query("select o_orderpriority, count(*) samples, round(count(*) / (sum(o_totalprice) / 1000), 6) samples_per_second, round(count(*) * 512 / (sum(o_totalprice) / 1000), 6) tokens_per_second from orders group by 1")
def throughputs(spark: SparkSession, folder: str) -> DataFrame:
    """Samples and tokens per second, orders as samples of 512 tokens and prices as milliseconds."""
    runs = read(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("samples"), (F.sum("o_totalprice") / 1000).alias("seconds"))
    out = logs.throughputs(runs, 512)
    return out.select("o_orderpriority", "samples", F.round("samples_per_second", 6).alias("samples_per_second"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query(
    """with s as (select n_nationkey k, n_nationkey + 10 i, n_nationkey % 4 + 1 b, n_regionkey + 1 l, n_nationkey % 3 + 2 v, n_nationkey % 2 + 1 e from nation)
select k::integer capture, unnest(['train', 'valid', 'test']) phase, unnest([i * b * l, (i // v + 1) * e * b * l, e * b * l])::bigint "rows" from s"""
)
def expected_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows captures of several settings should have."""
    n = F.col("n_nationkey").cast("bigint")
    settings = read(spark, folder, "nation").select(
        n.cast("int").alias("capture"), (n + 10).alias("train_iterations"), (n % 4 + 1).alias("global_batch"), (F.col("n_regionkey") + 1).cast("bigint").alias("layers"), (n % 3 + 2).alias("eval_interval"), (n % 2 + 1).alias("eval_iterations")
    )
    return transports.expected_row_table(settings, ["capture"])


@query(
    """with x as (select lower(trim(act_name)) act_name, record_kind, storage from act_catalog),
f as (select record_kind, unnest(case when record_kind <> 'sample' then []::varchar[] when storage = 'tensor' then ['dataset_id', 'valid_count'] else ['dataset_id'] end) field from x)
select k.record_kind, coalesce(list(distinct f.field order by f.field) filter (f.field is not null), []::varchar[]) fields from (select distinct record_kind from x) k left join f on f.record_kind = k.record_kind group by 1"""
)
def metadata_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What the encoders of each kind of record must be told, over all measures of the kind."""
    kind = F.col("record_kind")
    need = F.when(kind != "sample", F.array().cast("array<string>")).when(F.col("storage") == "tensor", F.array(F.lit("valid_count"), F.lit("dataset_id"))).otherwise(F.array(F.lit("dataset_id")))
    return captures.union_of_fields(read(spark, folder, "act_catalog").select(same_name("act_name").alias("act_name"), "record_kind", need.alias("fields")), ["record_kind"])


# ---------------------------------------------------------------- resume states and drawn samples


_WINDOWS_SQL = "with w as (select * exclude (n) from (select *, row_number() over (partition by run_id, window_id order by decision_id, len(dataset_index), dataset_index, counters_after) n from selection_windows) where n = 1)"


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per window."""
    w = read(spark, folder, "selection_windows").select("run_id", "window_id", "decision_id", F.size("dataset_index").alias("size"), "dataset_index", "counters_after", "dataset_sample_index", "first_training_iteration")
    first = F.min(F.struct("decision_id", "size", "dataset_index", "counters_after", "dataset_sample_index", "first_training_iteration"))
    return w.groupBy("run_id", "window_id").agg(first.alias("x")).select("run_id", "window_id", "x.*")


@query(_WINDOWS_SQL + " select run_id, window_id, sha256('[' || array_to_string(dataset_index, ',') || ']') drawn_sha256 from w")
def drawn_digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of the canonical JSON of each window's draws."""
    return _windows(spark, folder).select("run_id", "window_id", lineage.json_digest(F.col("dataset_index")).alias("drawn_sha256"))


@query(
    _WINDOWS_SQL
    + """, x as (select run_id, window_id iteration, unnest(case when window_id % 13 = 0 then ['dataset state hash'] else []::varchar[] end || case when window_id % 11 = 0 then ['controller state hash'] else []::varchar[] end
  || case when window_id % 17 = 0 then ['consumed samples'] else []::varchar[] end || case when window_id % 19 = 0 then ['not durable'] else []::varchar[] end || case when window_id % 7 = 0 then ['ranks differ'] else []::varchar[] end) fault from w)
select run_id, iteration, fault from x"""
)
def resume_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoint states that must not be resumed from, and why (windows as checkpoints of two ranks, some of them damaged)."""
    w, i = _windows(spark, folder), F.col("window_id")
    state, other = F.to_json(F.struct("counters_after")), F.to_json(F.struct("decision_id", "window_id"))
    broken = lambda bad, text: F.sha2(F.when(bad, F.concat(text, F.lit("x"))).otherwise(text), 256)
    states = w.select("run_id", i.alias("iteration"), F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"), state.alias("dataset_state"), broken(i % 13 == 0, state).alias("dataset_sha256"), other.alias("controller_state"), broken(i % 11 == 0, other).alias("controller_sha256"), (i * 16 + F.when(i % 17 == 0, 1).otherwise(0)).alias("consumed"), (i - F.when(i % 19 == 0, 1).otherwise(0)).alias("durable_through"))
    capture = F.when((F.col("iteration") % 7 == 0) & (F.col("rank") == 1), "b").otherwise("a")
    return lineage.resume_faults(states.withColumn("capture_sha256", capture), 16, ["run_id"])


@query(
    _WINDOWS_SQL
    + """, r as (select run_id from w group by 1 order by count(*) desc, 1 limit 1), p as (select unnest(range(4000)) index),
d as (select window_id, generate_subscripts(dataset_index, 1) - 1 pos, unnest(dataset_index) dataset_id, unnest(dataset_sample_index) sample from w where run_id = (select run_id from r))
select p.index, d.window_id, d.dataset_id, ((d.sample % (1000 + d.dataset_id)) + 1000 + d.dataset_id) % (1000 + d.dataset_id) record from p join d on d.window_id = p.index // 48 + 1 and d.pos = p.index % 48 where d.dataset_id between 0 and 5"""
)
def sample_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Which record of which dataset the first samples of a run's windows are."""
    w = _windows(spark, folder)
    run = w.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "run_id").limit(1).select("run_id")
    mine = w.join(F.broadcast(run), "run_id")
    out = loss_slope.sample_lookup(spark.range(4000).select(F.col("id").alias("index")), mine, 48, [1000 + d for d in range(6)], strict=False)
    return out.where("record is not null").select("index", "window_id", "dataset_id", "record")
