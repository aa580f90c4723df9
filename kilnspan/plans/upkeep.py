"""Queries about the tables' upkeep: orphan references, late events, repeated messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sql_name
from ..operators import lambda_views, orphans, seen


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.telemetry_orphans(*(_read(spark, folder, t) for t in ("raw_scalar_float", "raw_scalar_int", "act_catalog")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored row and reference that leads nowhere."""
    return _orphans(spark, folder).select("src_table", "row_id", "ref")


def p3_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Their number per table, kind, reason and UTC day of receipt."""
    return orphans.orphans_by_day(_orphans(spark, folder))


def p3_states(spark: SparkSession, folder: str) -> DataFrame:
    """References by what they lead to at their own time, per table and UTC day of receipt."""
    return orphans.reference_states(*(_read(spark, folder, t) for t in ("raw_scalar_float", "raw_scalar_int", "act_catalog")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the view dropped at intake, and rows with which it corrected a period that had ended: both layers take the whole table."""
    rows = _read(spark, folder, "loss_slope_iteration_metrics")
    view = lambda_views.LambdaView(spark)
    view.take(rows, 0)
    view.recompute(rows.agg(F.max("received_at_unix_ns")).first()[0] or 0)
    return view.outcomes()


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """COMPLETE and INCOMPLETE rows per run and UTC hour, by the batch layer over the whole log."""
    return lambda_views.recount(_read(spark, folder, "loss_slope_iteration_metrics"))


def _three_batches(spark: SparkSession, folder: str) -> lambda_views.LambdaView:
    """Both layers after the rows came in three batches by receipt, with a recompute after the second."""
    rows = _read(spark, folder, "loss_slope_iteration_metrics")
    first, last = rows.where("received_at_unix_ns > 0").agg(F.min("received_at_unix_ns"), F.max("received_at_unix_ns")).first()
    first, last = first or 0, last or 0
    a, b = first + (last - first) // 5 * 2, first + (last - first) // 5 * 4
    view = lambda_views.LambdaView(spark)
    got = F.coalesce("received_at_unix_ns", F.lit(0))
    view.take(rows.where(got <= a), 0)
    view.take(rows.where((got > a) & (got <= b)), 1)
    view.recompute(b)
    view.take(rows.where(got > b), 2)
    return view


def p4_provisional(spark: SparkSession, folder: str) -> DataFrame:
    """The counts served between the last batch and its recompute: the batch layer of two batches and the third's increments."""
    return _three_batches(spark, folder).serve()


def p4_served(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts after the rows came in three batches by receipt, with a recompute after the second and the last."""
    view = _three_batches(spark, folder)
    view.recompute((1 << 62))
    return view.serve()


def p5_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of every message, of three batches that a store of seen-bitmaps takes one after another, by thirds of the delivery batches."""
    rows = _read(spark, folder, "raw_scalar_float")
    first, last = rows.agg(F.min("batch_no"), F.max("batch_no")).first()
    first, last = first or 0, last or 0
    third = F.least(F.lit(2), F.floor((F.coalesce("batch_no", F.lit(first)) - first) * 3 / F.lit(last - first + 1))).cast("int")
    store = seen.SeenStore(spark)
    kept = [store.take(seen.message_rows(rows.where(third == n)), n) for n in range(3)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every row but the first of its message."""
    return seen.repeats(seen.message_rows(_read(spark, folder, "raw_scalar_float")))


QUERIES = {f.__name__: f for f in (p3_found, p3_by_day, p3_states, p4_found, p4_counts, p4_provisional, p4_served, p5_found, p5_batches)}

_P3 = f"""
with allrows as (
  select 'raw_scalar_float' src_table, row_id, model_id, act_name, direction, phase, global_batch_id, attempt_id, received_unix_ns from raw_scalar_float
  union all select 'raw_scalar_int', row_id, model_id, act_name, direction, phase, global_batch_id, attempt_id, received_unix_ns from raw_scalar_int),
named as (select *, {sql_name('model_id')} model, {sql_name('act_name')} nm from allrows),
status as (
  select {sql_name('model_id')} model, global_batch_id, attempt_id, bool_or(deleted_unix_ns is null) live from raw_scalar_int
  where {sql_name('act_name')} = 'iteration_attempt_status' and direction = 'iter' and phase = 'train' and invocation_id = 0 and dataset_id = -1 group by 1, 2, 3),
names as (select {sql_name('act_name')} nm, max(coalesce(removed_unix_ns, 9223372036854775807)) until from act_catalog group by 1),
found as (
  select src_table, row_id, 'attempt' ref, case when s.live is null then 'missing' else 'deleted' end reason, received_unix_ns
  from named n left join status s on n.model = s.model and n.global_batch_id = s.global_batch_id and n.attempt_id = s.attempt_id
  where phase = 'train' and n.global_batch_id is distinct from 0 and n.attempt_id is not null and nm is distinct from 'iteration_attempt_status' and not coalesce(s.live, false)
  union all
  select src_table, row_id, 'act_name', case when c.until is null then 'missing' else 'deleted' end, received_unix_ns
  from named n left join names c on n.nm = c.nm where c.until is null or received_unix_ns >= c.until)
"""
P3_FOUND = _P3 + "select src_table, row_id, ref from found"
P3_BY_DAY = _P3 + """
select src_table, ref, reason, cast(date '1970-01-01' + cast(received_unix_ns // 86400000000000 as integer) as date) "day", count(*) "references"
from found group by all"""

P3_STATES = f"""
with allrows as (
  select 'raw_scalar_float' src_table, model_id, act_name, phase, global_batch_id, attempt_id, received_unix_ns t from raw_scalar_float
  union all select 'raw_scalar_int', model_id, act_name, phase, global_batch_id, attempt_id, received_unix_ns from raw_scalar_int),
named as (select *, {sql_name('model_id')} model, {sql_name('act_name')} nm from allrows),
status as (
  select {sql_name('model_id')} model, global_batch_id, attempt_id, bool_or(deleted_unix_ns is null) live,
    min(case when deleted_unix_ns is null then coalesce(received_unix_ns, -9223372036854775807) end) since from raw_scalar_int
  where {sql_name('act_name')} = 'iteration_attempt_status' and direction = 'iter' and phase = 'train' and invocation_id = 0 and dataset_id = -1 group by 1, 2, 3),
names as (select {sql_name('act_name')} nm, coalesce(added_unix_ns, -9223372036854775807) since, coalesce(removed_unix_ns, 9223372036854775807) until from act_catalog),
told as (
  select src_table, 'attempt' ref, t, concat_ws('/', n.model, n.global_batch_id, n.attempt_id) k,
    case when s.live is null then 'missing' when not s.live then 'deleted' when t < s.since then 'late' else 'met' end state
  from named n left join status s on n.model = s.model and n.global_batch_id = s.global_batch_id and n.attempt_id = s.attempt_id
  where phase = 'train' and n.global_batch_id is distinct from 0 and n.attempt_id is not null and nm is distinct from 'iteration_attempt_status'
  union all
  select src_table, 'act_name', t, n.nm,
    case when c.u is null then 'missing' when t >= c.u then 'deleted' when t is null or exists (select 1 from names x where x.nm = n.nm and x.since <= t and t < x.until) then 'met' else 'late' end
  from named n left join (select nm, max(until) u from names group by 1) c on n.nm = c.nm)
select src_table, ref, state, cast(date '1970-01-01' + cast(t // 86400000000000 as integer) as date) "day", count(distinct coalesce(k, '')) "keys", count(*)::bigint "references"
from told group by 1, 2, 3, 4"""

_P4 = """
with timed as (
  select *, case when processed_at_unix_ns > 0 then processed_at_unix_ns::hugeint *
    case when processed_at_unix_ns < 100000000000 then 1000000000 when processed_at_unix_ns < 100000000000000 then 1000000
         when processed_at_unix_ns < 100000000000000000 then 1000 else 1 end end ev
  from loss_slope_iteration_metrics),
judged as (
  select *, ev - ev % 3600000000000 hr,
    case when ev is null then null when received_at_unix_ns - ev > 21600000000000 then 'dropped'
         when received_at_unix_ns >= ev - ev % 3600000000000 + 3600000000000 then 'correcting' else 'on_time' end verdict
  from timed)
"""
P4_FOUND = _P4 + "select row_id, verdict outcome from judged where verdict in ('dropped', 'correcting')"
P4_COUNTS = _P4 + f""",
last as (
  select *, row_number() over (partition by run_id, dataset_id, training_iteration_id order by received_at_unix_ns desc nulls last, row_id desc) n
  from judged where verdict in ('on_time', 'correcting'))
select run_id, hr::bigint period_start_ns, count(*) filter (st = 'complete') complete, count(*) filter (st = 'incomplete') incomplete
from (select *, {sql_name('status')} st from last where n = 1) where st in ('complete', 'incomplete') group by 1, 2"""

P4_PROVISIONAL = _P4 + f""",
bounds as (select min(received_at_unix_ns) f, max(received_at_unix_ns) l from loss_slope_iteration_metrics where received_at_unix_ns > 0),
parted as (select j.*, coalesce(received_at_unix_ns, 0) > f + (l - f) // 5 * 4 late from judged j, bounds where verdict in ('on_time', 'correcting')),
last as (
  select *, row_number() over (partition by late, run_id, dataset_id, training_iteration_id order by received_at_unix_ns desc nulls last, row_id desc) n from parted)
select run_id, hr::bigint period_start_ns, count(*) filter (st = 'complete') complete, count(*) filter (st = 'incomplete') incomplete
from (select *, {sql_name('status')} st from last where n = 1) where st in ('complete', 'incomplete') group by 1, 2"""

P5_BATCHES = f"""
with bounds as (select min(batch_no) f, max(batch_no) l from raw_scalar_float),
parted as (select r.*, least(2, floor((coalesce(batch_no, f) - f) * 3 / (l - f + 1))) part from raw_scalar_float r, bounds)
select row_id from (
  select row_id, row_number() over (
    partition by {sql_name('model_id')}, {sql_name('act_name')}, direction, phase, global_batch_id, dp_rank, coalesce(microbatch_id, -1), sample_index,
      layer_no, shard_rank, token_start, token_end, attempt_id, invocation_id order by part, row_id nulls last) n
  from parted) where n = 1"""

P5_FOUND = f"""
select row_id from (
  select row_id, row_number() over (
    partition by {sql_name('model_id')}, {sql_name('act_name')}, direction, phase, global_batch_id, dp_rank, coalesce(microbatch_id, -1), sample_index,
      layer_no, shard_rank, token_start, token_end, attempt_id, invocation_id order by row_id nulls last) n
  from raw_scalar_float) where n > 1"""

SQL = {"p3_found": P3_FOUND, "p3_by_day": P3_BY_DAY, "p3_states": P3_STATES, "p4_found": P4_FOUND, "p4_counts": P4_COUNTS, "p4_provisional": P4_PROVISIONAL, "p4_served": P4_COUNTS, "p5_found": P5_FOUND, "p5_batches": P5_BATCHES}
