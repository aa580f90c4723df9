"""DuckDB SQL that states the same results, for the queries that SQL can express."""

P1_FOUND = """
with src as (select dataset_id, min(record_count) rc, min(max_repeats) mr from mixture_sources where dataset_id is not null group by 1),
ids as (select dataset_id, row_number() over (order by dataset_id) i from src),
wins as (select row_number() over () wid, * from (
  select distinct run_id, window_id, decision_id, weights, dataset_index, dataset_sample_index from selection_windows)),
dec as (select run_id, decision_id, arg_max(weights, coalesce(produced_at_unix_ns, 0)) weights from loss_slope_mixture_decisions group by 1, 2),
judged as (
  select w.wid, w.run_id, w.window_id,
    case when len(w.weights) = (select count(*) from src) and len(list_filter(w.weights, lambda x: x is null or not isfinite(x) or x < 0)) = 0 then w.weights
         when len(d.weights) = (select count(*) from src) and len(list_filter(d.weights, lambda x: x is null or not isfinite(x) or x < 0)) = 0 then d.weights end held
  from wins w left join dec d on w.run_id = d.run_id and w.decision_id = d.decision_id),
drawn as (
  select p.wid, p.dataset_id, case when s.rc > 0 then ((p.sample % s.rc) + s.rc) % s.rc end rec, s.mr
  from (select wid, unnest(dataset_index) dataset_id, unnest(dataset_sample_index) sample from wins) p join src s using (dataset_id)),
total as (select wid, count(*) n from drawn group by 1),
per as (select wid, dataset_id, count(*) c from drawn group by 1, 2),
shares as (
  select j.wid, j.run_id, j.window_id, ids.dataset_id
  from judged j join total t using (wid) cross join ids left join per p on p.wid = j.wid and p.dataset_id = ids.dataset_id
  where j.held is not null and list_sum(j.held) > 0
    and abs(coalesce(p.c, 0)::double / t.n::double - j.held[ids.i] / list_sum(j.held)) > 0.05),
reps as (select wid, dataset_id from drawn where rec is not null group by wid, dataset_id, rec, mr having count(*) > mr)
select distinct run_id, window_id, dataset_id, 'share' fault from shares
union all
select distinct j.run_id, j.window_id, r.dataset_id, 'repeats' fault from reps r join judged j using (wid)
"""

P2_PERCENTILES = """
with long as (
  select global_moe_layer, report_day, unnest([
    {'metric': 'top_route_alignment_q1', 'v': top_route_alignment_q1},
    {'metric': 'top_route_alignment_median', 'v': top_route_alignment_median},
    {'metric': 'top_route_alignment_q3', 'v': top_route_alignment_q3}], recursive := true)
  from expert_contribution),
ok as (select * from long where v between -1 and 1),
scoped as (select global_moe_layer, report_day, false all_parts, metric, v from ok
  union all select global_moe_layer, null, true, metric, v from ok),
ranked as (select *, row_number() over g r, count(*) over (partition by global_moe_layer, report_day, all_parts, metric) n
  from scoped window g as (partition by global_moe_layer, report_day, all_parts, metric order by v))
select global_moe_layer, report_day, all_parts, metric, n, 0::integer rank_error,
  max(case when r = (25 * n + 99) // 100 then v end) p25, max(case when r = (50 * n + 99) // 100 then v end) p50,
  max(case when r = (75 * n + 99) // 100 then v end) p75, max(case when r = (99 * n + 99) // 100 then v end) p99
from ranked group by all
"""

P2_COMBINED = """
with long as (
  select global_moe_layer, report_day, unnest([
    {'metric': 'top_route_alignment_q1', 'v': top_route_alignment_q1},
    {'metric': 'top_route_alignment_median', 'v': top_route_alignment_median},
    {'metric': 'top_route_alignment_q3', 'v': top_route_alignment_q3}], recursive := true)
  from expert_contribution),
ranked as (select *, row_number() over g r, count(*) over (partition by global_moe_layer, report_day, metric) n
  from long where v between -1 and 1 window g as (partition by global_moe_layer, report_day, metric order by v)),
days as (select distinct global_moe_layer, report_day, metric, n from ranked),
points as (select *, (i * n + 63) // 64 k, (i * n + 63) // 64 - ((i - 1) * n + 63) // 64 w from (select *, unnest(range(1, 65)) i from days)),
picked as (select p.global_moe_layer, p.metric, p.w, r.v from points p join ranked r
  on p.global_moe_layer is not distinct from r.global_moe_layer and p.report_day is not distinct from r.report_day and p.metric = r.metric and r.r = greatest(1, p.k)),
total as (select global_moe_layer, metric, sum(n)::bigint n, sum((n + 63) // 64 + 1)::bigint rank_error from days group by 1, 2),
run as (select global_moe_layer, metric, v, sum(sum(w)) over (partition by global_moe_layer, metric order by v) upto from picked group by 1, 2, 3)
select t.global_moe_layer, t.metric, n, rank_error,
  min(case when upto >= (25 * n + 99) // 100 then v end) p25, min(case when upto >= (50 * n + 99) // 100 then v end) p50,
  min(case when upto >= (75 * n + 99) // 100 then v end) p75, min(case when upto >= (99 * n + 99) // 100 then v end) p99
from total t join run r on t.global_moe_layer is not distinct from r.global_moe_layer and t.metric = r.metric group by all
"""

P1_TARGETS = """
with src as (select dataset_id, min(max_repeats) mr from mixture_sources where dataset_id is not null group by 1),
ids as (select *, row_number() over (order by dataset_id) i from src),
fit as (select run_id, effective_training_iteration a, arg_max(weights, (produced_at_unix_ns, decision_id)) w from loss_slope_mixture_decisions
  where effective_training_iteration is not null and len(weights) = (select count(*) from src) and len(list_filter(weights, lambda x: x is null or not isfinite(x) or x < 0)) = 0 group by 1, 2),
span as (select a, coalesce(lead(a) over o, a + coalesce(a - lag(a) over o, 1)) b, w from fit window o as (partition by run_id order by a)),
held as (select a, b, list_transform(w, lambda x: x / list_sum(w)) w from span where list_sum(w) > 0),
turn as (select distinct t from (select a t from held union all select b from held)),
part as (select * from (select t, lead(t) over (order by t) u from turn) where u is not null),
mean as (select ids.i, sum(w[ids.i] * (b - a)) / sum(b - a) m from held, ids group by 1),
rate as (select part.t, part.u, ids.i, coalesce(avg(held.w[ids.i]), any_value(mean.m)) r
  from part cross join ids join mean on mean.i = ids.i left join held on held.a <= part.t and part.u <= held.b group by 1, 2, 3),
share as (select i, sum(r * (u - t)) / (select max(t) - min(t) from turn) s from rate group by 1)
select ids.dataset_id, round(s, 6) target_share, coalesce(sum(target_token_count) filter (target_token_count > 0), 0)::bigint pool_tokens, true within_cap, true as_wanted
from ids join share on share.i = ids.i left join loss_slope_iteration_metrics m on m.dataset_id = ids.dataset_id group by 1, s
"""

P7_CHARS = """
with t as (select source, doc_id, length(text) n from documents where text is not null and text <> ''),
c as (select source, min(capacity) capacity from pack_containers group by 1)
select t.source, count(*) documents, sum(n)::bigint chars, ceil(sum(n) / any_value(c.capacity))::bigint fewest_containers, true none_overflows, true none_split, true few_used
from t left join c on c.source = t.source group by 1
"""

SQL = {"p1_found": P1_FOUND, "p1_targets": P1_TARGETS, "p2_percentiles": P2_PERCENTILES, "p2_combined": P2_COMBINED, "p7_chars": P7_CHARS}
