"""Telemetry-shaped inputs made of the stored tables, in Spark and (``*_SQL``) in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import softmax
from ..functions.names import same_name, sql_name
from ..operators.segments import chat_turns
from ..schema import KEY


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _clean(df: DataFrame) -> DataFrame:
    """Names in comparable form, each message once (its first row), rows of unknown attempt set aside."""
    fixed = {"model_id": same_name("model_id"), "act_name": same_name("act_name"), "microbatch_id": F.coalesce("microbatch_id", F.lit(-1))}
    first = df.withColumns(fixed).where("attempt_id is not null").groupBy(*KEY).agg(F.min_by(F.struct("dataset_id", "value", "row_id", "received_unix_ns"), "row_id").alias("x"))
    return first.select(*KEY, "x.*")


def clean_floats(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(read(spark, folder, "raw_scalar_float"))


def clean_ints(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(read(spark, folder, "raw_scalar_int").where("deleted_unix_ns is null"))


def status(spark: SparkSession, folder: str) -> DataFrame:
    """Status rows with the identity that they must have."""
    from ..operators.attempts import status_rows, status_rules

    rows = status_rows(clean_ints(spark, folder))
    for rule in status_rules().values():
        rows = rows.where(rule)
    return rows


_KEYS = ", ".join(KEY)


def _clean_sql(table: str, where: str = "") -> str:
    return f"""(select * exclude (n) from (
  select *, row_number() over (partition by {_KEYS} order by row_id) n from (
    select row_id, {sql_name('model_id')} model_id, {sql_name('act_name')} act_name, direction, phase, global_batch_id, dp_rank, coalesce(microbatch_id, -1) microbatch_id,
      sample_index, layer_no, shard_rank, token_start, token_end, attempt_id, invocation_id, dataset_id, value, received_unix_ns
    from {table} where attempt_id is not null {where})) where n = 1)"""


TELEMETRY_SQL = f"""
with cf as {_clean_sql('raw_scalar_float')},
ci as {_clean_sql('raw_scalar_int', 'and deleted_unix_ns is null')},
st as (select * from ci where act_name = 'iteration_attempt_status' and direction = 'iter' and phase = 'train' and value in (-1, 0, 1) and dp_rank = -1 and microbatch_id = -1
  and sample_index = -1 and layer_no = -1 and shard_rank = -1 and token_start = 0 and token_end = 1 and invocation_id = 0 and dataset_id = -1),
res as (select model_id, global_batch_id, max(case when value = 1 then attempt_id end) accepted_attempt, count(*) filter (value = 1) accepted_count,
  count(*) filter (value = -1) aborted_count, count(*) attempt_count from st group by 1, 2),
acc as (select model_id, global_batch_id, accepted_attempt attempt_id from res where accepted_count = 1),
vis as (select * from cf where invocation_id = 0 and (phase <> 'train' or global_batch_id = 0 or (model_id, global_batch_id, attempt_id) in (select * from acc))),
visi as (select * from ci where invocation_id = 0 and (phase <> 'train' or global_batch_id = 0 or (model_id, global_batch_id, attempt_id) in (select * from acc)))
"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Loss samples out of the event stream: one iteration a day, four datasets (one of them misses day 7)."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    e = read(spark, folder, "events").select(day.cast("bigint").alias("day"), "event_id", (F.col("user_id") % 4).cast("int").alias("dataset_id"), F.col("value").alias("loss"), (F.col("event_id") % 7).alias("tokens"))
    first = e.agg(F.min("day").alias("d0"))
    e = e.crossJoin(F.broadcast(first)).withColumn("training_iteration_id", F.col("day") - F.col("d0") + 1)
    return e.where("not (training_iteration_id = 7 and dataset_id = 2)").select(F.lit("run").alias("run_id"), "training_iteration_id", "dataset_id", "event_id", "loss", "tokens")


SAMPLES_SQL = """
with smp as (select 'run' run_id, it training_iteration_id, dataset_id, event_id, loss, tokens from (
  select (ts::date - (select min(ts::date) from events))::bigint + 1 it, (user_id % 4)::integer dataset_id, event_id, value loss, event_id % 7 tokens from events)
  where not (it = 7 and dataset_id = 2))
"""


def expert_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Expert counts before and after drops, out of line items: a month is an iteration, a line number a layer."""
    rows = read(spark, folder, "lineitem").select(
        F.lit("run").alias("model_id"), F.lit("train").alias("phase"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("global_batch_id"),
        F.col("l_linenumber").alias("layer_no"), (F.col("l_suppkey") % 16).cast("int").alias("expert_id"), (F.col("l_returnflag") != "R").alias("kept"),
    )
    counts = rows.groupBy("model_id", "phase", "global_batch_id", "layer_no", "expert_id").agg(F.count(F.lit(1)).alias("pre"), F.count_if("kept").alias("post"))
    keep = ["model_id", "phase", "global_batch_id", "layer_no", "expert_id"]
    return counts.select(*keep, F.col("pre").alias("token_count")), counts.select(*keep, F.col("post").alias("token_count"))


LOAD_SQL = """
with base as (select year(l_shipdate) * 12 + month(l_shipdate) global_batch_id, l_linenumber layer_no, (l_suppkey % 16)::integer expert_id,
  count(*) pre, count(*) filter (l_returnflag <> 'R') post from lineitem group by 1, 2, 3),
load as (select 'run' model_id, 'train' phase, global_batch_id, layer_no, expert_id, unnest(['pre_drop', 'post_drop', 'dropped']) load_kind, unnest([pre, post, pre - post]) token_count from base)
"""


def router_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Router logits out of embeddings: 20 vectors an iteration, the first 16 values over as many experts; probabilities in 1024ths."""
    logits = F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double") * 4.0)
    e = read(spark, folder, "embeddings").select("vec_id", F.expr("vec_id div 20").alias("global_batch_id"), (F.col("label") % 3).cast("int").alias("dataset_id"), logits.alias("logits"))
    return e.withColumn("probs", F.transform(softmax(F.col("logits")), lambda p: (F.floor(p * 1024) / 1024).cast("float")))


VECTORS_SQL = """
with vx as (select vec_id, vec_id // 20 global_batch_id, (label % 3)::integer dataset_id, unnest(range(16)) i, unnest(list_transform(embedding[1:16], lambda x: x::double * 4.0)) l from embeddings),
vm as (select *, exp(l - max(l) over (partition by vec_id)) e from vx),
vp as (select *, e / sum(e) over (partition by vec_id) p from vm),
vr as (select *, floor(p * 1024) / 1024 q from vp),
vs as (select *, sum(q) over (partition by vec_id order by q desc, i rows unbounded preceding) c, row_number() over (partition by vec_id order by q desc, i) rk from vr),
vk as (select vec_id, greatest(1, least(16, 1 + count(*) filter (c < 0.5))) k from vs group by 1),
pw as (select vec_id, global_batch_id, dataset_id, list(i order by rk) filter (rk <= k) tokens, string_agg(chr((97 + i)::integer), '' order by rk) filter (rk <= k) word
  from vs join vk using (vec_id) group by 1, 2, 3)
"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Chat turns out of the documents of that source."""
    return chat_turns(read(spark, folder, "documents").where("source = 'chat_turns' and text is not null"))


TURNS_SQL = """
with ln as (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) - 1 turn from documents where source = 'chat_turns' and text is not null),
tn as (select doc_id, turn::integer turn, regexp_extract(l, '^(system|user|assistant): ', 1) "role", l from ln where regexp_matches(l, '^(system|user|assistant): '))
"""
