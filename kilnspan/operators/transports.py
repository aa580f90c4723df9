"""From captured payloads to rows: per-sample encodings, packed transports, invocation numbers, boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import require
from ..schema import PHASES


def invocation_ids(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Number of earlier rows with the same key within the attempt."""
    return rows.withColumn("invocation_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*arrival)) - 1)


def identity_rows(payloads: DataFrame, values: str = "values") -> DataFrame:
    """One row per sample of an [sample][...] payload: the token range from each sample's valid count, its own dataset.

    Expects token_start, valid (array), datasets (array, or null for dataset 0).
    """
    others = [c for c in payloads.columns if c not in (values, "valid", "datasets", "token_start")]
    zipped = F.arrays_zip(F.col(values).alias("v"), F.col("valid").alias("n"), F.coalesce("datasets", F.array_repeat(F.lit(0), F.size("valid"))).alias("d"))
    long = payloads.select(*others, "token_start", F.posexplode(zipped).alias("sample_index", "x"))
    return long.select(*others, "sample_index", "token_start", (F.col("token_start") + F.col("x.n")).alias("token_end"), F.col("x.d").alias("dataset_id"), F.col("x.v").alias(values))


def prefix_strip(payloads: DataFrame, values: str = "values", active: str = "active_count") -> DataFrame:
    """Only the first ``active`` entries of a fixed-capacity payload are samples; the rest are padding."""
    kept = {c: F.slice(c, F.lit(1), F.col(active)) for c in (values, "valid", "datasets") if c in payloads.columns}
    return identity_rows(payloads.withColumns(kept).drop(active), values)


def packed_offsets(samples: DataFrame, by: Sequence[str], order: str = "sample_index", count: str = "valid_count") -> DataFrame:
    """Add ``offset`` (tokens packed before) and ``active_index`` (nonempty samples before) in a packed payload."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("offset", F.coalesce(F.sum(count).over(before), F.lit(0))).withColumn("active_index", F.coalesce(F.sum((F.col(count) > 0).cast("int")).over(before), F.lit(0)))


def seq_prefix_pack(values: Column, valid: Column) -> Column:
    """[seq][batch] values to one packed list: each sample's valid prefix, sample after sample."""
    take = lambda b, n: F.transform(F.slice(values, F.lit(1), n), lambda row: F.get(row, b))
    return F.flatten(F.transform(valid, lambda n, b: take(b, n)))


def seq_prefix_unpack(packed: Column, valid: Column) -> Column:
    """The packed list as one list per sample; its length must be the sum of the valid counts."""
    total = F.aggregate(valid, F.lit(0), lambda a, n: a + n)
    starts = F.transform(valid, lambda n, i: F.aggregate(F.slice(valid, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    parts = F.zip_with(starts, valid, lambda s, n: F.slice(packed, s + 1, n))
    return F.when(F.size(packed) == total, parts).otherwise(F.raise_error("packed length"))


def segmented_pack(values: Column, starts: Column, ends: Column) -> Column:
    """A packed sequence's nonempty segments [start, end), one after another."""
    bounds = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: x["b"] > x["a"])
    return F.flatten(F.transform(bounds, lambda x: F.slice(values, x["a"] + 1, x["b"] - x["a"])))


def segmented_rows(payloads: DataFrame, values: str = "values", starts: str = "starts", ends: str = "ends") -> DataFrame:
    """One row per nonempty segment of a packed sequence: sample_index counts the nonempty ones."""
    others = [c for c in payloads.columns if c not in (values, starts, ends, "datasets")]
    zipped = F.filter(F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b"), F.col("datasets").alias("d")), lambda x: x["b"] > x["a"])
    long = payloads.select(*others, values, F.posexplode(zipped).alias("sample_index", "x"))
    return long.select(*others, "sample_index", F.col("x.a").cast("bigint").alias("token_start"), F.col("x.b").cast("bigint").alias("token_end"), F.col("x.d").alias("dataset_id"), F.slice(values, F.col("x.a") + 1, F.col("x.b") - F.col("x.a")).alias(values))


def boundary_rows(rows: DataFrame) -> DataFrame:
    """Evaluation boundaries, if all are in order."""
    rules = {
        "phase is train or unknown": F.col("phase").isin(*PHASES) & (F.col("phase") != "train"),
        "boundary type": F.col("boundary_type").isin("entry", "exit"),
        "negative coordinates": (F.col("training_iteration_id") >= 0) & (F.col("eval_index") >= 0) & (F.col("next_global_batch_id") >= 1),
    }
    return require(rows, rules, "eval boundaries")


def boundaries_of(rows: DataFrame) -> DataFrame:
    """Entry and exit of each evaluation phase, as its payload rows imply them: first batch, and the one after the last."""
    spans = rows.where("phase <> 'train'").groupBy("model_id", "phase").agg(F.min("global_batch_id").alias("a"), F.max("global_batch_id").alias("b"))
    kinds = F.array(F.struct(F.lit("entry").alias("t"), F.col("a").alias("n")), F.struct(F.lit("exit").alias("t"), (F.col("b") + 1).alias("n")))
    return spans.select("model_id", "phase", F.inline(kinds).alias("boundary_type", "next_global_batch_id"))


def expected_row_table(settings: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, phase, rows): the same for a table of captures' settings."""
    per = F.col("global_batch") * F.col("layers")
    rounds = F.expr("train_iterations div eval_interval") + 1
    rows = {"train": F.col("train_iterations") * per, "valid": rounds * F.col("eval_iterations") * per, "test": F.col("eval_iterations") * per}
    return settings.select(*by, F.inline(F.array(*[F.struct(F.lit(p).alias("phase"), n.cast("bigint").alias("rows")) for p, n in rows.items()])))


def expected_rows(train_iterations: int, global_batch: int, layers: int, eval_interval: int, eval_iterations: int) -> dict[str, int]:
    """Rows of a per-layer, per-sample capture in each phase."""
    per = global_batch * layers
    return {"train": train_iterations * per, "valid": (train_iterations // eval_interval + 1) * eval_iterations * per, "test": eval_iterations * per}
