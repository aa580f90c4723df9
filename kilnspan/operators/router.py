"""Capture-side reductions over logits, losses and routing maps, in long form.

Matrices are arrays of arrays per row (sequence x batch x features as captured), or long
rows with their positions; every reduction is a group-by with partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_sum, entropy, sigmoid_shares, softmax


def valid_prefix(values: Column, valid: Column) -> Column:
    """The first ``valid`` elements."""
    return F.slice(values, F.lit(1), F.greatest(valid, F.lit(0)))


def route_probs(logits: Column, score: str = "softmax") -> Column:
    """Routing probabilities of one token."""
    if score not in ("softmax", "sigmoid"):
        raise ValueError(f"unknown score function {score!r}")
    return softmax(logits) if score == "softmax" else sigmoid_shares(logits)


def to_batch_major(rows: DataFrame, values: str) -> DataFrame:
    """[sequence][batch] arrays to one row per (row, sample) with [sequence]: the captured layout transposed."""
    others = [c for c in rows.columns if c != values]
    one = F.sequence(F.lit(0), F.size(F.element_at(values, 1)) - 1)
    samples = F.transform(one, lambda b: F.struct(b.alias("sample_index"), F.transform(F.col(values), lambda s: F.get(s, b)).alias(values)))
    return rows.where(F.size(values) > 0).select(*others, F.inline(samples))


def mean_probs(tokens: DataFrame, by: Sequence[str], seq: str = "seq", valid: str = "valid_count", logits: str = "logits", score: str = "softmax") -> DataFrame:
    """(by, expert_id, prob): mean probabilities over each sample's valid prefix; 0 where nothing is valid."""
    probs = tokens.select(*by, (F.col(seq) < F.col(valid)).alias("ok"), F.posexplode(route_probs(F.col(logits), score)).alias("expert_id", "p"))
    sums = probs.groupBy(*by, "expert_id").agg(F.sum(F.when(F.col("ok"), F.col("p")).otherwise(0.0)).alias("s"), F.count_if("ok").alias("n"))
    return sums.select(*by, "expert_id", (F.col("s") / F.greatest("n", F.lit(1))).alias("prob"))


def segment_means(packed: DataFrame, starts: str = "starts", ends: str = "ends", values: str = "probs") -> DataFrame:
    """Means of packed [token][expert] rows per segment [start, end); empty segments give zeros.

    Adds ``segments``: array of arrays, and ``active_count``: the segments that are not empty.
    """
    width = F.size(F.element_at(values, 1))
    bounds = F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b"))
    part = lambda x: F.slice(values, x["a"] + 1, F.greatest(x["b"] - x["a"], F.lit(0)))
    mean = lambda x: F.transform(F.sequence(F.lit(0), width - 1), lambda e: array_sum(F.transform(part(x), lambda r: F.get(r, e).cast("double"))) / F.greatest(x["b"] - x["a"], F.lit(1)))
    return packed.withColumn("segments", F.transform(bounds, mean)).withColumn("active_count", F.size(F.filter(bounds, lambda x: x["b"] > x["a"])))


def mean_entropy(tokens: DataFrame, by: Sequence[str], seq: str = "seq", valid: str = "valid_count", logits: str = "logits", score: str = "softmax") -> DataFrame:
    """(by, entropy_mean): mean token entropy over the valid prefix, 0 where nothing is valid."""
    ok = F.col(seq) < F.col(valid)
    out = tokens.groupBy(*by).agg(F.sum(F.when(ok, entropy(route_probs(F.col(logits), score))).otherwise(0.0)).alias("s"), F.count_if(ok).alias("n"))
    return out.select(*by, (F.col("s") / F.greatest("n", F.lit(1))).alias("entropy_mean"))


def routed_counts(routes: DataFrame, by: Sequence[str], batch: int, experts: int, row: str = "row", valid: str = "valid", map_column: str = "routed") -> DataFrame:
    """(by, sample_index, expert_id, token_count) from rows of a [seq x batch, expert] routing map; row i belongs to sample i % batch.

    ``valid`` is an array with each sample's valid count.  All experts come out, also with 0.
    """
    flags = routes.select(*by, (F.col(row) % batch).alias("sample_index"), F.expr(f"{row} div {batch}").alias("seq"), valid, F.posexplode(map_column).alias("expert_id", "hit"))
    counted = flags.where(F.col("expert_id") < experts).groupBy(*by, "sample_index", "expert_id")
    use = (F.col("seq") < F.get(valid, F.col("sample_index").cast("int"))) & F.col("hit").cast("boolean")
    return counted.agg(F.count_if(use).alias("token_count"))


def sample_losses(rows: DataFrame, losses: str = "losses", mask: str = "mask") -> DataFrame:
    """Add ``loss`` (mask-weighted mean, denominator at least 1) and ``token_count`` to rows that hold a sample's losses."""
    total = array_sum(F.zip_with(losses, mask, lambda x, m: x.cast("double") * m.cast("double")))
    count = array_sum(F.transform(mask, lambda m: m.cast("double")))
    return rows.withColumn("loss", total / F.greatest(count, F.lit(1.0))).withColumn("token_count", count.cast("bigint"))


def segment_losses(rows: DataFrame, losses: str = "losses", mask: str = "mask", starts: str = "starts", ends: str = "ends") -> DataFrame:
    """Add ``segments`` (loss, token_count per segment) and ``active_count`` to rows that hold a packed sequence."""
    bounds = F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b"))
    cut = lambda c, x: F.slice(c, x["a"] + 1, F.greatest(x["b"] - x["a"], F.lit(0)))
    count = lambda x: array_sum(F.transform(cut(mask, x), lambda m: m.cast("double")))
    total = lambda x: array_sum(F.zip_with(cut(losses, x), cut(mask, x), lambda v, m: v.cast("double") * m.cast("double")))
    out = F.transform(bounds, lambda x: F.struct((total(x) / F.greatest(count(x), F.lit(1.0))).alias("loss"), count(x).cast("bigint").alias("token_count")))
    return rows.withColumn("segments", out).withColumn("active_count", F.size(F.filter(bounds, lambda x: x["b"] > x["a"])))
