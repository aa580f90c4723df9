"""Queries of this subpackage: name -> callable(spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import bpe, mixing, multiselect, packing, residue

ALIGNMENTS = ("top_route_alignment_q1", "top_route_alignment_median", "top_route_alignment_q3")


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Windows drawn off their target shares, or past a source's repeats."""
    return mixing.judge_windows(_read(spark, folder, "selection_windows"), _read(spark, folder, "loss_slope_mixture_decisions"), _read(spark, folder, "mixture_sources"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_read(spark, folder, "loss_slope_iteration_metrics"), _read(spark, folder, "loss_slope_mixture_decisions"), _read(spark, folder, "mixture_sources"))


def p1_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The training order: each row drawn, by its position."""
    return _mix(spark, folder)[0]


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target share, actual share and repeats of each dataset in that order."""
    return _mix(spark, folder)[1]


def p1_targets(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix asks of each dataset, and whether it keeps it: its share of the schedule, its tokens, no more repeats than allowed, and as many tokens as wanted to within one row."""
    rows, sources = _read(spark, folder, "loss_slope_iteration_metrics"), _read(spark, folder, "mixture_sources")
    shares = cut(_mix(spark, folder)[1])
    caps = sources.groupBy("dataset_id").agg(F.min("max_repeats").alias("max_repeats"))
    largest = rows.groupBy("dataset_id").agg(F.max("target_token_count").alias("largest"))
    # All sources keep their shares, so the one with the least room for its share sets the size of the mix.
    told = shares.join(F.broadcast(caps), "dataset_id").join(F.broadcast(largest), "dataset_id", "left")
    size = told.where("target_share > 0").agg(F.min(F.col("pool_tokens") * F.col("max_repeats") / F.col("target_share")).alias("size"))
    return told.crossJoin(F.broadcast(size)).select(
        "dataset_id",
        F.round("target_share", 6).alias("target_share"),
        "pool_tokens",
        (F.col("repeats") <= F.col("max_repeats")).alias("within_cap"),
        F.coalesce(F.abs(F.col("tokens") - F.col("target_share") * F.col("size")) <= F.col("largest") + 1, F.col("tokens") == 0).alias("as_wanted"),
    )


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the alignments per layer, and per layer and day, with rank error 0."""
    return multiselect.percentiles(_read(spark, folder, "expert_contribution"), ALIGNMENTS, "global_moe_layer", "report_day")


def p2_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per layer made of the single days' summaries alone, with the rank error they may have."""
    days = multiselect.summarise(_read(spark, folder, "expert_contribution"), ALIGNMENTS, ["global_moe_layer", "report_day"])
    return multiselect.combine(cut(days), ["global_moe_layer"])


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(_read(spark, folder, "documents"))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of each piece of a document that exceeds the capacity."""
    return packing.pack_documents(_read(spark, folder, "documents"), _read(spark, folder, "pack_containers"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each source are."""
    return packing.fill_report(p7_pack(spark, folder))


def p7_chars(spark: SparkSession, folder: str) -> DataFrame:
    """The same packing with sizes in code points, which SQL knows: per source what is packed, and that no container overflows, none is split below the capacity and few are used."""
    texts = _read(spark, folder, "documents").where("text is not null and text <> ''").select("doc_id", "source", F.char_length("text").alias("size"))
    bounds = _read(spark, folder, "pack_containers")
    packed = cut(packing.pack(texts, bounds, texts.groupBy("source").agg(F.count(F.lit(1)).alias("items")), "doc_id", "size"))
    held = packed.groupBy("source", "container_id").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("capacity"))
    per = held.groupBy("source").agg(F.sum("t").alias("chars"), F.count("container_id").alias("used"), F.max("capacity").alias("capacity"), F.max(F.col("t") > F.col("capacity")).alias("over"))
    whole = packed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.max("capacity").alias("capacity"))
    docs = whole.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.bool_or((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity"))), F.lit(False)).alias("split"))
    fewest = F.ceil(F.col("chars") / F.col("capacity")).cast("bigint")
    # First-fit decreasing takes at most 11/9 of the best and one more, in each group of documents.
    few = F.col("used") <= F.floor(fewest * 11 / 9) + 1 + F.ceil(F.col("documents") / packing.GROUP_ITEMS)
    return per.join(docs, per["source"].eqNullSafe(docs["source"])).select(per["source"], "documents", "chars", fewest.alias("fewest_containers"), F.coalesce(~F.col("over"), F.lit(True)).alias("none_overflows"), (~F.col("split")).alias("none_split"), F.coalesce(few, F.lit(True)).alias("few_used"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with open slots, or without a body of their own."""
    return residue.find_residue(_read(spark, folder, "documents"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that stay in the corpus."""
    return residue.without_residue(_read(spark, folder, "documents")).select("doc_id", "source", "lang", "n_chars")


QUERIES = {f.__name__: f for f in (p1_found, p1_mix, p1_shares, p1_targets, p2_percentiles, p2_combined, p6_ids, p7_pack, p7_fill, p7_chars, p8_found, p8_clean)}
