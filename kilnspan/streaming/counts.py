"""Streaming counterparts: event-time counts with a watermark, and exactly-once message intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lambda_views import LambdaView, admit
from ..operators.seen import SeenStore


def provisional_counts(rows: DataFrame, delay: str = "6 hours", period: str = "1 hour") -> DataFrame:
    """Per run and period, rows that were not too late; the watermark drops what comes after ``delay``."""
    timed = admit(rows).where("verdict in ('on_time', 'correcting')").withColumn("event_time", F.timestamp_micros(F.expr("event_ns div 1000")))
    return timed.withWatermark("event_time", delay).groupBy("run_id", F.window("event_time", period).alias("w")).agg(F.count(F.lit(1)).alias("rows"))


def into_views(view: LambdaView, recompute_every: int = 4):
    """foreachBatch function: each batch into the fast layer, a recompute now and then."""

    def take(batch: DataFrame, number: int) -> None:
        view.take(batch, number)
        if number % recompute_every == recompute_every - 1:
            now = batch.agg(F.max("received_at_unix_ns")).first()[0]
            if now is not None:
                view.recompute(now)

    return take


def into_seen(store: SeenStore, prepare, sink: str):
    """foreachBatch function: first deliveries of each batch, written under the batch's number; a batch that runs again writes the same rows."""

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            kept = store.take(prepare(batch), number)
            batch.join(kept, store.order, "left_semi").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            batch.unpersist()

    return take
