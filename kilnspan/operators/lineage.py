"""Resume state: hashes, lineage, and agreement of ranks."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def json_digest(value: Column) -> Column:
    """The same of a column of whole numbers, booleans, strings or lists of them, whose JSON is canonical as Spark writes it."""
    return F.sha2(F.to_json(value), 256)


def resume_faults(states: DataFrame, global_batch: int, by: list[str]) -> DataFrame:
    """(by, iteration, fault): checkpoints that must not be resumed from.

    ``states``: one row per rank with the two states as canonical JSON and the hashes stored
    with them, the samples consumed, the iteration through which records are durable, and
    the hash of the rank's capture state.
    """
    broken = {
        "dataset state hash": F.sha2("dataset_state", 256) != F.col("dataset_sha256"),
        "controller state hash": F.sha2("controller_state", 256) != F.col("controller_sha256"),
        "consumed samples": F.col("consumed") != F.col("iteration") * global_batch,
        "not durable": F.col("durable_through") != F.col("iteration"),
    }
    whole = states.groupBy(*by, "iteration").agg(
        *[F.bool_or(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in broken.items()],
        (F.count_distinct(F.coalesce("capture_sha256", F.lit(""))) > 1).alias("ranks differ"),
    )
    names = F.array(*[F.when(F.col(f"`{name}`"), F.lit(name)) for name in (*broken, "ranks differ")])
    return whole.select(*by, "iteration", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("fault"))


def salvage_record(iteration: int, failure: BaseException, last_exact: tuple[int, str] | None, parent: dict | None) -> dict:
    """What is noted beside a model that was saved although no exact checkpoint could be made."""
    reached, path = last_exact or (None, None)
    return {"exact_resume": False, "reason": f"{type(failure).__name__}: {failure}", "failed_iteration": iteration, "last_exact_iteration": reached, "last_exact_path": path, "parent": parent}


def file_digest(path: str | Path) -> str:
    """SHA-256 of a file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def lineage_gaps(parts: DataFrame, by: str = "run_id", start: str = "valid_start", end: str = "valid_end", first: int = 1) -> DataFrame:
    """Lineage parts that do not continue the one before (the first must start at ``first``), or end before they start."""
    before = F.lag(end).over(Window.partitionBy(by).orderBy(start, end))
    ok = (F.col(start) == F.coalesce(F.col("__before") + 1, F.lit(first))) & (F.col(end) >= F.col(start))
    return parts.withColumn("__before", before).where(~F.coalesce(ok, F.lit(False))).withColumnRenamed("__before", "previous_end")


def disagreeing(states: DataFrame, by: list[str], value: str = "hash") -> DataFrame:
    """Groups whose members do not all hold the same value."""
    out = states.groupBy(*by).agg(F.count_distinct(F.coalesce(value, F.lit(""))).alias("values"), F.count(F.lit(1)).alias("members"))
    return out.where("values <> 1")


def consumed_mismatch(states: DataFrame, global_batch: int) -> DataFrame:
    """States whose consumed samples are not iteration x batch."""
    return states.where(~F.col("consumed").eqNullSafe(F.col("iteration") * global_batch))


def window_position(iteration: int, window_iters: int) -> tuple[int, int]:
    """(window, iterations done in it) after an iteration."""
    return (iteration // window_iters + 1, iteration % window_iters)


def counter_breaks(windows: DataFrame) -> DataFrame:
    """Windows whose counters are not the previous window's plus their own draws (compared window by window)."""
    order = Window.partitionBy("run_id").orderBy("window_id")
    one = windows.groupBy("run_id", "window_id").agg(F.max(F.struct("counters_after", "dataset_index")).alias("w")).select("run_id", "window_id", "w.*")
    drawn = F.transform("counters_after", lambda _, i: F.size(F.filter("dataset_index", lambda d: d == i)).cast("bigint"))
    rows = one.withColumn("drawn", drawn).withColumn("previous", F.lag("counters_after").over(order)).withColumn("previous_id", F.lag("window_id").over(order))
    expected = F.zip_with(F.col("previous"), F.col("drawn"), lambda a, b: a + b)
    follows = F.col("previous_id") == F.col("window_id") - 1
    return rows.where(follows & ~F.coalesce(expected == F.col("counters_after"), F.lit(False))).select("run_id", "window_id", "previous", "drawn", "counters_after")
