"""Which attempt of an iteration counts: status rows, resolution, and the visibility of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import DataError, require, require_empty
from ..schema import ABORTED, ACCEPTED, REJECTED, STATUS_ACT, STATUS_IDENTITY
from ..session import small_side

ITERATION = ["model_id", "global_batch_id"]


def status_rows(ints: DataFrame) -> DataFrame:
    """The status rows of an integer table."""
    return ints.where((F.col("act_name") == STATUS_ACT) & (F.col("direction") == "iter") & (F.col("phase") == "train"))


def status_rules() -> dict[str, Column]:
    """What a status row must satisfy."""
    identity = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in STATUS_IDENTITY.items()])
    return {"value outside -1, 0, 1": F.col("value").isin(ABORTED, REJECTED, ACCEPTED), "unexpected identity": identity}


def resolve(status: DataFrame) -> DataFrame:
    """Per iteration: accepted_attempt (null if none), accepted and aborted counts, attempts."""
    accepted = F.col("value") == ACCEPTED
    return status.groupBy(*ITERATION).agg(
        F.max(F.when(accepted, F.col("attempt_id"))).alias("accepted_attempt"),
        F.count_if(accepted).alias("accepted_count"),
        F.count_if(F.col("value") == ABORTED).alias("aborted_count"),
        F.count(F.lit(1)).alias("attempt_count"),
    )


def accepted_attempts(ints: DataFrame, strict: bool = True) -> DataFrame:
    """(model_id, global_batch_id, attempt_id) of accepted attempts.

    Strict: status rows are checked, no iteration has two accepted attempts, and one
    without an accepted attempt has an aborted one.
    """
    status = status_rows(ints)
    resolved = resolve(require(status, status_rules(), "attempt status") if strict else status)
    if strict:
        require_empty(resolved.where("accepted_count > 1").select(*ITERATION), "more than one accepted attempt")
        require_empty(resolved.where("accepted_count = 0 and aborted_count = 0").select(*ITERATION), "no accepted and no aborted attempt")
    return resolved.where("accepted_count = 1").select(*ITERATION, F.col("accepted_attempt").alias("attempt_id"))


def represented_iterations(*tables: DataFrame) -> DataFrame:
    """Distinct training iterations that have payload rows in any of the tables."""
    one = lambda t: t.where((F.col("phase") == "train") & (F.col("global_batch_id") != 0) & (F.col("act_name") != STATUS_ACT)).select(*ITERATION).distinct()
    return reduce(lambda a, b: a.unionByName(b), map(one, tables)).distinct()


def without_status(represented: DataFrame, resolved: DataFrame) -> DataFrame:
    """Represented iterations that are neither accepted nor aborted."""
    known = resolved.where("accepted_count > 0 or aborted_count > 0").select(*ITERATION)
    return represented.join(known, ITERATION, "left_anti")


def require_status(represented: DataFrame, resolved: DataFrame) -> None:
    """Payload without an accepted attempt is an error."""
    missing = [r["global_batch_id"] for r in without_status(represented, resolved).select("global_batch_id").distinct().orderBy("global_batch_id").limit(20).collect()]
    if missing:
        raise DataError(f"no accepted attempt status: {missing}")


def visible(rows: DataFrame, accepted: DataFrame, all_attempts: bool = False, all_invocations: bool = False) -> DataFrame:
    """Default visibility: rows outside training and of iteration 0 pass; training rows need an accepted attempt; invocation 0.

    One pass and one join; the accepted attempts are broadcast while their number is within a bound.
    """
    if not all_invocations:
        rows = rows.where("invocation_id = 0")
    if all_attempts:
        return rows
    marked = small_side(accepted.select(*[F.col(c).alias(f"__{c}") for c in (*ITERATION, "attempt_id")]).distinct())
    free = (F.col("phase") != "train") | (F.col("global_batch_id") == 0)
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in (*ITERATION, "attempt_id")])
    return rows.join(marked, match, "left").where(free | F.col("__attempt_id").isNotNull()).select(*rows.columns)


def terminal_rules() -> dict[str, Column]:
    """Rules of an iteration's attempts: consecutive from 0, and exactly one accepted or aborted, the last."""
    order = F.array_sort("attempts")
    last = F.element_at(order, -1)
    return {
        "attempts not consecutive": F.transform(order, lambda x, i: x["attempt_id"] - i) == F.array_repeat(F.lit(0), F.size(order)),
        "not exactly one accepted or aborted": F.size(F.filter(order, lambda x: x["value"] != REJECTED)) == 1,
        "ends without a decision": last["value"] != REJECTED,
    }


def iteration_ends(status: DataFrame) -> DataFrame:
    """Per iteration: its attempts, and which of the rules above hold."""
    grouped = status.groupBy(*ITERATION).agg(F.collect_list(F.struct("attempt_id", "value")).alias("attempts"))
    ok = [F.coalesce(rule, F.lit(False)).alias(name.replace(" ", "_")) for name, rule in terminal_rules().items()]
    return grouped.select(*ITERATION, F.size("attempts").alias("attempt_count"), *[(~c).alias(n.replace(" ", "_")) for c, n in zip(ok, terminal_rules(), strict=True)])
