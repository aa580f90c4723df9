"""Late and out-of-order events: per-period counts by event time, as lambda views.

Every arriving row gets a verdict (``admit``): ``on_time``, ``correcting`` (its period had
already ended when it came) or ``dropped`` (later than the cut-off).  The *fast layer*
adds each batch's accepted rows to provisional periods, without looking back.  The
scheduled *batch layer* recomputes from the full log: of each key the last accepted row
counts, in the period of its event.  It replaces the open periods; a period whose
cut-off has passed is frozen.  A frozen period takes no more rows; when a key's row in it
is replaced by a row of a later period, the difference is kept beside it as an amendment,
so what is served is frozen + amendments + open + provisional.

Defined results: the instant of an event is read from its magnitude (seconds,
milliseconds, microseconds or nanoseconds since 1970); null, zero and negative times have
no period and are neither accepted nor dropped; a row with no time of receipt is never
late and replaces nothing; among rows received at the same time the larger row_id is the
last; keys may hold nulls.  Statuses other than COMPLETE and INCOMPLETE replace, and are
not counted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import same_name
from ..session import cut, exists, remove, shared_folder, small_side

HOUR_NS = 3_600_000_000_000
CUTOFF_NS = 6 * HOUR_NS
KEY = ("run_id", "dataset_id", "training_iteration_id")
STATUSES = ("complete", "incomplete")


def instant_ns(value: Column) -> Column:
    """Nanoseconds since 1970 of a time in any of four units; null for what is no time."""
    v = value.cast("bigint")
    times = lambda k: F.try_multiply(v, F.lit(k).cast("bigint"))
    unit = F.when(v < 10**11, times(10**9)).when(v < 10**14, times(10**6)).when(v < 10**17, times(10**3)).otherwise(v)
    return F.when(v > 0, unit)


def admit(rows: DataFrame, at: str = "processed_at_unix_ns", received: str = "received_at_unix_ns", period_ns: int = HOUR_NS, cutoff_ns: int = CUTOFF_NS) -> DataFrame:
    """Add event_ns, period_ns (the period's start) and verdict; one narrow pass."""
    event, period = F.col("event_ns"), F.col("period_start_ns")
    late = F.try_subtract(F.col(received), event) > cutoff_ns
    verdict = F.when(event.isNull(), F.lit(None)).when(late, "dropped").when(F.col(received) >= period + period_ns, "correcting").otherwise("on_time")
    return (
        rows.withColumn("event_ns", instant_ns(F.col(at)))
        .withColumn("period_start_ns", event - event % period_ns)
        .withColumn("verdict", verdict)
    )


def accepted(rows: DataFrame) -> DataFrame:
    """Admitted rows that count: key, receipt, row_id, period and status."""
    seen = admit(rows).where(F.col("verdict").isin("on_time", "correcting"))
    return seen.select(*KEY, "received_at_unix_ns", "row_id", "period_start_ns", same_name("status").alias("status"))


def last_rows(rows: DataFrame) -> DataFrame:
    """Of accepted rows the last of each key; combined before the shuffle, so repeated keys don't pile up."""
    order = F.struct(F.coalesce("received_at_unix_ns", F.lit(-(1 << 63))).alias("r"), "row_id")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("period_start_ns", "status"), order).alias("x"))
    return last.select("run_id", "x.period_start_ns", "x.status")


def count_periods(last: DataFrame) -> DataFrame:
    """Number of COMPLETE and INCOMPLETE rows per run and period."""
    kept = last.where(F.col("status").isin(*STATUSES))
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return kept.groupBy("run_id", "period_start_ns").agg(*[n(s).alias(s) for s in STATUSES])


def recount(log: DataFrame) -> DataFrame:
    """The batch layer over a whole log."""
    return count_periods(last_rows(accepted(log)))


class LambdaView:
    """Both layers over batches that arrive one after another, in a folder.

    ``take`` logs a batch and adds its increments to the fast layer.  ``recompute`` writes
    a new version of the batch layer; batches taken before it no longer count as
    provisional.  ``serve`` gives the counts, ``outcomes`` what became of each row.

    What is in force stands in ``published``, one small row per step, written last: a step
    that fails before it leaves what was, and may be made again; a view that is opened on
    its folder later goes on where the last one stopped.  One writer at a time.

    A recompute reads the keys that may count in an open period (those with a row in one,
    or in a batch taken since) and recounts these from the full log.  Periods whose cut-off
    has passed are frozen; what later rows change in them is kept as an amendment.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/views-{uuid.uuid4().hex}"

    # ------------------------------------------------------------ what is in force

    def _published(self) -> list:
        """The steps so far, in order; few rows, one per batch or recompute."""
        if not exists(self.spark, f"{self.folder}/published"):
            return []
        return self.spark.read.schema(_STEP).parquet(f"{self.folder}/published").orderBy("step").collect()

    def _publish(self, step: int, kind: str, number: int | None, at: str, frozen_until: int | None) -> None:
        row = self.spark.createDataFrame([(step, kind, number, at, frozen_until)], _STEP)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/published")

    @property
    def taken(self) -> list[int]:
        """The numbers of the batches taken, in the order they were."""
        return [s["number"] for s in self._published() if s["kind"] == "batch"]

    # ------------------------------------------------------------ layers

    def take(self, batch: DataFrame, number: int) -> None:
        """Log a batch and add its accepted rows to the provisional periods.

        Numbers may come in any order; one already taken is not taken again.
        """
        steps = self._published()
        if any(s["kind"] == "batch" and s["number"] == number for s in steps):
            return
        step, at = _next(steps), f"batch-{number}-{uuid.uuid4().hex[:8]}"
        judged = admit(batch).select(*KEY, "received_at_unix_ns", "row_id", "period_start_ns", same_name("status").alias("status"), "verdict")
        judged.write.mode("overwrite").parquet(f"{self.folder}/log/{at}")
        fast = count_periods(last_rows(self._log([at]).where(_COUNTS)))
        fast.write.mode("overwrite").parquet(f"{self.folder}/fast/{at}")
        self._publish(step, "batch", number, at, None)

    def _log(self, at: list[str]) -> DataFrame:
        if not at:
            return self.spark.createDataFrame([], _LOGGED)
        return self.spark.read.schema(_LOGGED).parquet(*[f"{self.folder}/log/{a}" for a in at])

    def recompute(self, now_ns: int) -> None:
        """Replace the open periods by a recount from the full log; freeze periods whose cut-off has passed.

        ``now_ns`` is the time of receipt up to which the log is complete; it never goes back.
        """
        steps = self._published()
        versions = [s for s in steps if s["kind"] == "version"]
        last = versions[-1] if versions else None
        old = [s["at"] for s in steps if s["kind"] == "batch" and last and s["step"] < last["step"]]
        new = [s["at"] for s in steps if s["kind"] == "batch" and not (last and s["step"] < last["step"])]
        now_ns = max(now_ns, last["frozen_until"]) if last else now_ns
        ends = F.col("period_start_ns") + (HOUR_NS + CUTOFF_NS)
        closed = ends <= F.lit(now_ns)
        at = f"version-{_next(steps)}-{uuid.uuid4().hex[:8]}"
        log = self._log(old + new).where(_COUNTS)
        if last is None:
            exact = count_periods(last_rows(log))
            whole = exact.withColumn("layer", F.when(closed, "frozen").otherwise("open"))
        else:
            was = ends <= F.lit(last["frozen_until"])
            before = self.spark.read.schema(_VERSION).parquet(f"{self.folder}/batch/{last['at']}")
            touched = cut(self._log(new).where(_COUNTS).select(*KEY).distinct())
            open_keys = log.where(~was).select(*KEY).unionByName(touched).distinct()
            mine = of_keys(log, cut(open_keys))
            exact = count_periods(last_rows(mine)).where(~was)
            replaced = exact.withColumn("layer", F.when(closed, "frozen").otherwise("open"))
            now_counts = count_periods(last_rows(of_keys(log, touched))).where(was)
            then_counts = count_periods(last_rows(of_keys(self._log(old).where(_COUNTS), touched))).where(was)
            minus = then_counts.select("run_id", "period_start_ns", *[(-F.col(s)).alias(s) for s in STATUSES])
            amended = before.where("layer = 'amended'").drop("layer").unionByName(now_counts).unionByName(minus)
            amended = _total(amended).withColumn("layer", F.lit("amended"))
            whole = before.where("layer = 'frozen'").unionByName(replaced).unionByName(amended)
        whole.write.mode("overwrite").parquet(f"{self.folder}/batch/{at}")
        self._publish(_next(steps), "version", None, at, now_ns)
        for stale in versions[:-1]:  # readers of the last version may still be at work
            remove(self.spark, f"{self.folder}/batch/{stale['at']}")

    def serve(self) -> DataFrame:
        """run_id, period_start_ns, complete, incomplete: exact up to the last recompute, provisional after it."""
        steps = self._published()
        version = next((s for s in reversed(steps) if s["kind"] == "version"), None)
        fast = [s["at"] for s in steps if s["kind"] == "batch" and not (version and s["step"] < version["step"])]
        whole = self.spark.createDataFrame([], _COUNTED)
        if version:
            whole = whole.unionByName(self.spark.read.schema(_VERSION).parquet(f"{self.folder}/batch/{version['at']}").drop("layer"))
        if fast:
            whole = whole.unionByName(self.spark.read.schema(_COUNTED).parquet(*[f"{self.folder}/fast/{a}" for a in fast]))
        return _total(whole)

    def outcomes(self) -> DataFrame:
        """row_id, outcome of the rows that were ``dropped`` at intake or are ``correcting`` a period that had ended."""
        log = self._log([s["at"] for s in self._published() if s["kind"] == "batch"])
        return log.where(F.col("verdict").isin("dropped", "correcting")).select("row_id", F.col("verdict").alias("outcome"))


_STEP = "step bigint, kind string, number bigint, at string, frozen_until bigint"
_LOGGED = "run_id string, dataset_id int, training_iteration_id bigint, received_at_unix_ns bigint, row_id bigint, period_start_ns bigint, status string, verdict string"
_COUNTED = "run_id string, period_start_ns bigint, complete bigint, incomplete bigint"
_VERSION = _COUNTED + ", layer string"
_COUNTS = "verdict in ('on_time', 'correcting')"


def _next(steps: list) -> int:
    return 1 + max((s["step"] for s in steps), default=-1)


def _total(parts: DataFrame) -> DataFrame:
    """Counts of the same run and period added up; those that come to nothing are left out."""
    summed = parts.groupBy("run_id", "period_start_ns").agg(*[F.sum(s).cast("bigint").alias(s) for s in STATUSES])
    return summed.where(" or ".join(f"{s} <> 0" for s in STATUSES))


def of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of some keys, nulls among them too; the keys are broadcast while they are few."""
    side = small_side(keys.select(*[F.col(c).alias(f"__{c}") for c in KEY]))
    same = F.lit(True)
    for c in KEY:
        same = same & rows[c].eqNullSafe(side[f"__{c}"])
    return rows.join(side, same, "left_semi")
