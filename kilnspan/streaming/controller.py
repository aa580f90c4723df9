"""Online loss-slope control on Structured Streaming.

Samples arrive out of order.  Each (run, iteration) is a state of its own that waits for
its acceptance and all its samples, so one run is spread over all tasks; what comes out
are the iteration's metrics.  Too many samples, a sample stored twice, a loss that is not
finite and data for an iteration that came out already are errors, never dropped; an
accepted iteration that is still incomplete a deadline after it was first seen accepted is
an error too, however busy the stream is.

:class:`OnlineControl` takes the metrics in ``foreachBatch``: it puts them in order
(iteration N, then N + 1), closes windows and makes decisions, all from tables in its
folder.  A batch counts once its number is published, so it may be run again, and a control
that is opened on the folder later goes on where the last one stopped.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators import loss_slope
from ..operators.loss_slope import DECISION, STANDING, Settings, window_indicators
from ..session import exists, matching, remove
from ..sources.audit import AuditWriter

SAMPLE_SCHEMA = "run_id string, training_iteration_id bigint, accepted boolean, dataset_id int, sample_key bigint, loss double, tokens bigint"
METRICS = "run_id string, training_iteration_id bigint, dataset_id int, status string, incomplete_reason string, sample_count bigint, positive_loss_sample_count bigint, target_token_count bigint, loss_value double"
#: first_ms: when the iteration was first seen accepted; out: whether its metrics came out.
_STATE = "accepted boolean, out boolean, first_ms bigint, keys array<bigint>, datasets array<int>, losses array<double>, tokens array<bigint>"


class LateData(RuntimeError):
    """An iteration did not become complete in time."""


def _metrics(run: str, iteration: int, samples: pd.DataFrame, datasets: list[int]) -> pd.DataFrame:
    """One row per dataset: the token-weighted loss over samples that have tokens."""
    positive = samples[samples["tokens"] > 0]
    by = positive.assign(weighted=positive["loss"] * positive["tokens"]).groupby("dataset_id")
    out = pd.DataFrame({"dataset_id": pd.array(datasets, dtype="int32")}).set_index("dataset_id", drop=False)
    out["sample_count"] = samples.groupby("dataset_id").size().reindex(out.index, fill_value=0)
    out["positive_loss_sample_count"] = by.size().reindex(out.index, fill_value=0)
    out["target_token_count"] = by["tokens"].sum().reindex(out.index, fill_value=0)
    out["loss_value"] = by["weighted"].sum().reindex(out.index) / out["target_token_count"].where(out["target_token_count"] > 0)
    out["incomplete_reason"] = ["no_samples" if n == 0 else "no_target_tokens" if t <= 0 else "" for n, t in zip(out["sample_count"], out["target_token_count"], strict=True)]
    out["status"] = ["INCOMPLETE" if r else "COMPLETE" for r in out["incomplete_reason"]]
    return out.assign(run_id=run, training_iteration_id=iteration)[[part.split()[0] for part in METRICS.split(", ")]]


def complete_iterations(samples: DataFrame, expected_samples: int, datasets: list[int], deadline_ms: int | None = None) -> DataFrame:
    """Stream of samples -> stream of the metrics of complete iterations, in no order between iterations (see :func:`in_order`).

    A row with ``accepted`` true and a null sample_key marks its iteration accepted.
    """
    known = set(datasets)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, iteration = key[0], int(key[1])
        if state.hasTimedOut:
            raise LateData(f"run {run}: iteration {iteration} incomplete {deadline_ms} ms after it was accepted")
        accepted, out, first_ms, *held = state.get if state.exists else (False, False, None, [], [], [], [])
        fresh = pd.concat(list(batches), ignore_index=True)
        if out:
            raise RuntimeError(f"run {run}: data for iteration {iteration} after it came out")
        accepted = bool(accepted) or bool(fresh.loc[fresh["sample_key"].isna(), "accepted"].fillna(False).astype(bool).any())
        rows = fresh[fresh["sample_key"].notna()]
        finite = pd.to_numeric(rows["loss"], errors="coerce").abs() < float("inf")
        if not finite.all():
            raise RuntimeError(f"run {run}: losses of samples {rows['sample_key'][~finite].astype(int).tolist()[:5]} are not finite")
        if strange := sorted(set(rows["dataset_id"].dropna().astype(int)) - known):
            raise RuntimeError(f"run {run}: unknown datasets {strange}")
        old = pd.DataFrame({"sample_key": held[0], "dataset_id": held[1], "loss": held[2], "tokens": held[3]})
        every = pd.concat([old, rows[["sample_key", "dataset_id", "loss", "tokens"]]], ignore_index=True)
        every = every.astype({"sample_key": "int64", "dataset_id": "int64", "loss": "float64", "tokens": "int64"})
        if twice := every["sample_key"][every["sample_key"].duplicated()].tolist():
            raise RuntimeError(f"run {run}: duplicate sample {twice[0]} in iteration {iteration}")
        if len(every) > expected_samples:
            raise RuntimeError(f"run {run}: more than {expected_samples} samples in iteration {iteration}")
        if accepted and len(every) == expected_samples:
            state.update((True, True, first_ms, [], [], [], []))
            yield _metrics(run, iteration, every, datasets)
            return
        if accepted and deadline_ms is not None:
            now = state.getCurrentProcessingTimeMs()
            first_ms = now if first_ms is None else int(first_ms)
            state.setTimeoutDuration(max(1, first_ms + deadline_ms - now))
        state.update((accepted, False, first_ms, *(every[c].tolist() for c in ("sample_key", "dataset_id", "loss", "tokens"))))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if deadline_ms is not None else GroupStateTimeout.NoTimeout
    return samples.groupBy("run_id", "training_iteration_id").applyInPandasWithState(step, METRICS, _STATE, "append", timeout)


def in_order(metrics: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The metrics of the iterations that follow one another without a gap, from 1 or from a run's ``last`` iteration on."""
    iterations = metrics.select("run_id", "training_iteration_id").distinct()
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("training_iteration_id"))
    numbered = iterations.withColumn("__nth", nth)
    if last is not None:
        numbered = numbered.join(last.select("run_id", F.col("last").alias("__last")), "run_id", "left")
    before = F.coalesce("__last", F.lit(0)) if last is not None else F.lit(0)
    following = numbered.where(F.col("training_iteration_id") == before + F.col("__nth")).select("run_id", "training_iteration_id")
    return metrics.join(following, ["run_id", "training_iteration_id"], "left_semi")


# ---------------------------------------------------------------- decisions, kept


class DecisionStore:
    """Decisions by (run, effective window), in tables of a folder: written once; the same again is fine, another is an error."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def all(self) -> DataFrame:
        parts = matching(self.spark, f"{self.folder}/decisions/*/_SUCCESS")
        if not parts:
            return self.spark.createDataFrame([], DECISION)
        return self.spark.read.schema(DECISION).parquet(*[p.rsplit("/", 1)[0] for p in parts])

    def publish(self, decisions: DataFrame, name: str | None = None) -> None:
        """Add decisions; none is added if one of them contradicts what is there."""
        keys = ["run_id", "effective_window_id"]
        fields = [part.split()[0] for part in DECISION.split(", ")]
        known = self.all().select(*keys, F.struct(*fields).alias("__known"))
        both = decisions.select(*fields).join(known, keys, "left")
        clash = both.where(F.col("__known").isNotNull() & (F.col("__known") != F.struct(*fields))).select(*keys).limit(5).collect()
        if clash:
            raise ValueError(f"conflicting decisions for {[tuple(r) for r in clash]}")
        new = both.where(F.col("__known").isNull()).select(*fields)
        new.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/decisions/{name or uuid.uuid4().hex}")

    def get(self, run_id: str, window_id: int, wait_s: float = 0.0, poll_s: float = 0.2):
        """The decision that takes effect in a window, as a row; waits for it so long, then None.  Every request is noted."""
        asked = time.time_ns()
        until = time.monotonic() + wait_s
        while True:
            found = self.all().where((F.col("run_id") == run_id) & (F.col("effective_window_id") == window_id)).first()
            if found or time.monotonic() >= until:
                break
            time.sleep(min(poll_s, max(0.0, until - time.monotonic())))
        note = [(run_id, window_id, found["decision_id"] if found else None, "served" if found else "timeout", asked, time.time_ns())]
        self.spark.createDataFrame(note, REQUEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/audit/decision_requests")
        return found


REQUEST = "run_id string, window_id bigint, decision_id bigint, outcome string, requested_at_unix_ns bigint, answered_at_unix_ns bigint"
REALIZED = "run_id string, training_iteration_id bigint, dataset_id int, sample_count bigint"
AUDIT_TABLES = ("iteration_metrics", "window_indicators", "realized_mixture", "mixture_decisions")
_PUBLISHED = "batch bigint, at string"


class OnlineControl:
    """foreachBatch function: orders iterations, closes windows, decides, and writes the audit tables beside.

    Per batch the folder gets ``state``: iterations that wait (for one before them or for their
    window's end; bounded by what is open), and where each run stands.  Decisions follow
    from the stored standing and the windows just closed alone.  Audit tables are written by a
    thread; a failure is raised by the next batch, and what a crash kept from being
    written is written when the control is opened again.  One control at a time works on a folder.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings, standing: DataFrame | None = None) -> None:
        self.spark, self.folder, self.settings = spark, folder, settings
        self.store, self.audit = DecisionStore(spark, folder), AuditWriter()
        if standing is not None and not self._published():
            standing.coalesce(1).write.mode("overwrite").parquet(f"{folder}/begin")
        for row in self._published():
            self._audit(row["batch"], row["at"])

    def _published(self) -> list:
        if not exists(self.spark, f"{self.folder}/published"):
            return []
        return self.spark.read.schema(_PUBLISHED).parquet(f"{self.folder}/published").orderBy("batch").collect()

    def _read(self, at: str | None, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/state/{at}/{part}") if at else self.spark.createDataFrame([], schema)

    def standing(self) -> DataFrame:
        """Where every run stands."""
        done = self._published()
        if done:
            return self._read(done[-1]["at"], "standing", STANDING)
        return self.spark.read.schema(STANDING).parquet(f"{self.folder}/begin") if exists(self.spark, f"{self.folder}/begin") else self.spark.createDataFrame([], STANDING)

    def __call__(self, batch: DataFrame, number: int) -> None:
        done = self._published()
        if any(r["batch"] == number for r in done):
            return
        s, last_at = self.settings, done[-1]["at"] if done else None
        at = f"batch-{number}-{uuid.uuid4().hex[:8]}"
        here = f"{self.folder}/state/{at}"
        fields = [part.split()[0] for part in METRICS.split(", ")]
        waiting = self._read(last_at, "waiting", METRICS).unionByName(batch.select(*fields))
        waiting.write.mode("overwrite").parquet(f"{here}/all")
        waiting = self._read(at, "all", METRICS)
        standing = self.standing()
        edge = standing.select("run_id", (F.col("last_window_id") * s.window_iters).alias("last"))
        ordered = in_order(waiting, edge)
        window = loss_slope.window_of(F.col("training_iteration_id"), s.window_iters)
        whole = ordered.withColumn("window_id", window).groupBy("run_id", "window_id").agg(F.countDistinct("training_iteration_id").alias("n")).where(F.col("n") == s.window_iters)
        whole = whole.select("run_id", "window_id")
        whole.coalesce(1).write.mode("overwrite").parquet(f"{here}/closed")
        closed = self._read(at, "closed", "run_id string, window_id bigint")
        mine = waiting.withColumn("window_id", window)
        indicators = window_indicators(mine.join(closed, ["run_id", "window_id"], "left_semi").drop("window_id"), s.window_iters, s.total_windows)
        indicators.coalesce(1).write.mode("overwrite").parquet(f"{here}/indicators")
        indicators = self.spark.read.parquet(f"{here}/indicators")
        known = standing.select("run_id")
        decided = loss_slope.decide(indicators.join(known, "run_id", "left_semi"), s, standing)
        begun = loss_slope.decide(indicators.join(known, "run_id", "left_anti"), s)
        decided.unionByName(begun).coalesce(1).write.mode("overwrite").parquet(f"{here}/decided")
        decided = self.spark.read.schema(f"{STANDING}, made array<struct<{DECISION.replace(' ', ':').replace(',:', ',')}>>").parquet(f"{here}/decided")
        moved = decided.drop("made")
        moved.unionByName(standing.join(moved.select("run_id"), "run_id", "left_anti")).coalesce(1).write.mode("overwrite").parquet(f"{here}/standing")
        mine.join(closed, ["run_id", "window_id"], "left_anti").select(*fields).write.mode("overwrite").parquet(f"{here}/waiting")
        batch.select(*fields).write.mode("overwrite").parquet(f"{here}/batch")
        self.store.publish(loss_slope.decisions_made(decided), f"batch={number}")
        self.spark.createDataFrame([(number, at)], _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{self.folder}/published")
        self._audit(number, at)
        remove(self.spark, f"{here}/all")
        if last_at:
            remove(self.spark, f"{self.folder}/state/{last_at}/waiting")

    def _audit(self, number: int, at: str) -> None:
        """Have the batch's rows written to the audit tables, unless they are there."""
        read = self.spark.read.parquet
        here = f"{self.folder}/state/{at}"
        tables = {
            "iteration_metrics": lambda: read(f"{here}/batch"),
            "realized_mixture": lambda: read(f"{here}/batch").select(*[part.split()[0] for part in REALIZED.split(", ")]),
            "window_indicators": lambda: read(f"{here}/indicators"),
            "mixture_decisions": lambda: loss_slope.decisions_made(read(f"{here}/decided")),
        }
        for name, rows in tables.items():
            to = f"{self.folder}/audit/{name}/batch={number}"
            if not exists(self.spark, f"{to}/_SUCCESS"):
                self.audit.submit(lambda rows=rows, to=to: rows().write.mode("overwrite").parquet(to))

    def close(self) -> None:
        """Wait for the audit tables."""
        self.audit.close()

    def snapshot(self, run_id: str, iteration: int, wait_s: float = 0.0, poll_s: float = 0.2) -> dict:
        """A run's record as of an iteration that ends a window: waits for it so long; a run that is further on is refused."""
        if iteration % self.settings.window_iters:
            raise ValueError(f"iteration {iteration} does not end a window")
        window, until = iteration // self.settings.window_iters, time.monotonic() + wait_s
        while True:
            row = self.standing().where(F.col("run_id") == run_id).first()
            at = row["last_window_id"] if row else 0
            if at > window:
                raise RuntimeError(f"run {run_id} stands at window {at}, beyond {window}")
            if at == window and row:
                return self.settings.record(row.asDict())
            if time.monotonic() >= until:
                raise TimeoutError(f"run {run_id} stands at window {at}, not yet at {window}")
            time.sleep(min(poll_s, max(0.0, until - time.monotonic())))


def resume(spark: SparkSession, settings: Settings, records: list[Mapping]) -> DataFrame:
    """Standings out of snapshot records, to begin another control with."""
    fields = [part.split()[0] for part in STANDING.split(", ")]
    rows = [settings.standing(r) for r in records]
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], STANDING)


def require_new_run(spark: SparkSession, folder: str, run_id: str) -> None:
    """An audit folder that already knows the run is refused."""
    at = f"{folder}/audit/iteration_metrics"
    if exists(spark, at) and matching(spark, f"{at}/*/*.parquet") and not spark.read.parquet(at).where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id!r} exists already")


def wait_ready(spark: SparkSession, paths: list[str], timeout_s: float, poll_s: float = 0.5) -> None:
    """Wait until all tables are there; none of them late is an error."""
    until = time.monotonic() + timeout_s
    while missing := [p for p in paths if not exists(spark, p)]:
        if time.monotonic() >= until:
            raise TimeoutError(f"not there after {timeout_s} s: {missing}")
        time.sleep(min(poll_s, max(0.0, until - time.monotonic())))
