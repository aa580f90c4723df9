"""Loss-slope control in batch form: iteration losses, window indicators, and the decisions that follow."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays

MODE = "loss_slope"


def window_of(iteration, window_iters: int):
    """Tumbling window of an iteration, both from 1."""
    return F.floor((iteration - 1) / window_iters).cast("bigint") + 1


def iteration_losses(samples: DataFrame, grid: DataFrame, by: Sequence[str] = ("run_id",), iteration: str = "training_iteration_id") -> DataFrame:
    """Per (by, dataset, iteration) of the grid: status, incomplete_reason, sample counts, tokens and the token-weighted loss.

    ``samples`` hold loss and tokens; ``grid`` names every (by, dataset_id, iteration) expected.
    """
    keys = [*by, "dataset_id", iteration]
    positive = F.col("tokens") > 0
    sums = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(positive).alias("positive_loss_sample_count"),
        F.coalesce(F.sum(F.when(positive, F.col("tokens"))), F.lit(0)).cast("bigint").alias("target_token_count"),
        F.sum(F.when(positive, F.col("loss") * F.col("tokens"))).alias("weighted"),
    )
    dense = grid.select(*keys).distinct().join(sums, keys, "left").na.fill(0, ["sample_count", "positive_loss_sample_count", "target_token_count"])
    loss = F.try_divide("weighted", F.col("target_token_count"))
    reason = F.when(F.col("sample_count") == 0, "no_samples").when(F.col("target_token_count") <= 0, "no_target_tokens").otherwise("")
    return dense.select(
        *keys, F.when(reason == "", "COMPLETE").otherwise("INCOMPLETE").alias("status"), reason.alias("incomplete_reason"),
        "sample_count", "positive_loss_sample_count", "target_token_count", loss.alias("loss_value"),
    )


def window_indicators(metrics: DataFrame, window_iters: int, total_windows: int | None = None, by: Sequence[str] = ("run_id",), iteration: str = "training_iteration_id") -> DataFrame:
    """Per (by, dataset, window): slope of the losses, indicator (its negative), completeness and why not.

    Iterations are points of an ordinary least-squares fit; any iteration without a loss,
    or not observed, makes the window INCOMPLETE and leaves the slope null.
    """
    keys = [*by, "dataset_id", "window_id"]
    has = F.col("loss_value").isNotNull()
    missing = F.array_sort(F.collect_list(F.when(~has, F.col(iteration))))
    rows = metrics.withColumn("window_id", window_of(F.col(iteration), window_iters)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed"),
        missing.alias("missing"),
        F.count_if(has).alias("iteration_point_count"),
        F.sum("sample_count").alias("sample_count"),
        F.sum("positive_loss_sample_count").alias("positive_loss_sample_count"),
        F.sum("target_token_count").alias("target_token_count"),
        F.regr_slope("loss_value", F.col(iteration).cast("double")).alias("slope"),
    )
    reasons = F.concat_ws(
        ";",
        F.when(F.col("observed") != window_iters, F.concat(F.lit("observed_iterations="), F.col("observed"), F.lit(f"<{window_iters}"))),
        F.when(F.size("missing") > 0, F.concat(F.lit("missing_loss_iterations="), F.array_join(F.col("missing").cast("array<string>"), ","))),
        F.when((F.col("observed") == window_iters) & (F.size("missing") == 0) & F.col("slope").isNull(), F.lit("undefined_loss_slope")),
    )
    done = F.col("incomplete_reason") == ""
    out = rows.withColumn("incomplete_reason", reasons)
    return out.select(
        *keys,
        ((F.col("window_id") - 1) * window_iters + 1).alias("window_start_iteration"),
        (F.col("window_id") * window_iters).alias("window_end_iteration"),
        (F.lit(False) if total_windows is None else F.col("window_id") == total_windows).alias("terminal_window"),
        F.when(done, "COMPLETE").otherwise("INCOMPLETE").alias("status"),
        "incomplete_reason",
        "iteration_point_count",
        F.lit(window_iters).alias("expected_iteration_point_count"),
        "sample_count",
        "positive_loss_sample_count",
        "target_token_count",
        F.when(done, F.col("slope")).alias("loss_slope"),
        F.when(done, -F.col("slope")).alias("indicator"),
    )


def realized_mixture(samples: DataFrame, by: Sequence[str] = ("run_id",), iteration: str = "training_iteration_id") -> DataFrame:
    """Samples per iteration and dataset."""
    return samples.groupBy(*by, iteration, "dataset_id").agg(F.count(F.lit(1)).alias("sample_count"))


# ---------------------------------------------------------------- decisions

DECISION = (
    "run_id string, decision_id bigint, decision_type string, source_window_id bigint, source_window_end_iteration bigint, "
    "effective_window_id bigint, effective_training_iteration bigint, weights array<double>, reason string"
)
#: Where a run stands: what holds, the last window taken, and the number of the next decision.
STANDING = "run_id string, dataset_ids array<int>, weights array<double>, last_window_id bigint, next_decision_id bigint"


@dataclass(frozen=True)
class Settings:
    """What a run's control is configured with."""

    window_iters: int
    total_windows: int
    eta: float
    uniform_smoothing: float

    def record(self, standing: Mapping) -> dict:
        """A run's standing with these settings, as a document that :meth:`standing` takes back."""
        return {"schema_version": 1, **asdict(self), **{name: standing[name] for name in _STANDING_FIELDS}}

    def standing(self, record: Mapping) -> dict:
        """The standing in a document of exactly these fields and settings."""
        mine = {"schema_version": 1, **asdict(self)}
        if set(record) != {*mine, *_STANDING_FIELDS}:
            raise ValueError(f"fields: {sorted(set(record) ^ {*mine, *_STANDING_FIELDS})}")
        if other := [name for name, value in mine.items() if record[name] != value]:
            raise ValueError(f"of another configuration: {other}")
        return {name: record[name] for name in _STANDING_FIELDS}


_STANDING_FIELDS = tuple(part.split()[0] for part in STANDING.split(", "))


def first_standing(spark: SparkSession, weights: Mapping[str, Mapping[int, float]]) -> DataFrame:
    """Standings of runs that begin: run -> dataset -> weight."""
    rows = [(run, sorted(w), [float(w[d]) for d in sorted(w)], 0, 1) for run, w in weights.items()]
    return spark.createDataFrame(rows, STANDING).withColumn("weights", arrays.normalize_weights(F.col("weights")))


def _windows_of(indicators: DataFrame) -> DataFrame:
    """(run_id, windows): each run's windows in order, their indicators by dataset and what is incomplete about them."""
    row = F.struct("dataset_id", F.col("indicator").alias("indicator"), F.when(F.col("status") != "COMPLETE", F.concat(F.lit("dataset="), "dataset_id", F.lit(":"), "incomplete_reason")).alias("broken"))
    windows = indicators.groupBy("run_id", "window_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    told = F.struct(
        "window_id",
        F.transform("rows", lambda r: r["dataset_id"]).alias("dataset_ids"),
        F.transform("rows", lambda r: r["indicator"]).alias("indicators"),
        F.array_join(F.transform("rows", lambda r: r["broken"]), "|").alias("reason"),
    )
    return windows.groupBy("run_id").agg(F.array_sort(F.collect_list(told)).alias("windows"))


def decide(indicators: DataFrame, settings: Settings, standing: DataFrame | None = None) -> DataFrame:
    """(STANDING after, made): runs in parallel, each run's windows (a list that the run bounds) folded in order by one expression.

    ``made`` holds the decisions: a window in which any dataset is incomplete holds the
    weights, any other updates them (:func:`arrays.updated_mixture`), and after the
    terminal window there is none.  A run without a standing begins with equal weights.
    Windows that don't follow one another, or lack a dataset, are an error.
    """
    runs = _windows_of(indicators)
    if standing is None:
        ids = F.get("windows", F.lit(0))["dataset_ids"]
        runs = runs.withColumns({"dataset_ids": ids, "weights": F.transform(ids, lambda _: 1.0 / F.size(ids)), "last_window_id": F.lit(0).cast("bigint"), "next_decision_id": F.lit(1).cast("bigint")})
    else:
        runs = runs.join(standing, "run_id")
    s = settings
    fail = lambda text, kind: F.raise_error(text).cast(kind)
    decisions = "array<struct<" + DECISION.replace(" ", ":").replace(",:", ",") + ">>"

    def weights_after(held: Column, w: Column) -> Column:
        update = arrays.normalize_weights(arrays.updated_mixture(held, w["indicators"], F.lit(s.eta), F.lit(s.uniform_smoothing)))
        held_or_new = F.when((w["reason"] != "") | (w["window_id"] == s.total_windows), held).otherwise(update)
        return F.when(w["dataset_ids"] == F.col("dataset_ids"), held_or_new).otherwise(fail("indicators do not cover the datasets", "array<double>"))

    def step(a: Column, w: Column) -> Column:
        follows = F.when(w["window_id"] == a["last"] + 1, w["window_id"]).otherwise(fail("a window is missing or came twice", "bigint"))
        after = weights_after(a["weights"], w)
        end = w["window_id"] * s.window_iters
        kind = F.when(w["reason"] == "", "UPDATE").otherwise("HOLD_INCOMPLETE")
        one = F.struct(
            F.col("run_id"), a["next"].alias("decision_id"), kind.alias("decision_type"), w["window_id"].alias("source_window_id"), end.alias("source_window_end_iteration"),
            (w["window_id"] + 1).alias("effective_window_id"), (end + 1).alias("effective_training_iteration"), after.alias("weights"), F.when(w["reason"] == "", "loss_slope").otherwise(w["reason"]).alias("reason"),
        )
        terminal = w["window_id"] == s.total_windows
        made = F.when(terminal, a["made"]).otherwise(F.concat(a["made"], F.array(one)))
        return F.struct(after.alias("weights"), follows.alias("last"), (a["next"] + F.when(terminal, 0).otherwise(1)).alias("next"), made.cast(decisions).alias("made"))

    start = F.struct(F.col("weights"), F.col("last_window_id").alias("last"), F.col("next_decision_id").alias("next"), F.array().cast(decisions).alias("made"))
    folded = runs.withColumn("x", F.aggregate("windows", start, step))
    return folded.select("run_id", "dataset_ids", F.col("x.weights").alias("weights"), F.col("x.last").alias("last_window_id"), F.col("x.next").alias("next_decision_id"), F.col("x.made").alias("made"))


def decisions_made(decided: DataFrame) -> DataFrame:
    """The decisions themselves, one a row."""
    return decided.select(F.inline("made"))


# ---------------------------------------------------------------- drawn windows


def drawn_samples(windows: DataFrame) -> DataFrame:
    """(run_id, window_id, pos, dataset_id, sample): one row per position drawn."""
    both = F.arrays_zip(F.col("dataset_index").alias("d"), F.col("dataset_sample_index").alias("s"))
    long = windows.select("run_id", "window_id", "first_training_iteration", F.posexplode(both).alias("pos", "x"))
    return long.select("run_id", "window_id", "first_training_iteration", "pos", F.col("x.d").alias("dataset_id"), F.col("x.s").alias("sample"))


def selection_counts(windows: DataFrame, global_batch: int, datasets: int) -> DataFrame:
    """Draws per iteration and dataset, 0 where there is none."""
    drawn = drawn_samples(windows).withColumn("training_iteration_id", F.col("first_training_iteration") + F.expr(f"pos div {global_batch}"))
    per = drawn.groupBy("run_id", "training_iteration_id")
    arrays = per.agg(*[F.count_if(F.col("dataset_id") == d).alias(f"c{d}") for d in range(datasets)])
    return arrays.select("run_id", "training_iteration_id", F.posexplode(F.array(*[f"c{d}" for d in range(datasets)])).alias("dataset_id", "draws"))


def running_samples(windows: DataFrame) -> DataFrame:
    """Draws with ``expected``: how often the dataset was drawn before, over all of the run's windows.

    Two levels: counts of the windows before, plus the place within the window, so no
    window function spans a run's positions.
    """
    drawn = drawn_samples(windows)
    per = drawn.groupBy("run_id", "window_id", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("run_id", "dataset_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("run_id", "window_id", "dataset_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("run_id", "window_id", "dataset_id").orderBy("pos")
    return drawn.join(base, ["run_id", "window_id", "dataset_id"]).withColumn("expected", F.col("base") + F.row_number().over(within) - 1).drop("base")


def decisions_for_windows(decisions: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with the decision that names it as effective window."""
    made = decisions.select("run_id", F.col("effective_window_id").alias("window_id"), F.col("decision_id").alias("made_decision_id"), F.col("weights").alias("made_weights"))
    return windows.join(made, ["run_id", "window_id"])


def sample_lookup(indices: DataFrame, windows: DataFrame, samples_per_window: int, lengths: Sequence[int], strict: bool = True) -> DataFrame:
    """Absolute sample indices -> (window, dataset, record): index // size + 1, then the window's draw, modulo the dataset's length.

    A dataset without a length is an error, or gives no record if not strict.
    """
    placed = indices.withColumn("window_id", F.expr(f"index div {samples_per_window}") + 1).withColumn("pos", (F.col("index") % samples_per_window).cast("int"))
    drawn = drawn_samples(windows)
    sizes = F.array(*map(F.lit, lengths))
    size = F.element_at(sizes, F.col("dataset_id") + 1) if strict else F.when(F.col("dataset_id") >= 0, F.get(sizes, F.col("dataset_id")))
    return placed.join(drawn, ["window_id", "pos"]).withColumn("record", F.pmod(F.col("sample"), size))


def drawn_windows(seed: int, decided: Iterable[tuple[int, Sequence[float]]], samples: int, iterations: int) -> Iterator[dict]:
    """Windows of seeded draws, one for each (decision_id, weights), over one stream of random numbers.

    The stream is sequential by nature, so this runs on the driver; it yields rows of a
    selection_windows table one by one.
    """
    if min(samples, iterations) < 1 or samples % iterations:
        raise ValueError("a window's samples must be a multiple of its iterations")
    stream, before = random.Random(seed), None
    for n, (decision_id, weights) in enumerate(decided, 1):
        w = np.asarray(weights, dtype=float)
        if not len(w) or not np.isfinite(w).all() or (w <= 0).any() or (before is not None and len(before) != len(w)):
            raise ValueError("weights must be finite and positive, one per dataset")
        shares = (w / w.sum()).tolist()
        picks = np.array(stream.choices(range(len(shares)), weights=shares, k=samples))
        counts = np.bincount(picks, minlength=len(shares))
        order = np.argsort(picks, kind="stable")  # the draws of one dataset side by side, in the order drawn
        places = np.empty(samples, dtype=np.int64)
        places[order] = np.arange(samples) - np.repeat(np.cumsum(counts) - counts, counts)
        base = np.zeros(len(shares), dtype=np.int64) if before is None else before
        before = base + counts
        yield {
            "window_id": n, "first_training_iteration": (n - 1) * iterations + 1, "decision_id": decision_id, "weights": shares,
            "dataset_index": picks.tolist(), "dataset_sample_index": (base[picks] + places).tolist(), "counters_after": before.tolist(),
        }
