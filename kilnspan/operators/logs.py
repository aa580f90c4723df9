"""Training logs and run overheads: parsing, timing statistics, paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def log_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of texts."""
    return texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def iteration_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Iteration number, loss, gradient norm and skip count of iteration lines."""
    number = lambda pattern: F.regexp_extract("line", pattern, 1)
    parsed = lines.select(
        key, "line_no",
        F.expr(r"try_cast(regexp_extract(line, '(?i)\\biteration +(\\d+)', 1) as bigint)").alias("iteration"),
        F.expr(r"try_cast(regexp_extract(line, '(?i)\\blm loss: *([0-9.eE+-]+)', 1) as double)").alias("lm_loss"),
        F.expr(r"try_cast(regexp_extract(line, '(?i)\\bgrad norm: *([0-9.eE+-]+)', 1) as double)").alias("grad_norm"),
        F.expr(r"try_cast(regexp_extract(line, '(?i)\\bskipped: *(\\d+)', 1) as int)").alias("skipped"),
        number(r"took=\s*(\d+)ms").alias("took"),
    )
    return parsed.where("iteration is not null and lm_loss is not null").drop("took")


def flush_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rank, rows, bytes and milliseconds of flush lines."""
    get = lambda p, kind: F.expr(f"try_cast(regexp_extract(line, '{p}', 1) as {kind})")
    out = lines.select(
        key, "line_no", get(r"(?i)\\[rank(\\d+)\\]", "int").alias("rank"), get(r"(?i)flush rows=(\\d+)", "bigint").alias("rows"), get(r"(?i)bytes=(\\d+)", "bigint").alias("bytes"), get(r"(?i)took=(\\d+)ms", "bigint").alias("took_ms")
    )
    return out.where("rows is not null and took_ms is not null")


#: Formats of log lines (fixed values).
EVAL_TIMER = r"evaluate\s+\.{3,}:\s+\(([0-9.]+),\s+([0-9.]+)\)"
EVAL_PHASE = r"validation loss at iteration .* on (validation set|test set)"
MEMORY = r"memory \(MB\).*allocated:\s*([0-9.]+).*max allocated:\s*([0-9.]+).*reserved:\s*([0-9.]+).*max reserved:\s*([0-9.]+)"
#: Lines after a timer in which its phase may be named.
PHASE_WITHIN = 7


def eval_timers(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, block, phase, min_ms, max_ms) of evaluations: the phase is the first one named within the next lines, else unknown; blocks count from 0."""
    named = F.regexp_extract("line", EVAL_PHASE, 1)
    phase = F.when(named == "validation set", "valid").when(named == "test set", "test")
    after = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, PHASE_WITHIN)
    number = lambda i: F.regexp_extract("line", EVAL_TIMER, i)
    seen = lines.select(key, "line_no", number(1).alias("a"), number(2).alias("b"), phase.alias("p")).withColumn("next", F.first("p", ignorenulls=True).over(after)).where("a <> ''")
    block = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    return seen.select(key, "line_no", block.alias("block"), F.coalesce("next", F.lit("unknown")).alias("phase"), F.col("a").cast("double").alias("min_ms"), F.col("b").cast("double").alias("max_ms"))


def warmed(timers: DataFrame) -> DataFrame:
    """Evaluations without the first of each log, which warms up."""
    return timers.where("block > 0")


def memory_peaks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, max_allocated_mb, max_reserved_mb) over the memory lines of each log."""
    number = lambda i: F.expr(f"try_cast(regexp_extract(line, '{MEMORY.replace(chr(92), chr(92) * 2)}', {i}) as double)")
    found = lines.select(key, number(2).alias("a"), number(4).alias("r")).where("a is not null")
    return found.groupBy(key).agg(F.max("a").alias("max_allocated_mb"), F.max("r").alias("max_reserved_mb"))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The element at round(fraction (n - 1)) of the sorted values, halves to even (an aggregate; values gather per group)."""
    listed = F.sort_array(F.collect_list(values))
    return F.element_at(listed, F.bround((F.size(listed) - 1) * F.lit(fraction)).cast("int") + 1)


def nearest_rank_grouped(df: DataFrame, by: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """The same for groups of any size: ranks come from counts of distinct values, no list is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    want = F.bround((F.col("n") - 1) * F.lit(fraction)) + 1
    return ranked.where(F.col("upto") >= want).groupBy(*by).agg(F.min(value).alias(name))


def timing_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and nearest-rank p95 of a timing."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("p50"))
    return base.join(nearest_rank_grouped(df, by, value, 0.95, "p95"), by)


def split_flushes(iterations: DataFrame, every: int, warmup: int = 6, value: str = "ms") -> DataFrame:
    """Timing of retained iterations, those on a flush boundary apart from the others."""
    kept = iterations.where(F.col("iteration") >= warmup).withColumn("flush_boundary", F.col("iteration") % every == 0)
    return kept.groupBy("flush_boundary").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def overhead(runs: DataFrame, pair: list[str], repetition: str = "repetition", seconds: str = "seconds") -> DataFrame:
    """Per pair: mean and sample deviation (0 for one repetition) of (on - off) / off over repetitions; ``mode`` is on or off."""
    both = runs.groupBy(*pair, repetition).agg(F.max(F.when(F.col("mode") == "off", F.col(seconds))).alias("off"), F.max(F.when(F.col("mode") == "on", F.col(seconds))).alias("on"))
    ratio = both.where("off is not null and on is not null").withColumn("ratio", F.try_divide(F.col("on") - F.col("off"), F.col("off")))
    return ratio.groupBy(*pair).agg(F.count("ratio").alias("repetitions"), F.avg("ratio").alias("mean_overhead"), F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)).alias("overhead_deviation"))


def throughputs(runs: DataFrame, seq_length: int) -> DataFrame:
    """Add samples and tokens per second to rows with samples and seconds; null where no time was taken."""
    rate = F.try_divide(F.col("samples").cast("double"), F.col("seconds").cast("double"))
    return runs.withColumn("samples_per_second", rate).withColumn("tokens_per_second", rate * seq_length)


def throughput(global_batch: int, iterations: int, seq_length: int, seconds: float) -> dict[str, float]:
    """Samples and tokens per second."""
    samples = global_batch * iterations
    return {"samples_per_second": samples / seconds, "tokens_per_second": samples * seq_length / seconds}


def write_summary(rows: DataFrame, folder: str, order: list[str]) -> str:
    """A benchmark's rows as JSON lines in order (one file: a row per case and repetition), and as the Markdown table that is returned."""
    ordered = rows.orderBy(*order)
    ordered.coalesce(1).write.mode("overwrite").json(folder)
    return markdown_table([r.asDict() for r in ordered.limit(1000).collect()])


def markdown_table(rows: list[dict]) -> str:
    """Rows of a small result as a Markdown table."""
    if not rows:
        return ""
    head = list(rows[0])
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(show(r[h]) for h in head) + " |" for r in rows)])
