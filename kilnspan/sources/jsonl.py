"""JSON lines: scans that keep file and line, and ordered exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checks import require_empty
from ..session import cut, matching, small_side

MESSAGES = "struct<messages:array<struct<role:string,content:string>>>"


def input_paths(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Files of patterns, sorted, each once, wherever the session keeps files; a pattern that matches nothing is an error."""
    found: set[str] = set()
    for p in patterns:
        hits = matching(spark, p)
        if not hits:
            raise FileNotFoundError(p)
        found.update(hits)
    return sorted(found)


def read_lines(spark: SparkSession, paths: Sequence[str], schema: str = MESSAGES, strict: bool = True) -> DataFrame:
    """(file, line, record): line numbers from 1; blank or malformed lines are errors if strict.

    Files are read in blocks.  Rows of a block have neighbouring numbers in their task, so a
    line's number is its place after the block's first row plus the lines of the blocks
    before it: one small table of blocks, and no file is one task's work.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    blocks = cut(lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    placed = lines.join(small_side(cut(blocks)), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")
    if strict:
        require_empty(placed.where(F.trim("text") == "").select("file", "line"), "blank line")
    out = placed.select("file", "line", F.from_json("text", schema).alias("record"))
    if strict:
        require_empty(out.where("record is null").select("file", "line"), "malformed line")
    return out


def export(df: DataFrame, path: str, order: Sequence[str], rows_per_file: int = 50_000) -> None:
    """Rows in order as JSON lines; binary columns as base64."""
    coded = df.select(*[F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])
    coded.orderBy(*order).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)
