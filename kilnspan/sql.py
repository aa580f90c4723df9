"""SQL surface: telemetry views and functions in a session's catalogue."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from .functions.arrays import decode_tensor, token_levenshtein
from .functions.names import same_name  # noqa: F401
from .sources.records import require_identifier


def register(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """A view for every table in a folder, and the functions decode_tensor and token_levenshtein; the views' names."""
    names = []
    for path in sorted(Path(folder).glob("*.parquet")):
        name = require_identifier(prefix + path.stem)
        spark.read.parquet(str(path)).createOrReplaceTempView(name)
        names.append(name)
    spark.udf.register("decode_tensor", decode_tensor)
    spark.udf.register("token_levenshtein", token_levenshtein)
    return names
