"""Session helpers: where lineage is cut and state is kept, and when a side may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default bounds of a side that is broadcast, in rows and in bytes of its values, both counted before.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a new folder of its own; on a cluster that is an error,
    as a folder of one machine is none of the others'.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kilnspan-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, with no lineage behind them."""
    shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table of the shared folder, in columns: for what is passed over several times.

    Like the folders of views and stores it stays until :func:`clear`, as results that are not yet computed may read it.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Remove the tables, views, stores and stream states that queries have left in the shared folder."""
    for kind in ("table", "views", "seen", "stream"):
        for at in matching(spark, f"{shared_folder(spark)}/{kind}-*"):
            remove(spark, at)


def _bytes(field: T.StructField):
    """Size of a column's values: what they hold if of varying length, else their type's width."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0)) + 32
    return F.lit(16)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast if it has at most so many rows and bytes; otherwise leave it to a shuffled, skew-split join.

    ``df`` should be cheap to read (a cut table): at most ``rows + 1`` rows are looked at.
    """
    each = sum((_bytes(f) for f in df.schema.fields), F.lit(0)).cast("bigint")
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= rows and seen["b"] <= size else df


# ---------------------------------------------------------------- files, wherever the session keeps them


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system it names (not of the driver's disk)."""
    files, at = _path(spark, path)
    return files.exists(at)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches, sorted."""
    files, at = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in (files.globStatus(at) or []))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with all it holds; no error where it is not there."""
    files, at = _path(spark, path)
    files.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a path to a name that is free, in one step of the file system."""
    files, at = _path(spark, path)
    if not files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be moved to {to}")
