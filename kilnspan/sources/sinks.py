"""Writing derived tables: one run's rows replace themselves, counts are verified."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checks import DataError, require
from ..schema import TABLES, require_schema
from ..session import exists, remove

RUN = ("model_id", "run_name", "phase")


def conform(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in order, cast to their types; missing columns are an error."""
    fields = TABLES[table].fields
    if missing := [f.name for f in fields if f.name not in df.columns]:
        raise DataError(f"{table}: missing {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fields])


def create_tables(spark: SparkSession, folder: str, tables: Sequence[str], drop: bool = False) -> None:
    """Empty tables where there are none; existing ones must have the declared columns."""
    for t in tables:
        path = f"{folder}/{t}"
        if exists(spark, path) and not drop:
            have = spark.read.parquet(path)
            require_schema(have.select(*[f.name for f in TABLES[t].fields]), t)
        else:
            spark.createDataFrame([], TABLES[t]).write.mode("overwrite").parquet(path)


def replace_run(df: DataFrame, folder: str, table: str, run: Mapping[str, str], rows_per_file: int = 0) -> int:
    """Make df the rows of a run (its model_id, run_name and phase), leaving all other runs; the number of rows, read back and compared.

    Rows of another run are an error.  A run that has no rows any more has none afterwards.
    Rows are written in the order of their keys.
    """
    spark, path = df.sparkSession, f"{folder}/{table}"
    out = conform(df, table)
    mine = reduce(lambda a, b: a & b, [F.col(c) == F.lit(run[c]) for c in RUN])
    require(out, {f"not of the run {dict(run)}": mine}, table)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    remove(spark, "/".join([path, *(f"{c}={escape(run[c])}" for c in RUN)]))
    order = [f.name for f in TABLES[table].fields if f.name not in RUN and not isinstance(f.dataType, (T.DoubleType, T.ArrayType))]
    writer = out.orderBy(*RUN, *order).write.mode("append").partitionBy(*RUN)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    back = spark.read.schema(TABLES[table]).parquet(path).where(mine).count()
    if (n := out.count()) != back:
        raise DataError(f"{table}: wrote {n} rows, read {back}")
    return back
