"""Reading captured records: prefix scans over the coordinate key."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attempts import accepted_attempts, represented_iterations, require_status, resolve, status_rows, visible
from ..schema import COORDINATES, KEY, TABLES, require_schema
from ..session import exists

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def require_identifier(name: str) -> str:
    """A table or database name that is safe inside SQL text."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"invalid identifier: {name!r}")
    return name


def by_prefix(df: DataFrame, prefix: Sequence) -> DataFrame:
    """Rows whose key starts with the given values; equality filters that reach the scan."""
    if not 0 < len(prefix) <= len(KEY):
        raise ValueError(f"a prefix has 1 to {len(KEY)} values")
    for name, value in zip(KEY, prefix, strict=False):
        df = df.where(F.col(name) == value)
    return df


class TrainingReader:
    """Scans of one base name's four tables.

    ``tables`` maps layout (``raw``, ``raw_scalar_float``, ``raw_scalar_int``,
    ``raw_eval_phase_boundary``) to a DataFrame; missing layouts are simply not readable.
    """

    def __init__(self, tables: dict[str, DataFrame], validate: bool = True) -> None:
        self.tables = {k: require_schema(v, k, extra_ok=True) if validate else v for k, v in tables.items()}

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, base: str = "raw", validate: bool = True) -> TrainingReader:
        """The tables ``{base}...parquet`` of a folder."""
        require_identifier(base)
        found = {}
        for layout in ("raw", "raw_scalar_float", "raw_scalar_int", "raw_eval_phase_boundary"):
            path = f"{folder}/{layout.replace('raw', base, 1)}.parquet"
            if exists(spark, path):
                found[layout] = spark.read.parquet(path)
        return cls(found, validate)

    def ready(self) -> bool:
        """Whether the three payload tables are there."""
        return {"raw", "raw_scalar_float", "raw_scalar_int"} <= set(self.tables)

    def accepted(self) -> DataFrame:
        """Accepted attempts."""
        return accepted_attempts(self.tables["raw_scalar_int"])

    def _scan(self, layout: str, prefix: Sequence, all_attempts: bool, all_invocations: bool, values: list[str]) -> DataFrame:
        rows = by_prefix(self.tables[layout], prefix)
        if not all_attempts:
            ints = self.tables["raw_scalar_int"]
            model = F.col("model_id") == prefix[0]
            require_status(represented_iterations(rows), resolve(status_rows(ints.where(model))))
            rows = visible(rows, accepted_attempts(ints.where(model)), all_invocations=all_invocations)
        elif not all_invocations:
            rows = rows.where("invocation_id = 0")
        return rows.select(*[n for n, _ in COORDINATES], *values).orderBy(*KEY)

    def tensors(self, prefix: Sequence, all_attempts: bool = False, all_invocations: bool = False) -> DataFrame:
        """Tensor rows under a key prefix, in key order."""
        return self._scan("raw", prefix, all_attempts, all_invocations, ["dtype", "shape", "bytes"])

    def raw_tensors(self, prefix: Sequence) -> DataFrame:
        """Tensor rows of all attempts and invocations."""
        return self.tensors(prefix, True, True)

    def scalars(self, prefix: Sequence, kind: str = "float", all_attempts: bool = False, all_invocations: bool = False) -> DataFrame:
        """Scalar rows (kind float or int) under a key prefix, in key order."""
        if kind not in ("float", "int"):
            raise ValueError("scalar kind is float or int")
        return self._scan(f"raw_scalar_{kind}", prefix, all_attempts, all_invocations, ["value"])

    def raw_scalars(self, prefix: Sequence, kind: str = "float") -> DataFrame:
        """Scalar rows of all attempts and invocations."""
        return self.scalars(prefix, kind, True, True)

    def eval_boundaries(self, model_id: str, training_iteration_id: int | None = None, phase: str | None = None, eval_index: int | None = None) -> DataFrame:
        """Entries and exits of evaluation phases."""
        rows = self.tables["raw_eval_phase_boundary"].where(F.col("model_id") == model_id)
        for name, value in (("training_iteration_id", training_iteration_id), ("phase", phase), ("eval_index", eval_index)):
            if value is not None:
                rows = rows.where(F.col(name) == value)
        return rows.orderBy("training_iteration_id", "phase", "eval_index", "next_global_batch_id", "boundary_type")


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page of an ordered table."""
    return df.orderBy(*order).offset(offset).limit(limit)


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A declared table without rows."""
    return spark.createDataFrame([], TABLES[table])
