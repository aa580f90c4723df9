"""References to records that do not exist.

References and parent keys are co-partitioned and sorted by key and merged linearly (a
sort-merge join that is asked for by hint), each key once on either side: references are
reduced to their keys before the shuffle, so a key that holds a third of all rows moves
as one row per task, and parents are reduced to their validity.  The merge tells apart

* ``missing``: no parent was ever there,
* ``deleted``: parents were there, and none is valid at the reference's time,
* ``late``: no parent is valid at the reference's time, but one is later (met, and only reported).

Only keys that some reference may violate go back to the rows, by a broadcast join while
their counted number is within a bound and by a shuffled, skew-split join beyond it.

Defined results: a null in a reference's key matches no parent, so the reference leads
nowhere; a null time is before every removal; empty tables give empty results or, on the
parents' side, all references; repeated rows and parents count each, or once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import same_name
from ..session import cut, small_side

STATUS = "iteration_attempt_status"
_NEVER, _ALWAYS = -(1 << 63), (1 << 63) - 1


def parent_validity(parents: DataFrame, keys: Sequence[str], since: Column, until: Column) -> DataFrame:
    """One row per parent key: the spells in which some parent is valid, and until when the last one is (``until`` null: no end).

    Spells are disjoint and in order; parents that overlap or touch are one.  Of parents that
    end together the one that begins first stands for all, so a key with many parents is
    thin before its spells are put in order.  A null ``since`` is before every time, and a
    spell that ends before all times (a deleted parent) is none.
    """
    ends = parents.groupBy(*keys, F.coalesce(until, F.lit(_ALWAYS)).alias("__until")).agg(F.min(F.coalesce(since, F.lit(_NEVER))).alias("__since"))
    order = Window.partitionBy(*keys).orderBy("__since", "__until")
    reach = F.max("__until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ends.withColumn("__new", F.coalesce((F.col("__since") > reach).cast("int"), F.lit(0))).withColumn("__spell", F.sum("__new").over(order))
    spells = islands.groupBy(*keys, "__spell").agg(F.min("__since").alias("since"), F.max("__until").alias("until"))
    real = F.when(F.col("until") > F.col("since"), F.struct("since", "until"))
    return spells.groupBy(*keys).agg(F.array_sort(F.collect_list(real)).alias("spells"), F.max("until").alias("valid_until"))


def merge_keys(refs: DataFrame, parents: DataFrame, keys: Sequence[str], at: str = "at", within: Sequence[str] = ()) -> DataFrame:
    """The linear merge: each key referred to (within each value of further columns), with the span of its references and its parent's validity."""
    referred = refs.groupBy(*keys, *within).agg(F.count(F.lit(1)).alias("refs"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return referred.hint("merge").join(parents.hint("merge"), list(keys), "left")


def state(at: Column) -> Column:
    """What a reference at a time leads to, given its key's validity: a parent valid then, one that becomes valid later, or only ones that no longer are."""
    return (
        F.when(F.col("valid_until").isNull(), "missing")
        .when(F.coalesce(at >= F.col("valid_until"), F.col("valid_until") == _NEVER), "deleted")
        .when(at.isNull() | F.exists("spells", lambda s: (s["since"] <= at) & (at < s["until"])), "met")
        .otherwise("late")
    )


def dangling(refs: DataFrame, parents: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """The references that lead nowhere, with ``reason`` (missing or deleted); refs' other columns stay."""
    merged = merge_keys(refs.select(*keys, at), parents, keys, at)
    broken = F.col("valid_until").isNull() | (F.col("valid_until") == _NEVER) | (F.col("last_at") >= F.col("valid_until"))
    suspects = small_side(cut(merged.where(broken).select(*[F.col(k).alias(f"__{k}") for k in keys], "spells", "valid_until")))
    on = F.lit(True)
    for k in keys:
        on = on & refs[k].eqNullSafe(F.col(f"__{k}"))
    judged = refs.join(suspects, on).withColumn("reason", state(F.col(at)))
    return judged.where(F.col("reason").isin("missing", "deleted")).select(*refs.columns, "reason")


# ---------------------------------------------------------------- the telemetry tables


def attempt_references(rows: DataFrame) -> DataFrame:
    """Training rows' references to their attempt's status row."""
    makes = (F.col("phase") == "train") & ~F.col("global_batch_id").eqNullSafe(F.lit(0)) & F.col("attempt_id").isNotNull()
    return rows.where(makes & ~same_name("act_name").eqNullSafe(F.lit(STATUS))).select(
        "row_id", same_name("model_id").alias("model"), "global_batch_id", "attempt_id", F.col("received_unix_ns").alias("at")
    )


def attempt_parents(ints: DataFrame) -> DataFrame:
    """Validity of attempts: live status rows, whenever received; a deleted one never was."""
    status = ints.where(
        (F.col("direction") == "iter") & (F.col("phase") == "train") & (F.col("invocation_id") == 0) & (F.col("dataset_id") == -1) & (same_name("act_name") == STATUS)
    ).select(same_name("model_id").alias("model"), "global_batch_id", "attempt_id", "received_unix_ns", "deleted_unix_ns")
    until = F.when(F.col("deleted_unix_ns").isNotNull(), F.lit(_NEVER))
    return parent_validity(status, ["model", "global_batch_id", "attempt_id"], F.when(F.col("deleted_unix_ns").isNull(), F.col("received_unix_ns")), until)


def name_references(rows: DataFrame) -> DataFrame:
    """Every row's reference to the catalogue."""
    return rows.select("row_id", same_name("act_name").alias("name"), F.col("received_unix_ns").alias("at"))


def name_parents(catalog: DataFrame) -> DataFrame:
    """Validity of names: until removed; a name added later meets earlier rows too."""
    return parent_validity(catalog.select(same_name("act_name").alias("name"), "added_unix_ns", "removed_unix_ns"), ["name"], F.col("added_unix_ns"), F.col("removed_unix_ns"))


def telemetry_references(floats: DataFrame, ints: DataFrame, catalog: DataFrame):
    """(ref, references tagged with src_table, parents, keys) of both kinds of reference."""
    tables = (("raw_scalar_float", floats), ("raw_scalar_int", ints))
    tag = lambda make: make(tables[0][1]).withColumn("src_table", F.lit(tables[0][0])).unionByName(make(tables[1][1]).withColumn("src_table", F.lit(tables[1][0])))
    yield "attempt", tag(attempt_references), attempt_parents(ints), ["model", "global_batch_id", "attempt_id"]
    yield "act_name", tag(name_references), name_parents(catalog), ["name"]


def telemetry_orphans(floats: DataFrame, ints: DataFrame, catalog: DataFrame) -> DataFrame:
    """(src_table, row_id, ref, reason, at) of every reference that leads nowhere."""
    found = [
        dangling(refs, parents, keys).select("src_table", "row_id", F.lit(ref).alias("ref"), "reason", "at")
        for ref, refs, parents, keys in telemetry_references(floats, ints, catalog)
    ]
    return found[0].unionByName(found[1])


def day_of(at: Column) -> Column:
    """UTC day of an instant in nanoseconds."""
    return F.timestamp_seconds(F.floor(at / 1_000_000_000)).cast("date")


def orphans_by_day(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, kind, reason and UTC day of receipt."""
    return orphans.groupBy("src_table", "ref", "reason", day_of(F.col("at")).alias("day")).agg(F.count(F.lit(1)).alias("references"))


def states(refs: DataFrame, parents: DataFrame, keys: Sequence[str], within: Sequence[str], at: str = "at") -> DataFrame:
    """Number of references per key, further columns (which must tell null times from others) and state, each judged at its own time.

    A key of one spell only ever goes from late by way of met to deleted, so its references are
    all in one state if the first and last are; the others go back to the rows.
    """
    rows = refs.select(*keys, *within, at)
    merged = cut(merge_keys(rows, parents, keys, at, within))
    first, last = state(F.col("first_at")), state(F.col("last_at"))
    plain = (first == last) & ((F.coalesce(F.size("spells"), F.lit(0)) < 2) | F.col("last_at").isNull())
    whole = merged.where(plain).select(*keys, *within, last.alias("state"), "refs")
    mixed = small_side(cut(merged.where(~plain).select(*keys, *within, "spells", "valid_until")))
    own = rows.join(mixed, [*keys, *within]).groupBy(*keys, *within, state(F.col(at)).alias("state"))
    return whole.unionByName(own.agg(F.count(F.lit(1)).alias("refs")))


def reference_states(floats: DataFrame, ints: DataFrame, catalog: DataFrame) -> DataFrame:
    """Number of references per table, kind, UTC day of receipt and state at their own time (met, late, deleted, missing), and of the keys that have such."""
    within = ["src_table", "day"]
    parts = [
        states(refs.withColumn("day", day_of(F.col("at"))), parents, keys, within).select(*within, F.lit(ref).alias("ref"), "state", "refs")
        for ref, refs, parents, keys in telemetry_references(floats, ints, catalog)
    ]
    return parts[0].unionByName(parts[1]).groupBy("src_table", "ref", "state", "day").agg(F.count(F.lit(1)).alias("keys"), F.sum("refs").alias("references"))
