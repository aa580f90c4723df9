"""Conversations: segmentation at system messages, padded ranges, and bounds over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def conversation_starts(roles: Column) -> Column:
    """Positions (from 0) in an array of roles at which a conversation starts: the first, and every system message."""
    return F.filter(F.transform(roles, lambda r, i: F.when((r == "system") | (i == 0), i)), lambda x: x.isNotNull())


def count_conversations(roles: Column) -> Column:
    """Number of conversations in an array of roles."""
    return F.size(conversation_starts(roles))


def split_conversations(messages: Column) -> Column:
    """An array of messages (with ``role``) as an array of conversations."""
    starts = conversation_starts(F.transform(messages, lambda m: m["role"]))
    bounds = F.transform(starts, lambda s, i: F.struct(s.alias("a"), F.coalesce(F.get(starts, i + 1), F.size(messages)).alias("b")))
    return F.transform(bounds, lambda x: F.slice(messages, x["a"] + 1, x["b"] - x["a"]))


def segment_rows(turns: DataFrame, by: Sequence[str], order: Sequence[str], role: str = "role") -> DataFrame:
    """Rows of turns with ``segment``: 0 before the first system message, one more at each."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("segment", F.sum(F.when(F.col(role) == "system", 1).otherwise(0)).over(upto))


def padded_ranges(ranges: Column, capacity: int) -> Column:
    """Struct(starts, ends) of fixed length; trailing entries are empty and lie at the last end.  Too many, unordered or overlapping ranges are an error."""
    last = F.coalesce(F.get(ranges, F.size(ranges) - 1)["end"], F.lit(0))
    ordered = F.forall(F.transform(ranges, lambda r, i: (r["start"] >= F.coalesce(F.get(ranges, i - 1)["end"], F.lit(0))) & (r["end"] >= r["start"])), lambda ok: ok)
    pad = F.array_repeat(last, capacity - F.size(ranges))
    made = F.struct(F.concat(F.transform(ranges, lambda r: r["start"]), pad).alias("starts"), F.concat(F.transform(ranges, lambda r: r["end"]), pad).alias("ends"))
    return F.when((F.size(ranges) <= capacity) & ordered, made).otherwise(F.raise_error("ranges exceed the capacity, overlap or are out of order").cast("struct<starts:array<int>,ends:array<int>>"))


def active_lengths(starts: Column, ends: Column) -> Column:
    """Positive lengths of padded ranges; active ones must come first and not overlap."""
    lengths = F.zip_with(starts, ends, lambda a, b: b - a)
    active = F.filter(lengths, lambda n: n > 0)
    ok = (F.size(starts) == F.size(ends)) & F.forall(lengths, lambda n: n >= 0) & (F.slice(lengths, F.lit(1), F.size(active)) == active)
    apart = F.forall(F.transform(starts, lambda a, i: a >= F.coalesce(F.get(ends, i - 1), F.lit(0))), lambda x: x)
    return F.when(ok & apart, active).otherwise(F.raise_error("invalid segments").cast("array<int>"))


def conversation_bound(rows: DataFrame, file: str = "file", line: str = "line", roles: str = "roles") -> DataFrame:
    """Per file: rows, conversations at most, and the first line that has them; and the same over all files (file null)."""
    counted = rows.select(file, line, count_conversations(F.col(roles)).alias("n"))
    best = lambda *order: F.max_by(F.col(line), F.struct("n", *order))
    per = counted.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("max_conversations"), best((-F.col(line)).alias("o")).alias("first_line"))
    first = F.min(F.struct((-F.col("max_conversations")).alias("m"), F.col(file).alias("f"), F.col("first_line").alias("l")))
    whole = per.agg(F.sum("rows").alias("rows"), first.alias("x")).select(F.lit(None).cast("string").alias(file), "rows", (-F.col("x.m")).alias("max_conversations"), F.col("x.l").alias("first_line"), F.col("x.f").alias("first_file"))
    return per.withColumn("first_file", F.col(file)).unionByName(whole)


def chat_turns(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Turns of texts in the form ``role: content`` per line: (key, turn, role, content)."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("turn", "l"))
    role = F.regexp_extract("l", r"^(system|user|assistant): ", 1)
    return lines.withColumn("role", role).where("role <> ''").select(key, "turn", "role", F.expr("substring(l, length(role) + 3)").alias("content"))
