"""Filling fixed-capacity containers: first-fit decreasing on a tournament tree.

Items are packed in randomised groups: an item's group is a hash of its key and of its
number among its copies, so a source of any size falls into groups of about
``group_items`` items, and neither a source nor a key that makes up a third of all
documents is one group's work.  Each group is packed on its own by
first-fit decreasing.  A tournament tree over the open bins holds at each node the
largest room below it, so the first bin with room is found in O(log bins).

Only an item larger than the capacity is split: into full containers and one remainder,
which is packed like an item.  Items of size 0 (null and empty texts) take no container
and do not come out.  An item whose source has no capacity (or a capacity below 1) comes
out with a null container.  Repeated keys are separate items.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import TOKENIZERS, size_column

#: Items per group, on average.  A group costs at most about one badly filled container.
GROUP_ITEMS = 20_000
#: Most rows of the container table: it is one row per source, broadcast and checked.
MAX_SOURCES = 100_000


class RoomTree:
    """A tournament tree: bins in order of opening, at each node the largest room below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put a size into the first bin with room for it; the bin's number, or -1."""
        room, node = self.room, 1
        if room[1] < size:
            return -1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        bin_no = node - self.leaves
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            largest = left if left >= right else right
            if room[node] == largest:
                break
            room[node] = largest
        return bin_no


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (all of them at most the capacity), numbered from 0."""
    tree = RoomTree(len(sizes), capacity)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i] = tree.place(sizes[i])
    return bins


_OUT = "source string, container_id string, doc_id {key}, piece int, tokens bigint, capacity int"


def _pack_group(group: pd.DataFrame) -> pd.DataFrame:
    """Pack one group of one source."""
    source, part, capacity = group["__source"].iloc[0], group["__group"].iloc[0], group["__capacity"].iloc[0]
    group = group[group["__size"] > 0].sort_values(["__key", "__size"], kind="stable")  # here, as a filter above would encode twice
    keys, sizes = group["__key"].tolist(), [int(s) for s in group["__size"]]
    if pd.isna(capacity) or capacity < 1:
        return pd.DataFrame({"source": source, "container_id": None, "doc_id": keys, "piece": 0, "tokens": sizes, "capacity": None if pd.isna(capacity) else capacity})
    capacity = int(capacity)
    whole, rest = [], []
    for key, size in zip(keys, sizes, strict=True):
        full, left = divmod(size, capacity) if size > capacity else (0, size)
        whole += [(key, n, capacity) for n in range(full)]
        if left:
            rest.append((key, full, left))
    bins = first_fit_decreasing([size for *_, size in rest], capacity)
    used = max(bins, default=-1) + 1
    rows = [(source, f"{source}/{part}/{b}", *item, capacity) for b, item in zip(bins, rest, strict=True)]
    rows += [(source, f"{source}/{part}/{used + n}", *item, capacity) for n, item in enumerate(whole)]
    return pd.DataFrame(rows, columns=["source", "container_id", "doc_id", "piece", "tokens", "capacity"])


def pack(items: DataFrame, containers: DataFrame, counts: DataFrame, key: str, size: str, source: str = "source", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Assign items (key, source, size) to containers of their source's capacity.

    ``counts`` holds (source, items), an estimate that only sets the number of groups, also
    of the sources that have no capacity.  Two shuffles, of key, source and size alone: one
    counts copies, combined before it, the other brings groups together.  Columns out: source, container_id,
    doc_id (the key), piece, tokens, capacity.
    """
    if containers.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    bounds = containers.groupBy(F.col("source").alias("__source")).agg(F.min("capacity").cast("int").alias("__capacity"))
    sized = cut(counts.select(F.col("source").alias("__source"), "items"))
    loose = sized.join(F.broadcast(bounds.select("__source")), "__source", "left_anti").agg(F.sum("items")).first()[0] or 0
    bounds = bounds.join(F.broadcast(sized.join(F.broadcast(bounds.select("__source")), "__source", "left_semi")), "__source", "left")
    groups = F.greatest(F.lit(1), F.ceil(F.coalesce("items", F.lit(1)) / F.lit(group_items))).cast("int")
    bounds = bounds.select("__source", "__capacity", groups.alias("__groups"))
    narrow = items.select(F.col(source).alias("__source"), F.col(key).alias("__key"), F.col(size).cast("bigint").alias("__size"))
    copies = narrow.groupBy("__source", "__key", "__size").agg(F.count(F.lit(1)).alias("__n"))
    apart = copies.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    salt = F.pmod(F.xxhash64("__key", "__nth", F.lit(7)), F.coalesce("__groups", F.lit(-(-int(loose) // group_items) or 1)))
    salted = apart.join(F.broadcast(bounds), "__source", "left").withColumn("__group", salt.cast("int")).drop("__nth")
    kind = dict(items.dtypes)[key]
    return salted.drop("__groups").groupBy("__source", "__group").applyInPandas(_pack_group, _OUT.format(key=kind))


def pack_documents(docs: DataFrame, containers: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pack documents by their size in tokens; each text is encoded once, whole."""
    texts = docs.where("text is not null and text <> ''")
    counts = texts.groupBy("source").agg(F.count(F.lit(1)).alias("items"))
    items = texts.select("doc_id", "source", size_column("text", name, folder).alias("size"))
    return pack(items, containers, counts, "doc_id", "size", group_items=group_items)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per source: containers, tokens, share of the room that is used, and the fewest containers that could do."""
    per = packed.groupBy("source").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    return per.select(
        "source",
        "containers",
        "tokens",
        F.expr("try_divide(tokens, containers * capacity)").alias("fill"),
        F.expr("cast(ceil(try_divide(tokens, capacity)) as bigint)").alias("fewest_containers"),
    )
