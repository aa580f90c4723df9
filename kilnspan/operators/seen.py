"""Messages delivered more than once: exact ids, sharded seen-bitmaps, one arrival per unseen bit.

1. *Encode.*  The names of a message's key are dictionary-encoded exactly (equal names get
   one code; the dictionary only ever grows), its numbers are packed by their ranges.
   The result is an exact id of a few 62-bit words; no hashing, no false positives.
2. *Thin out.*  Within stretches of each input partition all but the first arrival of an
   id are set aside at once, so a message that makes up a third of all rows reaches its
   shard as one row per stretch.
3. *Select.*  Ids are spread over shards by a hash of their container.  A shard's
   seen-bitmap consists of containers of 2^16 bits, stored as a sorted list or as a bitmap, whichever is shorter.
   Of the arrivals of an unseen bit the one with the smallest order (row_id) stays.
4. *Union.*  New bits are joined to the stored containers; a new version of the state is
   published in one step once it is written whole, so a batch counts fully or not at all.

Defined results: nulls agree with nulls in any key column, but for the columns of
``null_is`` where null stands for a value; a null order comes last; rows with the same
order and key are repeats of one another; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import same_name
from ..session import cut, exists, remove, rename, shared_folder, small_side

WORD_BITS, LOW_BITS = 62, 16
#: Rows of a stretch within which repeats are set aside, and rows for which a shard is made.
STRETCH, SHARD_ROWS = 262_144, 100_000
_LAST = (1 << 63) - 1

MESSAGE_NAMES = ("model_id", "act_name", "direction", "phase")
#: Numbers of the key, slowly varying first, so that a container's bits lie close together.
MESSAGE_NUMBERS = ("global_batch_id", "attempt_id", "invocation_id", "shard_rank", "token_start", "token_end", "dp_rank", "microbatch_id", "sample_index", "layer_no")


@dataclass(frozen=True)
class Layout:
    """Where each number lies in the id: (name, least value, bits); 0 stands for null."""

    fields: tuple[tuple[str, int, int], ...]

    @staticmethod
    def of(df: DataFrame, numbers: Sequence[str], old: Layout | None = None) -> Layout:
        """A layout that holds all values of df (and of an older layout)."""
        return Layout.counted(df, numbers, old)[0]

    @staticmethod
    def counted(df: DataFrame, numbers: Sequence[str], old: Layout | None = None) -> tuple[Layout, int]:
        """The same with the number of df's rows, in one pass."""
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in numbers for f in (F.min, F.max)]).first()
        known = {name: (low, low + (1 << bits) - 2) for name, low, bits in old.fields} if old else {}
        fields = []
        for c in numbers:
            lows = [x for x in (row[f"min_{c}"], known.get(c, (None,))[0]) if x is not None]
            highs = [x for x in (row[f"max_{c}"], known.get(c, (None, None))[1]) if x is not None]
            low, high = min(lows, default=0), max(highs, default=0)
            fields.append((c, low, (high - low + 1).bit_length()))
        return Layout(tuple(fields)), row["rows"]

    def words(self) -> list[list[tuple[str, int, int, int]]]:
        """The fields of each word with their shift; the last word holds the last fields."""
        out: list[list[tuple[str, int, int, int]]] = [[]]
        used = 0
        for name, low, bits in reversed(self.fields):
            if used + bits > WORD_BITS and out[0]:
                out.insert(0, [])
                used = 0
            out[0].append((name, low, bits, used))
            used += bits
        return out

    def pack(self) -> list[Column]:
        """The words as columns w1, w2 ... (a number of over 62 bits has a word of its own, unpacked)."""
        columns = []
        for n, word in enumerate(self.words(), 1):
            if len(word) == 1 and word[0][2] > WORD_BITS:
                columns.append(F.coalesce(F.col(word[0][0]).cast("bigint"), F.lit(-(1 << 63))).alias(f"w{n}"))
                continue
            parts = [F.shiftleft(F.coalesce(F.col(name).cast("bigint") - F.lit(low).cast("bigint") + 1, F.lit(0).cast("bigint")), shift) for name, low, _, shift in word]
            columns.append(reduce(lambda a, b: a.bitwiseOR(b), parts).alias(f"w{n}"))
        return columns

    def unpack(self) -> list[Column]:
        """The numbers again, from w1, w2 ..."""
        columns = []
        for n, word in enumerate(self.words(), 1):
            for name, low, bits, shift in word:
                if bits > WORD_BITS:
                    columns.append(F.when(F.col(f"w{n}") != -(1 << 63), F.col(f"w{n}")).alias(name))
                    continue
                code = F.shiftright(f"w{n}", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
                columns.append(F.when(code > 0, code + F.lit(low - 1).cast("bigint")).alias(name))
        return columns


def grow_dictionary(rows: DataFrame, names: Sequence[str], old: DataFrame | None = None) -> DataFrame:
    """(names, code): a code for every combination of names; old codes stay as they are."""
    new = rows.select(*names).distinct()
    base = 0
    if old is not None:
        same = reduce(lambda a, b: a & b, [new[c].eqNullSafe(old[c]) for c in names])
        new = new.join(old, same, "left_anti")
        base = 1 + (old.agg(F.max("code")).first()[0] or 0)
    lanes = 64  # numbered lane by lane, so that no task holds the whole dictionary
    lane = new.withColumn("lane", F.pmod(F.xxhash64(*names), F.lit(lanes)))
    number = F.row_number().over(Window.partitionBy("lane").orderBy(*names)).cast("bigint") - 1
    coded = lane.select(*names, (number * lanes + F.col("lane") + base).alias("code"))
    return cut(coded if old is None else old.select(*names, "code").unionByName(coded))


def encode(rows: DataFrame, names: Sequence[str], dictionary: DataFrame, layout: Layout, order: str) -> DataFrame:
    """(w0, w1 ..., ord): the exact id of each row, and its order."""
    side = small_side(dictionary.select(*[F.col(c).alias(f"__{c}") for c in names], F.col("code").alias("w0")))
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(side[f"__{c}"]) for c in names])
    return rows.join(side, same).select("w0", *layout.pack(), F.coalesce(F.col(order).cast("bigint"), F.lit(_LAST)).alias("ord"))


def _firsts(ids: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted places of rows, and which of them come first within their id."""
    places = np.lexsort([order, *ids[::-1]])
    first = np.ones(len(places), dtype=bool)
    if len(places) > 1:
        first[1:] = np.any([w[places][1:] != w[places][:-1] for w in ids], axis=0)
    return places, first


def thin_out(ids: DataFrame, words: Sequence[str], shards: int) -> DataFrame:
    """Mark as repeats all but the first arrival of an id within each stretch of a partition.

    Adds ``again`` and ``shard``: the shard of the id's container (at most 2^16 ids), or
    for a row already known to be a repeat any shard, so that these are spread evenly.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            stretch = pd.concat(held, ignore_index=True)
            held.clear()
            places, first = _firsts([stretch[w].to_numpy() for w in words], stretch["ord"].to_numpy())
            again = np.zeros(len(stretch), dtype=bool)
            again[places] = ~first
            return stretch.assign(again=again)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= STRETCH:
                yield flush()
        if held:
            yield flush()

    schema = ", ".join(f"{c} bigint" for c in [*words, "ord"]) + ", again boolean"
    marked = ids.mapInPandas(mark, schema)
    home = F.when(F.col("again"), F.xxhash64("ord")).otherwise(F.xxhash64(*words[:-1], F.shiftright(words[-1], LOW_BITS)))
    return marked.withColumn("shard", F.pmod(home, F.lit(shards)).cast("int"))


# ---------------------------------------------------------------- containers


def pack_bits(bits: np.ndarray) -> bytes:
    """Sorted distinct bits of 0 ... 65535 as a container: a list up to 4096 of them, else a bitmap."""
    if len(bits) <= 4096:
        return b"l" + bits.astype("<u2").tobytes()
    flags = np.zeros(1 << LOW_BITS, dtype=np.uint8)
    flags[bits] = 1
    return b"b" + np.packbits(flags, bitorder="little").tobytes()


def unpack_bits(container: bytes) -> np.ndarray:
    """The bits of a container, sorted."""
    body = np.frombuffer(container, dtype=np.uint8, offset=1)
    if container[:1] == b"l":
        return body.view("<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(body, bitorder="little"))


def select_arrivals(arrivals: pd.DataFrame, words: Sequence[str], stored: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """For one shard: which arrivals are repeats, and the containers that have new bits, united with the stored ones.

    Arrivals are laid out by container, bit and order; of each bit that the container does
    not hold yet, the first is selected, and the bit is set.
    """
    again = arrivals["again"].to_numpy().copy()
    rest = np.flatnonzero(~again)
    ids = [arrivals[w].to_numpy()[rest] for w in words]
    places, first = _firsts(ids, arrivals["ord"].to_numpy()[rest])
    again[rest[places[~first]]] = True
    unique = places[first]
    high = [*(w[unique] for w in ids[:-1]), ids[-1][unique] >> LOW_BITS]
    low = ids[-1][unique] & ((1 << LOW_BITS) - 1)
    starts = np.ones(len(unique), dtype=bool)
    if len(unique) > 1:
        starts[1:] = np.any([h[1:] != h[:-1] for h in high], axis=0)
    known = {tuple(r[:-1]): r[-1] for r in stored[[*words, "bits"]].itertuples(index=False, name=None)}
    containers = []
    bounds = [*np.flatnonzero(starts).tolist(), len(unique)]
    keys = list(zip(*(h[starts].tolist() for h in high), strict=True))
    for container, a, b in zip(keys, bounds, bounds[1:], strict=False):
        bits = low[a:b]
        if container in known:
            old = unpack_bits(known[container])
            fresh = ~np.isin(bits, old, assume_unique=True)
            again[rest[unique[a:b][~fresh]]] = True
            if not fresh.any():
                continue
            bits = np.union1d(old, bits[fresh])
        containers.append((*container, pack_bits(bits)))
    return again, containers


# ---------------------------------------------------------------- messages


def message_rows(df: DataFrame) -> DataFrame:
    """The key of a telemetry message: names in their comparable form, a null microbatch as -1."""
    names = [same_name(c).alias(c) if c in ("model_id", "act_name") else F.col(c) for c in MESSAGE_NAMES]
    numbers = [F.coalesce(c, F.lit(-1)).alias(c) if c == "microbatch_id" else F.col(c) for c in MESSAGE_NUMBERS]
    return df.select("row_id", *names, *numbers)


def repeats(rows: DataFrame, names: Sequence[str] = MESSAGE_NAMES, numbers: Sequence[str] = MESSAGE_NUMBERS, order: str = "row_id") -> DataFrame:
    """(order): every row but the first of its message, for a table taken as the first batch of a new store."""
    return SeenStore(rows.sparkSession, None, names, numbers, order).take(rows, 0, repeats=True)


# ---------------------------------------------------------------- many batches

_TAKEN = "step bigint, number bigint, at string, whole boolean, ids bigint, repeats boolean"
#: Batches after which the state is written whole, and ids that count as one row when shards are made (they are stored as bits).
COMPACT_AFTER, CONTAINED = 8, 16


def latest(containers: DataFrame, words: Sequence[str]) -> DataFrame:
    """Of each container what was written last."""
    return containers.groupBy(*words).agg(F.max_by("bits", "step").alias("bits"))


class SeenStore:
    """Seen-bitmaps that live in a folder and take batch after batch, in any order of their numbers.

    A batch writes its dictionary, layout, the containers that it changed and the orders
    it kept, and is published by one small row at the end: a batch that fails before that
    leaves the state as it was.  A batch that is offered again under its number changes
    nothing and gives the rows it gave, so whatever writes them may be repeated too.

    Only changed containers are written; the latest of each holds.  After COMPACT_AFTER
    batches the state is written whole and what it replaces is removed (the folders that
    the version before still reads stay until the next time).  The number of shards
    follows the number of ids that are stored and arrive.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, names: Sequence[str] = MESSAGE_NAMES, numbers: Sequence[str] = MESSAGE_NUMBERS, order: str = "row_id", shards: int | None = None) -> None:
        self.spark, self.names, self.numbers, self.order, self.shards = spark, list(names), list(numbers), order, shards
        self.folder = folder or f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"

    def _published(self) -> list:
        """The batches taken, in the order they were; one small row each."""
        if not exists(self.spark, f"{self.folder}/published"):
            return []
        return self.spark.read.schema(_TAKEN).parquet(f"{self.folder}/published").orderBy("step").collect()

    @property
    def taken(self) -> list[int]:
        """The numbers of the batches taken."""
        return [r["number"] for r in self._published()]

    def _load(self, taken: list):
        """Layout, dictionary and the written containers (with their step) of the state in force."""
        at = f"{self.folder}/{taken[-1]['at']}"
        fields = self.spark.read.parquet(f"{at}/layout").orderBy("place").collect()
        layout = Layout(tuple((r["name"], r["low"], r["bits"]) for r in fields))
        since = max((n for n, r in enumerate(taken) if r["whole"]), default=0)
        bits = self.spark.read.parquet(*[f"{self.folder}/{r['at']}/bits" for r in taken[since:]])
        return layout, self.spark.read.parquet(f"{at}/names"), bits

    def take(self, rows: DataFrame, number: int, repeats: bool = False) -> DataFrame:
        """Add a batch; the orders of the rows that stay (first deliveries), or of the repeats."""
        taken = self._published()
        told = next((r for r in taken if r["number"] == number), None)
        if told is None:
            told = self._add(rows, number, taken, repeats)
        elif told["repeats"] != repeats:
            raise ValueError(f"batch {number} was taken for its {'repeats' if told['repeats'] else 'first deliveries'}")
        orders = self.spark.read.schema("ord bigint").parquet(f"{self.folder}/{told['at']}/orders")
        return orders.select(F.when(F.col("ord") != _LAST, F.col("ord")).alias(self.order))

    def _add(self, rows: DataFrame, number: int, taken: list, repeats: bool) -> dict:
        step, known = len(taken), taken[-1]["ids"] if taken else 0
        at = f"{self.folder}/batch-{step}-{uuid.uuid4().hex[:8]}"
        old_layout, old_names, stored = self._load(taken) if taken else (None, None, None)
        layout, arriving = Layout.counted(rows, self.numbers, old_layout)
        dictionary = grow_dictionary(rows, self.names, old_names)
        ids = encode(rows, self.names, dictionary, layout, self.order)
        words = [c for c in ids.columns if c != "ord"]
        shards = self.shards or max(1, -(-(arriving + known // CONTAINED) // SHARD_ROWS))
        spread = thin_out(ids, words, shards)
        whole = stored is None or old_layout != layout
        if stored is None:
            stored = self.spark.createDataFrame([], ", ".join(f"{w} bigint" for w in words) + ", bits binary, step bigint")
        elif whole:
            stored = self._recode(latest(stored, words), old_layout, layout).withColumn("step", F.lit(step - 1).cast("bigint"))
        home = F.pmod(F.xxhash64(*words), F.lit(shards)).cast("int")
        placed = stored.select(home.alias("shard"), *words, "bits", "step")
        columns = ", ".join(f"{w} bigint" for w in words)
        out = f"ord bigint, {columns}, bits binary, fresh bigint"

        def join(key: tuple, arrivals: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            kept = kept.sort_values("step").drop_duplicates(words, keep="last")
            again, new = select_arrivals(arrivals, words, kept)
            had = {tuple(r[:-1]): len(unpack_bits(r[-1])) for r in kept[[*words, "bits"]].itertuples(index=False, name=None)}
            fresh = [len(unpack_bits(c[-1])) - had.get(c[:-1], 0) for c in new]
            if whole:
                changed = {c[:-1] for c in new}
                new = new + [r for r in kept[[*words, "bits"]].itertuples(index=False, name=None) if tuple(r[:-1]) not in changed]
            told = arrivals["ord"].to_numpy()[again if repeats else ~again].tolist()
            none = [None] * len(told)
            frame = {"ord": pd.array(told + [None] * len(new), dtype="Int64")}
            for n, w in enumerate(words):
                frame[w] = pd.array(none + [c[n] for c in new], dtype="Int64")
            return pd.DataFrame(frame | {"bits": none + [c[-1] for c in new], "fresh": pd.array(none + fresh + [0] * (len(new) - len(fresh)), dtype="Int64")})

        # As many tasks as shards, whatever the session's number of partitions.
        apart = lambda df: df.repartition(shards, "shard").groupBy("shard")
        both = cut(apart(spread).cogroup(apart(placed)).applyInPandas(join, out))
        containers = both.where("bits is not null").select(*words, "bits", F.lit(step).cast("bigint").alias("step"))
        containers.write.mode("overwrite").parquet(f"{at}/bits")
        both.where("bits is null").select("ord").write.mode("overwrite").parquet(f"{at}/orders")
        dictionary.write.mode("overwrite").parquet(f"{at}/names")
        fields = [(n, name, low, bits) for n, (name, low, bits) in enumerate(layout.fields)]
        self.spark.createDataFrame(fields, "place int, name string, low bigint, bits int").coalesce(1).write.mode("overwrite").parquet(f"{at}/layout")
        ids_now = known + (both.agg(F.sum("fresh")).first()[0] or 0)
        row = {"step": step, "number": number, "at": at.rsplit("/", 1)[1], "whole": whole, "ids": ids_now, "repeats": repeats}
        if not whole and step - max(n for n, r in enumerate(taken) if r["whole"]) >= COMPACT_AFTER:
            row |= self._compact(taken, row, words)
        self.spark.createDataFrame([tuple(row.values())], _TAKEN).coalesce(1).write.mode("append").parquet(f"{self.folder}/published")
        self._clear([*taken, row])
        return row

    def _compact(self, taken: list, row: dict, words: list[str]) -> dict:
        """Write the state of a batch whole, beside what it changed."""
        since = max(n for n, r in enumerate(taken) if r["whole"])
        parts = self.spark.read.parquet(*[f"{self.folder}/{r['at']}/bits" for r in [*taken[since:], row]])
        packed = latest(parts, words).withColumn("step", F.lit(row["step"]).cast("bigint"))
        packed.write.mode("overwrite").parquet(f"{self.folder}/{row['at']}/packed")
        remove(self.spark, f"{self.folder}/{row['at']}/bits")
        rename(self.spark, f"{self.folder}/{row['at']}/packed", f"{self.folder}/{row['at']}/bits")
        return {"whole": True}

    def _clear(self, taken: list) -> None:
        """Remove states from before the last but one that was written whole; what batches kept stays."""
        whole = [n for n, r in enumerate(taken) if r["whole"]]
        if len(whole) > 1 and taken[-1]["whole"]:
            for r in taken[: whole[-2]]:
                for part in ("bits", "names", "layout"):
                    remove(self.spark, f"{self.folder}/{r['at']}/{part}")

    def _recode(self, stored: DataFrame, old: Layout, new: Layout) -> DataFrame:
        """Stored bits under a wider layout; exact, as ids can be taken apart again."""
        ids = self._ids(stored, old)
        moved = ids.select("w0", *old.unpack()).select("w0", *new.pack())
        words = moved.columns
        low = F.col(words[-1]).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint"))
        moved = moved.select(*words[:-1], F.shiftright(words[-1], LOW_BITS).alias(words[-1]), low.alias("bit"))

        def gather(key: tuple, bits: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, pack_bits(np.unique(bits["bit"].to_numpy())))], columns=[*words, "bits"])

        return moved.groupBy(*words).applyInPandas(gather, ", ".join(f"{w} bigint" for w in words) + ", bits binary")

    @staticmethod
    def _ids(stored: DataFrame, layout: Layout) -> DataFrame:
        """The ids of all stored bits."""
        words = ["w0", *(f"w{n}" for n in range(1, len(layout.words()) + 1))]

        def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch[[*words, "bits"]].itertuples(index=False, name=None):
                    bits = unpack_bits(row[-1])
                    yield pd.DataFrame({w: (row[n] << LOW_BITS) + bits if w == words[-1] else np.full(len(bits), row[n]) for n, w in enumerate(words)})

        return stored.mapInPandas(spell, ", ".join(f"{w} bigint" for w in words))
