"""Byte-level BPE encoding with a hierarchical-bitmap rank queue.

A pre-token starts as one symbol per byte.  Every adjacent pair that the vocabulary can
merge waits in a bucket of its merge rank; a bucket holds the linked-list positions of
its pairs.  Which buckets are filled is kept in a three-level bitmap (64-way fan-out), so
the lowest filled rank is found by three find-first-set steps, and a merge touches only
its two neighbours.  Entries whose pair has meanwhile changed are skipped when they come
up.  A pre-token of n bytes takes O(n) queue steps whatever its length, so a pre-token of
megabytes (a text without white space) is no special case.

Ids follow the published vocabulary file; texts are split by its published pattern.
Special tokens' names inside a text are ordinary text.  Null and empty texts give an
empty list.  Code points that UTF-8 cannot hold (lone surrogates) count as U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every worker.
TOKENIZERS = "/opt/tokenizers"
#: The published split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens up to this many bytes are remembered, and so many of them per worker.
MEMO_BYTES, MEMO_SIZE = 64, 400_000


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class RankQueue:
    """Buckets of positions by rank; pops the lowest rank first, within a rank the leftmost position pushed first."""

    def __init__(self, ranks: int) -> None:
        self.words = [0] * (ranks // 64 + 1)
        self.blocks = [0] * (len(self.words) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        block = word >> 6
        self.words[word] |= 1 << (rank & 63)
        self.blocks[block] |= 1 << (word & 63)
        self.top |= 1 << block

    def first(self) -> int:
        """The lowest filled rank, or -1: find-first-set on each level."""
        top = self.top
        if not top:
            return -1
        block = (top & -top).bit_length() - 1
        word = self.blocks[block]
        word = (block << 6) + (word & -word).bit_length() - 1
        bits = self.words[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty a bucket."""
        word = rank >> 6
        block = word >> 6
        self.words[word] &= ~(1 << (rank & 63))
        if not self.words[word]:
            self.blocks[block] &= ~(1 << (word & 63))
            if not self.blocks[block]:
                self.top &= ~(1 << block)
        return self.buckets.pop(rank)


class Encoder:
    """Encodes texts by one vocabulary file (``*.json`` with merges)."""

    def __init__(self, path: str | Path) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        names, ids = _byte_names(), model["vocab"]
        self.byte_id = [0] * 256
        for name, byte in names.items():
            self.byte_id[byte] = ids[name]
        #: pair of ids -> (merge rank, id of the merged symbol)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        self.split = regex.compile(PATTERN).findall
        self.queue = RankQueue(len(self.merges))
        self.memo: dict[str, tuple[int, ...]] = {}

    def pre_token(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbols = [self.byte_id[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        merges, queue = self.merges, self.queue
        push = queue.push
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            if merge := merges.get((symbols[i], symbols[i + 1])):
                push(merge[0], i)
        while (rank := queue.first()) >= 0:
            bucket = queue.take(rank)
            bucket.sort()
            for i in bucket:
                left = symbols[i]
                j = after[i]
                if left < 0 or j >= n:
                    continue  # stale: merged into its left neighbour, or now the last
                merge = merges.get((left, symbols[j]))
                if merge is None or merge[0] != rank:
                    continue  # stale: the pair has changed
                symbols[i] = new = merge[1]
                symbols[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if merge := merges.get((new, symbols[k])):
                        push(merge[0], i)
                if (h := before[i]) >= 0 and (merge := merges.get((symbols[h], new))):
                    push(merge[0], h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty list for None and for an empty text."""
        out: list[int] = []
        memo, extend = self.memo, out.extend
        for piece in self.split(text or ""):
            ids = memo.get(piece)
            if ids is None:
                try:
                    raw = piece.encode()
                except UnicodeEncodeError:  # lone surrogates
                    raw = "".join(chr(0xFFFD) if 0xD800 <= ord(c) < 0xE000 else c for c in piece).encode()
                ids = tuple(self.pre_token(raw))
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO_SIZE:
                        memo.clear()
                    memo[piece] = ids
            extend(ids)
        return out


_loaded: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a vocabulary, read once per Python worker."""
    path = str(Path(folder, f"{name}.json"))
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def ids_column(text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The token ids of a text column as array<int>; Arrow batches, no shuffle."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder(name, folder).encode
        for texts in batches:
            yield texts.map(run)

    return encode(F.col(text) if isinstance(text, str) else text)


def size_column(text: Column | str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The number of token ids of a text column; the ids themselves never leave the worker."""

    @F.pandas_udf("bigint")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder(name, folder).encode
        for texts in batches:
            yield texts.map(lambda t: len(run(t)))

    return size(F.col(text) if isinstance(text, str) else text)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every document."""
    return docs.select(key, ids_column(text, name, folder).alias("ids"))
