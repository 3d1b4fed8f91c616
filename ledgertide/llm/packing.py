"""Filling sequences of a fixed number of tokens with whole documents."""

from __future__ import annotations

import math
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.tokens import VOCABULARY, sizes_of

#: Attention over n tokens costs about n * (1 + n / QUADRATIC_AT).
QUADRATIC_AT = 4096
#: Documents that are packed together in one task, on average.
SHARD_DOCUMENTS = 50_000


def packed(documents: DataFrame, doc_id: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY, repair: bool = True) -> DataFrame:
    """``(<doc_id>, piece, n_tokens, sequence, position, start)``: where each document goes.

    A document is one piece unless it is longer than ``capacity``; then it is cut into pieces of
    ``capacity`` tokens and a rest. ``sequence`` is the sequence's number, ``position`` the place of the
    piece in it from 0, ``start`` the token in it at which the piece starts.

    Only lengths are shuffled, never texts. The documents are dealt by the hash of their row into shards
    of about ``SHARD_DOCUMENTS``, whatever their ids or sizes, and each shard is packed in one task by
    :func:`pack`, without ``repair`` by :func:`balanced`; a shard leaves at most a few sequences half empty.

    Each row is placed, rows that repeat a ``doc_id`` too. A null or empty text has no tokens and takes
    no place: it comes out as one piece with null ``sequence``, ``position`` and ``start``. No rows in,
    no rows out. Extra columns are not looked at.
    """
    sizes = sizes_of(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", vocabulary)
    shards = max(1, round(sizes.count() / SHARD_DOCUMENTS))
    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)))
    kind = sizes.schema["id"].dataType.simpleString()

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        return _packed_shard(shard, capacity, pack if repair else balanced)

    out = dealt.where(F.col("n_tokens") > 0).groupBy("shard").applyInPandas(
        run, f"id {kind}, piece int, n_tokens long, sequence long, position int, start int"
    )
    empty = sizes.where(F.col("n_tokens") == 0).select(
        "id", F.lit(0).alias("piece"), "n_tokens", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("start")
    )
    return out.unionByName(empty).withColumnRenamed("id", doc_id)


def _packed_shard(shard: pd.DataFrame, capacity: int, place: Callable[[list[int], int], list[tuple[int, int]]]) -> pd.DataFrame:
    shard = shard.sort_values("row_id", kind="stable").reset_index(drop=True)
    whole, rest = np.divmod(shard["n_tokens"].to_numpy(), capacity)
    pieces = whole + (rest > 0)
    of = np.repeat(np.arange(len(shard)), pieces)
    piece = np.arange(len(of)) - np.repeat(pieces.cumsum() - pieces, pieces)
    size = np.where(piece < whole[of], capacity, rest[of])
    full = size == capacity
    sequence, start = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    sequence[full] = np.arange(full.sum())
    placed = np.array(place(size[~full].tolist(), capacity), np.int64).reshape(-1, 2)
    sequence[~full] = placed[:, 0] + full.sum()
    start[~full] = placed[:, 1]
    out = pd.DataFrame({"id": shard["id"].take(of).to_numpy(), "piece": piece, "n_tokens": size, "sequence": sequence, "start": start})
    out["position"] = out.groupby("sequence")["start"].rank(method="first").astype(int) - 1
    out["sequence"] += int(shard["shard"].iloc[0]) << 32
    return out[["id", "piece", "n_tokens", "sequence", "position", "start"]]


def balanced(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """``(sequence, offset)`` of each size (1 to ``capacity``), every one placed by balanced cost.

    In descending order (of equals the first) each size goes to the open sequence of lowest cost, linear
    plus quadratic, among those that have room for it, of equal costs to the one opened first; only if
    none has room a new one is opened. As sequences are opened one by one, the short sizes at the end
    find room in sequences of low cost, where opening all at once would leave some room in each of them.
    """
    bins = _Sequences(capacity)
    at = [(0, 0)] * len(sizes)
    for i in _descending(sizes):
        at[i] = bins.put(sizes[i], bins.cheapest(sizes[i]))
    return at


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """:func:`balanced`, then a repair that moves placed sizes where that saves sequences.

    Nothing is moved if ``balanced`` needs the fewest sequences the sizes can have. Else the sequences
    beyond the fewest, the least full ones, are dissolved and each other one keeps its longest size and
    gives up the others. They go back to close the sequences, the fullest first: the longest size while two
    don't suffice, then of the pairs that leave the least room the one that brings the sequence's cost
    nearest to the even share of all costs; what is left goes by balanced cost. As what is given up and
    which pairs are taken settle which sizes are left for later sequences, sizes that don't fit into the
    fewest sequences are tried again with only the three shortest given up, and with the most uneven of
    equal pairs. Of all packings the one with the fewest sequences stands, the first of equals.
    """
    best = balanced(sizes, capacity)
    fewest, used = -(-sum(sizes) // capacity), len({s for s, _ in best})
    for by_cost, kept in ((True, slice(1)), (True, slice(-3)), (False, slice(1)), (False, slice(-3))):
        if used > fewest:
            moved = _repaired(sizes, capacity, best, fewest, by_cost, kept)
            count = len({s for s, _ in moved})
            best, used = (moved, count) if count < used else (best, used)
    return best


def _descending(sizes: list[int]) -> list[int]:
    return sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))


def _repaired(sizes: list[int], capacity: int, placed: list[tuple[int, int]], fewest: int, by_cost: bool, kept: slice) -> list[tuple[int, int]]:
    """The places after the repair that :func:`pack` describes."""
    held: dict[int, list[int]] = {}
    for i in _descending(sizes):
        held.setdefault(placed[i][0], []).append(i)
    fill = {s: sum(sizes[i] for i in own) for s, own in held.items()}
    stay = sorted(held, key=lambda s: (-fill[s], s))[:fewest]
    bins, at = _Sequences(capacity), [(0, 0)] * len(sizes)
    loose = [i for s in held.keys() - set(stay) for i in held[s]]
    for s in stay:
        own, stays = bins.opened(), held[s][kept]
        for i in stays:
            at[i] = bins.put(sizes[i], own)
        loose += held[s][len(stays) :]

    even = sum(map(cost_of, sizes)) / fewest
    waiting: dict[int, list[int]] = {}
    for i in sorted(loose, key=lambda i: (-sizes[i], i), reverse=True):
        waiting.setdefault(sizes[i], []).append(i)
    count = np.bincount([sizes[i] for i in loose], minlength=capacity + 1)
    for sequence in sorted(range(len(bins.used)), key=lambda s: -bins.used[s]):
        for size in _closing(count, capacity - bins.used[sequence], bins.cost[sequence], even if by_cost else math.inf):
            i = waiting[size].pop()
            at[i] = bins.put(size, sequence)
    for size in sorted(waiting, reverse=True):
        for i in waiting[size]:
            at[i] = bins.put(size, bins.cheapest(size))
    return at


def cost_of(size: int | np.ndarray) -> float | np.ndarray:
    """Linear plus quadratic cost of a piece."""
    return size * (1 + size / QUADRATIC_AT)


def _closing(count: np.ndarray, room: int, cost: float, even: float) -> list[int]:
    """The sizes, taken off ``count``, that fill ``room`` best; of equal pairs the one that takes ``cost`` nearest to ``even``, at infinity the most uneven."""
    taken: list[int] = []
    while room > 0:
        there = np.flatnonzero(count[: room + 1])
        if not len(there):
            break
        if room > 2 * there[-1]:
            pick = [int(there[-1])]
        else:
            below = np.maximum.accumulate(np.where(count[: room + 1] > 0, np.arange(room + 1), 0))
            second = below[room - there]
            again = (second == there) & (count[there] == 1)
            second = np.where(again, below[np.maximum(there - 1, 0)], second)
            left = room - there - second
            least = np.flatnonzero(left == left.min())
            off = np.abs(cost + cost_of(there[least]) + cost_of(second[least]) - even)
            best = least[-1] if even == math.inf else least[np.argmin(off)]
            pick = [int(there[best]), *([int(second[best])] if second[best] else [])]
        for size in pick:
            count[size] -= 1
            cost += cost_of(size)
        taken += pick
        room -= sum(pick)
    return taken


_NONE = (math.inf, -1)  #: no sequence, as (cost, sequence)


class _Sequences:
    """Open sequences, found by lowest cost among those that have room enough.

    ``heaps[r]`` holds the sequences with ``r`` tokens of room by cost; ``low`` is a segment tree over
    the rooms with the lowest (cost, sequence) in each range.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.base = capacity, 1 << capacity.bit_length()
        self.used: list[int] = []
        self.cost: list[float] = []
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.low = [_NONE] * (2 * self.base)

    def _refresh(self, room: int) -> None:
        heap = self.heaps[room]
        while heap and (self.capacity - self.used[heap[0][1]] != room or self.cost[heap[0][1]] != heap[0][0]):
            heappop(heap)
        i = self.base + room
        self.low[i] = heap[0] if heap else _NONE
        while i > 1:
            i >>= 1
            new = min(self.low[2 * i], self.low[2 * i + 1])
            if self.low[i] == new:
                break
            self.low[i] = new

    def put(self, size: int, sequence: int) -> tuple[int, int]:
        offset = self.used[sequence]
        self.used[sequence] += size
        self.cost[sequence] += cost_of(size)
        self._refresh(self.capacity - offset)
        room = self.capacity - self.used[sequence]
        heappush(self.heaps[room], (self.cost[sequence], sequence))
        self._refresh(room)
        return sequence, offset

    def opened(self) -> int:
        self.used.append(0)
        self.cost.append(0.0)
        heappush(self.heaps[self.capacity], (0.0, len(self.used) - 1))
        self._refresh(self.capacity)
        return len(self.used) - 1

    def cheapest(self, size: int) -> int:
        """The sequence of lowest cost with room for ``size``, of equals the first; opened if there is none."""
        best, node = _NONE, 0
        lo, hi = self.base + size, self.base + self.capacity + 1
        while lo < hi:
            for side in ([lo] if lo & 1 else []) + ([hi - 1] if hi & 1 else []):
                if self.low[side] < best:
                    best, node = self.low[side], side
            lo, hi = (lo + 1) >> 1, hi >> 1
        return best[1] if node else self.opened()
