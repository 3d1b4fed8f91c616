"""Pairing each row with the row of another table that lies nearest in time, within tolerances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prices and sizes are compared as whole numbers of this fraction.
SCALE = 100_000_000
#: Width of the cells of price and size, and of the slices of time, that an entity's rows are split into.
CELL = 1 << 14
SLAB_MS = 1 << 13


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    time: str = "time_ms",
    entity: tuple[str, ...] = ("user", "coin", "side"),
    folded: tuple[str, ...] = ("user", "coin"),
    close: tuple[str, ...] = ("px", "sz"),
    tolerance_ms: int = 1000,
    tolerance: int = 100,
) -> DataFrame:
    """``(<left_id>, <right_id>)``: for each left row the nearest right row in time that goes with it.

    Rows go together if they agree in ``entity`` (the columns in ``folded`` without regard to letter
    case), differ by at most ``tolerance`` / ``SCALE`` in every column of ``close`` and by at most
    ``tolerance_ms`` in ``time``. Of right rows equally near, the one with the smallest id is taken. A
    right row may serve several left rows; a left row without partner isn't in the result.

    The rows of an entity are split into cells of price and size and slices of time; right rows near a
    border are put on both sides of it, so each left row finds all its partners in its own cell. So an
    entity with a third of all rows is spread over as many tasks as it has slices of eight seconds, and
    one shuffle brings both sides together. In each task the right rows of a cell are the leaves of an
    x-fast trie over the bits of their time: a hash table of all bit prefixes, in which a binary search
    over the prefix length finds the leaf before and the leaf after a left row's time. From these two it
    walks outwards as long as a nearer partner is possible. A cell's right rows are kept, its left rows
    stream past. Entity and cell are compared by two independent 64-bit hashes.

    Nulls: a row with a null in a compared column, and a right row with a null id, has no partner. Left
    rows that agree in id and all compared columns are one row; copies that differ in a compared column
    are paired each for itself. Right rows that agree in all compared columns are one, under their
    smallest id. Either table may be empty. Extra columns are not looked at.
    """
    wide = SLAB_MS + 2 * tolerance_ms
    bits = int(wide).bit_length()
    right_rows = _typed(right, right_id, time, entity, folded, close).where(F.col("id").isNotNull())
    names = [c for c in right_rows.columns if c != "id"]
    right_rows = right_rows.groupBy(*names).agg(F.min("id").alias("id"))
    for i in range(len(close)):
        right_rows = right_rows.withColumn(f"cell_{i}", _around(F.col(f"close_{i}"), tolerance, CELL))
    right_rows = _placed(right_rows.withColumn("slab", _around(F.col("t"), tolerance_ms, SLAB_MS)), len(entity), close, tolerance_ms)

    left_rows = _typed(left, left_id, time, entity, folded, close)
    for i in range(len(close)):
        left_rows = left_rows.withColumn(f"cell_{i}", F.floor(F.col(f"close_{i}") / CELL))
    left_rows = _placed(left_rows.withColumn("slab", F.floor(F.col("t") / SLAB_MS)), len(entity), close, tolerance_ms).distinct()

    lid, rid = left.schema[left_id].dataType, right.schema[right_id].dataType
    both = right_rows.select(*_KEYS, F.lit(0).alias("side"), *_values(close), F.col("id").alias("rid"), F.lit(None).cast(lid).alias("lid")).unionByName(
        left_rows.select(*_KEYS, F.lit(1).alias("side"), *_values(close), F.lit(None).cast(rid).alias("rid"), F.col("id").alias("lid"))
    )
    ordered = both.repartition("g").sortWithinPartitions("g", "h", "side", "x", "rid")
    closes, tol = len(close), (tolerance_ms, tolerance)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pair(batches, bits, closes, *tol)

    out = ordered.mapInArrow(pair, f"lid {lid.simpleString()}, rid {rid.simpleString()}")
    return out.select(F.col("lid").alias(left_id), F.col("rid").alias(right_id))


_KEYS = ["g", "h"]


def _values(close: tuple[str, ...]) -> list[str]:
    return ["x", *[f"close_{i}" for i in range(len(close))]]


def _typed(df: DataFrame, key: str, time: str, entity: tuple[str, ...], folded: tuple[str, ...], close: tuple[str, ...]) -> DataFrame:
    whole = lambda c: (F.col(c).cast("decimal(18,8)") * SCALE).cast("long")
    rows = df.select(
        F.col(key).alias("id"),
        F.col(time).cast("long").alias("t"),
        *[(F.lower(c) if c in folded else F.col(c)).alias(f"entity_{i}") for i, c in enumerate(entity)],
        *[whole(c).alias(f"close_{i}") for i, c in enumerate(close)],
    )
    return rows.na.drop(subset=[c for c in rows.columns if c != "id"])


def _around(value: Column, reach: int, width: int) -> Column:
    """The cells of that width that hold anything within reach, one row each."""
    return F.explode(F.sequence(F.floor((value - reach) / width), F.floor((value + reach) / width)))


def _placed(rows: DataFrame, entities: int, close: tuple[str, ...], tolerance_ms: int) -> DataFrame:
    """``g``, ``h``: the cell's two hashes; ``x``: the time from a tolerance before the slice's start."""
    cell = [*[F.col(f"entity_{i}") for i in range(entities)], *[F.col(f"cell_{i}") for i in range(len(close))], F.col("slab")]
    return rows.select(
        F.xxhash64(*cell).alias("g"),
        F.xxhash64(F.lit("second"), *reversed(cell)).alias("h"),
        (F.col("t") - F.col("slab") * SLAB_MS + tolerance_ms).alias("x"),
        *[f"close_{i}" for i in range(len(close))],
        "id",
    )


class _Table:
    """An open-addressing hash table from distinct whole numbers to positions, filled and read in bulk."""

    def __init__(self, codes: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(2 * len(codes)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.codes = np.full(self.mask + 1, -1, np.int64)
        self.at = np.zeros(self.mask + 1, np.int64)
        todo, slot = np.arange(len(codes)), self._slot(codes)
        while len(todo):
            free = self.codes[slot] == -1
            self.codes[slot[free]] = codes[todo[free]]
            placed = self.codes[slot] == codes[todo]
            self.at[slot[placed]] = todo[placed]
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Position of each code, -1 if it isn't there."""
        out, todo, slot = np.full(len(codes), -1, np.int64), np.arange(len(codes)), self._slot(codes)
        while len(todo):
            there = self.codes[slot]
            same = there == codes[todo]
            out[todo[same]] = self.at[slot[same]]
            on = ~same & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out


class XFastTrie:
    """x-fast tries of many groups over the lowest ``bits`` bits of whole numbers.

    ``group`` and ``x`` are sorted by both and distinct as pairs: the leaves. A node is a group with a bit
    prefix; the hash table holds every node on the path from a root to a leaf, with its first and last leaf.
    """

    def __init__(self, group: np.ndarray, x: np.ndarray, bits: int) -> None:
        self.group, self.bits = group, bits
        nodes, firsts, lasts = [], [], []
        for length in range(bits + 1):
            code = self._code(group, x, length)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
            nodes.append(code[first])
            firsts.append(first)
            lasts.append(np.r_[first[1:], len(code)] - 1 if len(code) else first)
        self.first, self.last = np.concatenate(firsts), np.concatenate(lasts)
        self.table = _Table(np.concatenate(nodes))

    def _code(self, group: np.ndarray, x: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (group << (self.bits + 1)) | (1 << length) | (x >> (self.bits - length))

    def neighbours(self, group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the last leaf at or before ``x`` and the first one after, -1 where there is none."""
        node = self.table.find(self._code(group, x, 0))
        rooted = node >= 0
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.bits + 1, np.int64)
        while len(open_ := np.flatnonzero(rooted & (high - low > 1))):
            mid = (low[open_] + high[open_]) >> 1
            hit = self.table.find(self._code(group[open_], x[open_], mid))
            there = hit >= 0
            node[open_[there]] = hit[there]
            low[open_] = np.where(there, mid, low[open_])
            high[open_] = np.where(there, high[open_], mid)
        if not len(self.group):
            return np.full(len(x), -1), np.full(len(x), -1)
        at = np.maximum(node, 0)
        above = (x >> np.maximum(self.bits - low - 1, 0)) & 1  # the branch that is missing
        before = np.where((low == self.bits) | (above == 1), self.last[at], self.first[at] - 1)
        after = before + 1
        fits = lambda leaf: rooted & (leaf >= 0) & (leaf < len(self.group)) & (self.group[np.clip(leaf, 0, len(self.group) - 1)] == group)
        return np.where(fits(before), before, -1), np.where(fits(after), after, -1)


def _pair(batches: Iterator[pa.RecordBatch], bits: int, closes: int, tolerance_ms: int, tolerance: int) -> Iterator[pa.RecordBatch]:
    """Sorted by cell, right rows before left rows: build the tries of the right rows, answer the left rows.

    The cell that a batch ends in stays open. Its right rows are gathered as they come, and its trie is built
    once, when the first of its left rows comes.
    """
    key, chunks, ready = None, [], None  # of the open cell: its two hashes, its right rows so far, its trie
    for b in batches:
        if not b.num_rows:
            continue
        g, h = b.column("g").to_numpy(), b.column("h").to_numpy()
        here = (g == key[0]) & (h == key[1]) if key is not None else np.zeros(len(g), bool)
        going_on = int(np.argmin(here)) if not here.all() else len(here)
        if going_on:
            part = b.slice(0, going_on)
            right = _rows(part, 0, closes, "rid")
            if len(right[1]):
                chunks, ready = [*chunks, right], None
            left = _rows(part, 1, closes, "lid")
            if len(left[1]) and chunks:
                ready = ready or _Cells(_together(chunks), bits, tolerance_ms, tolerance)
                yield from ready.answers(left)
        rest = b.slice(going_on)
        if not rest.num_rows:
            continue
        right, left = _rows(rest, 0, closes, "rid"), _rows(rest, 1, closes, "lid")
        if len(right[1]) and len(left[1]):
            yield from _Cells(right, bits, tolerance_ms, tolerance).answers(left)
        key = (g[-1], h[-1])
        last = (right[0][0] == key[0]) & (right[0][1] == key[1])
        chunks, ready = [([c[last] for c in right[0]], right[1].filter(pa.array(last)))] if last.any() else [], None


_Rows = tuple[list[np.ndarray], pa.Array]  #: g, h, x and the compared columns; the ids


def _rows(b: pa.RecordBatch, side: int, closes: int, ids: str) -> _Rows:
    at = np.flatnonzero(b.column("side").to_numpy() == side)
    return [b.column(n).to_numpy()[at] for n in ("g", "h", "x", *[f"close_{i}" for i in range(closes)])], b.column(ids).take(pa.array(at))


def _together(chunks: list[_Rows]) -> _Rows:
    return [np.concatenate(c) for c in zip(*[columns for columns, _ in chunks])], pa.concat_arrays([ids for _, ids in chunks])


def _order(ids: pa.Array) -> np.ndarray:
    """The place of each id among all of them, as whole numbers that compare like the ids."""
    places = np.empty(len(ids), np.int64)
    places[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return places


class _Cells:
    """Right rows, sorted by cell and time, and the tries of their times."""

    def __init__(self, right: _Rows, bits: int, tolerance_ms: int, tolerance: int) -> None:
        self.right, self.ids = right
        self.tolerance_ms, self.tolerance = tolerance_ms, tolerance
        g, h, x = self.right[:3]
        self.place = _order(self.ids)
        self.cells = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])].cumsum() - 1
        opens = np.flatnonzero(np.r_[True, self.cells[1:] != self.cells[:-1]])
        self.of_cell = {key: i for i, key in enumerate(zip(g[opens].tolist(), h[opens].tolist()))}
        self.leaf = np.flatnonzero(np.r_[True, (self.cells[1:] != self.cells[:-1]) | (x[1:] != x[:-1])])
        self.ends = np.r_[self.leaf[1:], len(x)] - 1
        self.trie = XFastTrie(self.cells[self.leaf], x[self.leaf], bits)

    def answers(self, left: _Rows) -> Iterator[pa.RecordBatch]:
        best = self.best(left[0])
        hit = np.flatnonzero(best >= 0)
        if len(hit):
            yield pa.RecordBatch.from_arrays([left[1].take(pa.array(hit)), self.ids.take(pa.array(best[hit]))], names=["lid", "rid"])

    def best(self, left: list[np.ndarray]) -> np.ndarray:
        """For each left row the index of its partner among the right rows, or -1."""
        right, cells, place, x = self.right, self.cells, self.place, self.right[2]
        changes = np.r_[True, (left[0][1:] != left[0][:-1]) | (left[1][1:] != left[1][:-1])]
        heads = np.flatnonzero(changes)
        known = np.array([self.of_cell.get(key, -1) for key in zip(left[0][heads].tolist(), left[1][heads].tolist())], np.int64)
        cell = known[changes.cumsum() - 1]
        ask = np.flatnonzero(cell >= 0)
        out = np.full(len(cell), -1, np.int64)
        if not len(ask):
            return out
        before, after = self.trie.neighbours(cell[ask], left[2][ask])
        gap, chosen = np.full(len(ask), self.tolerance_ms, np.int64), np.full(len(ask), -1, np.int64)
        for step, start in ((-1, np.where(before >= 0, self.ends[before], -1)), (1, np.where(after >= 0, self.leaf[after], -1))):
            on, at = np.flatnonzero(start >= 0), start[start >= 0]
            while len(on):
                row = ask[on]
                away = np.abs(x[at] - left[2][row])
                live = (cells[at] == cell[row]) & (away <= gap[on])
                on, at, row, away = on[live], at[live], row[live], away[live]
                fits = np.ones(len(on), bool)
                for mine, theirs in zip(left[3:], right[3:]):
                    fits &= np.abs(theirs[at] - mine[row]) <= self.tolerance
                nearer = fits & ((chosen[on] < 0) | (away < gap[on]) | (place[at] < place[np.maximum(chosen[on], 0)]))
                chosen[on[nearer]], gap[on[nearer]] = at[nearer], away[nearer]
                at = at + step
                inside = (at >= 0) & (at < len(x))
                on, at = on[inside], at[inside]
        out[ask] = chosen
        return out
