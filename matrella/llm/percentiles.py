"""Percentiles of very large numeric columns by relative-rank compactors.

A sketch is a stack of compactors; an item of level h stands for 2**h values.  When a compactor is full, its lowest part is sorted and every
second item of it moves one level up; how much of it follows a schedule that compacts sections next to the protected upper half rarely.  So ranks
near the upper end stay (almost) exact and the error grows with the distance from it: a multiplicative error of rank.  Sketches of partitions, days
or loads are merged by joining their levels.

Besides the usual guarantee each sketch counts its own compactions per level and the largest value they touched, which bounds the error of a rank
for certain: a compaction of level h moves the rank of a value within its range by at most 2**h, and of values above it not at all.

Null and NaN values are ignored; a group without values has no sketch; ties are values like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION = 64  # items of a section; 3 sections at first, one more each time the schedule's counter doubles
STATE = "key string, n bigint, sizes array<int>, items array<double>, turns array<bigint>, compacted array<bigint>, tops array<double>"
_NAMES = ["key", "n", "sizes", "items", "turns", "compacted", "tops"]


class Sketch:
    """Levels of sorted items with, per level, the schedule's counter, the number of compactions and the largest value compacted."""

    def __init__(self, section: int = SECTION):
        self.section, self.n = section, 0
        self.levels: list[np.ndarray] = []
        self.turns: list[int] = []
        self.compacted: list[int] = []
        self.tops: list[float] = []

    def _level(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.zeros(0))
            self.turns.append(0)
            self.compacted.append(0)
            self.tops.append(-np.inf)

    def sections(self, h: int) -> int:
        return max(3, self.turns[h].bit_length() + 1)

    def add(self, values: np.ndarray) -> None:
        self._level(0)
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.shrink()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        for h, items in enumerate(other.levels):
            self._level(h)
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.turns[h] |= other.turns[h]
            self.compacted[h] += other.compacted[h]
            self.tops[h] = max(self.tops[h], other.tops[h])
        self.shrink()

    def shrink(self) -> None:
        h = 0
        while h < len(self.levels):
            parts = self.sections(h)
            if len(self.levels[h]) >= 2 * self.section * parts:
                items = np.sort(self.levels[h])
                turn = self.turns[h]
                freed = min(parts, ((~turn) & (turn + 1)).bit_length())  # one section more than the counter has trailing ones
                low = len(items) - self.section * (parts + parts - freed)
                low -= low % 2
                if low > 0:
                    coin = int(np.random.default_rng([turn, h, self.n]).integers(2))
                    self._level(h + 1)
                    self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[coin:low:2]])
                    self.levels[h] = items[low:]
                    self.turns[h] += 1
                    self.compacted[h] += 1
                    self.tops[h] = max(self.tops[h], float(items[low - 1]))
            h += 1

    def below(self, value: float) -> tuple[int, int]:
        """Estimated number of values < value, and how far off that is at most."""
        count = sum(int(np.count_nonzero(x < value)) << h for h, x in enumerate(self.levels))
        off = sum(c << h for h, (c, top) in enumerate(zip(self.compacted, self.tops)) if top >= value)
        return count, off

    def value_at(self, rank: int) -> float:
        """The item whose estimated rank (1 is the smallest) first reaches `rank`."""
        items = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        at = np.searchsorted(np.cumsum(weight[order]), rank)
        return float(items[order[min(at, len(items) - 1)]])


def rank_of(pct: int, n: int) -> int:
    """The rank of the smallest value that at least pct % of n values do not exceed."""
    return max(1, -(-pct * n // 100))


def _states(rows: list[tuple[str, Sketch]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([k for k, _ in rows], pa.string()),
        pa.array([s.n for _, s in rows], pa.int64()),
        pa.array([[len(x) for x in s.levels] for _, s in rows], pa.list_(pa.int32())),
        pa.array([np.concatenate(s.levels) for _, s in rows], pa.list_(pa.float64())),
        pa.array([s.turns for _, s in rows], pa.list_(pa.int64())),
        pa.array([s.compacted for _, s in rows], pa.list_(pa.int64())),
        pa.array([s.tops for _, s in rows], pa.list_(pa.float64())),
    ], _NAMES)


def _small_states(keys: pa.Array, sizes: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
    """States of groups that fit into level 0, without a loop."""
    one = pa.array(np.arange(len(sizes) + 1, dtype=np.int32))
    each = lambda values, kind: pa.ListArray.from_arrays(one, pa.array(values, kind))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    zero = np.zeros(len(sizes), np.int64)
    return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), each(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(items)), each(zero, pa.int64()), each(zero, pa.int64()), each(np.full(len(sizes), -np.inf), pa.float64())], _NAMES)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sketches of a task: small groups leave with each slab of rows, large ones are kept to the end."""
    large: dict[str, Sketch] = {}
    slab: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(slab).combine_chunks()
        slab.clear()
        coded = pc.dictionary_encode(t["key"]).combine_chunks()
        codes, values = coded.indices.to_numpy(), t["value"].to_numpy()
        order = np.lexsort((values, codes))
        codes, values = codes[order], values[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sizes = np.diff(np.r_[starts, len(codes)])
        small = sizes < SECTION * 3
        for k in np.flatnonzero(~small):
            large.setdefault(coded.dictionary[int(codes[starts[k]])].as_py(), Sketch()).add(values[starts[k] : starts[k] + sizes[k]])
        if small.any():
            yield _small_states(coded.dictionary.take(pa.array(codes[starts[small]])), sizes[small], values[np.repeat(small, sizes)])

    rows = 0
    for b in batches:
        if b.num_rows:
            slab.append(b)
            rows += b.num_rows
        if rows >= 500_000:
            yield from flush()
            rows = 0
    if slab:
        yield from flush()
    if large:
        yield _states(list(large.items()))


def _load(t: pa.RecordBatch | pa.Table, k: int) -> Sketch:
    s = Sketch()
    s.n = t["n"][k].as_py()
    items = np.asarray(t["items"][k].values, dtype=np.float64)
    s.levels = np.split(items, np.cumsum(t["sizes"][k].as_py())[:-1])
    s.turns, s.compacted, s.tops = t["turns"][k].as_py(), t["compacted"][k].as_py(), t["tops"][k].as_py()
    return s


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Sketch]]:
    """One sketch a key, from states sorted by key."""
    key, sketch = None, None
    for b in batches:
        keys, n = b.column("key").to_pylist(), b.column("n").to_numpy()
        sizes = b.column("sizes")
        flat = np.asarray(b.column("items").flatten(), dtype=np.float64)
        ends = np.cumsum(pc.list_value_length(b.column("items")).to_numpy(zero_copy_only=False))
        simple = pc.list_value_length(sizes).to_numpy(zero_copy_only=False) == 1
        waiting: list[np.ndarray] = []
        for k, name in enumerate(keys):
            if name != key:
                if sketch is not None:
                    if waiting:
                        sketch.add(np.concatenate(waiting))
                        waiting = []
                    yield key, sketch
                key, sketch = name, Sketch()
            if simple[k]:
                waiting.append(flat[ends[k] - n[k] : ends[k]])
            else:
                sketch.merge(_load(b, k))
        if waiting and sketch is not None:
            sketch.add(np.concatenate(waiting))
    if sketch is not None:
        yield key, sketch


def sketches(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Partial sketches (one or more a group): key (JSON of the key columns) and the sketch's state; no shuffle."""
    rows = df.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), value.cast("double").alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).mapInArrow(_sketch, STATE)


def _sorted(states: DataFrame) -> DataFrame:
    return states.repartition("key").sortWithinPartitions("key")


def merge(states: DataFrame) -> DataFrame:
    """One state a key, from partial states of any partitions, days or loads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, Sketch]] = []
        for pair in _merged(batches):
            rows.append(pair)
            if len(rows) == 1000:
                yield _states(rows)
                rows = []
        if rows:
            yield _states(rows)

    return _sorted(states).mapInArrow(run, STATE)


def percentiles(states: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """(key, n, pct, value, low, high): the estimate, and the certain bounds low..high of its rank, from partial states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, s in _merged(batches):
            for pct in wanted:
                v = s.value_at(rank_of(pct, s.n))
                low, off = s.below(v)
                high, more = s.below(np.nextafter(v, np.inf))
                rows.append((key, s.n, pct, v, max(0, low - off) + 1, min(s.n, high + more)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["key", "n", "pct", "value", "low", "high"])

    return _sorted(states).mapInArrow(run, "key string, n bigint, pct bigint, value double, low bigint, high bigint")


def against_limits(states: DataFrame, limits: Callable[[str], Sequence[tuple[int, float]]]) -> DataFrame:
    """(key, n, pct, limit_value, reaches): whether a group's percentile is at least the limit; null where the sketch can't tell.

    limits: key -> the (pct, limit) that hold for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, s in _merged(batches):
            for pct, limit in limits(key):
                count, off = s.below(limit)
                need = rank_of(pct, s.n)
                rows.append((key, s.n, pct, limit, True if count + off < need else False if count - off >= need else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["key", "n", "pct", "limit_value", "reaches"])

    return _sorted(states).mapInArrow(run, "key string, n bigint, pct bigint, limit_value double, reaches boolean")
