"""Filling containers of fixed capacity with texts of varying length, along a space-filling curve.

Each text is hashed into a vector (counts of byte 4-grams in 256 cells), projected to four dimensions and placed on a Hilbert curve;
texts are range-sorted by their place, so neighbours on the curve, and with that in a container, are alike.  Each range is packed in
windows along the curve: best fit, longest first, with a bounded set of open containers carried from window to window.  Containers left
half empty at the ends of ranges are unpacked once more and packed together.

A text longer than a container is the only kind that is split: it fills whole containers, and its rest is packed like any text.
Null texts are no items; an empty text has the size its tokenizer gives it (with an end token 1).  Equal places on the curve are ordered by
doc_id, so any number of equal texts spreads over ranges.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrella.llm.words import slabs
from matrella.session import cut

CELLS, AXES, BITS = 256, 4, 10
WINDOW, OPEN = 4096, 64  # items sorted at once; open containers carried on
PLACED = "container bigint, doc_id bigint, piece int, n_pieces int, tokens bigint"

Counter = Callable[[pa.Array], np.ndarray]


def byte_tokens(texts: pa.Array) -> np.ndarray:
    """Sizes in tokens of a byte-level model: each byte of the UTF-8 text is one, and one ends the text."""
    return np.diff(_offsets(texts)).astype(np.int64) + 1


def bpe_tokens(path: str) -> Counter:
    """Sizes by a byte-level BPE vocabulary file (ranks, one base64 token a line)."""
    loaded: list = []

    def count(texts: pa.Array) -> np.ndarray:
        if not loaded:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
            loaded.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return np.array([len(loaded[0].encode_ordinary(t)) for t in texts.to_pylist()], np.int64)

    return count


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = texts.cast(pa.large_string())
    return np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)


def hashed_vectors(texts: pa.Array) -> np.ndarray:
    """Unit vectors of the square roots of byte 4-gram counts in CELLS hashed cells."""
    wide = texts.cast(pa.large_string())
    ends = _offsets(wide)
    out = np.zeros((len(wide), CELLS), np.float32)
    if ends[-1] - ends[0] < 4:
        return out
    raw = np.frombuffer(wide.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    with np.errstate(over="ignore"):
        two = raw[:-1] * np.uint32(0x01000193) + raw[1:]
        four = (two[:-2] * np.uint32(0x9E3779B1)) ^ two[2:]
        cell = (four * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    sizes = np.diff(ends)
    doc = np.repeat(np.arange(len(wide), dtype=np.int64), sizes)[: len(cell)]
    # 4-grams across the end of a text are counted to neither
    inside = doc == np.repeat(np.arange(len(wide), dtype=np.int64), sizes)[3:]
    counts = np.bincount((doc * CELLS + cell)[inside], minlength=len(wide) * CELLS).reshape(len(wide), CELLS)
    out = np.sqrt(counts).astype(np.float32)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def grid_places(rows: np.ndarray) -> np.ndarray:
    """Whole coordinates 0 .. 2**BITS - 1 of a fixed random projection to AXES dimensions."""
    axes = np.random.default_rng(11).standard_normal((CELLS, AXES)).astype(np.float32)
    # square roots of counts are all positive: what all texts have in common is taken out, the rest spreads over the grid
    axes -= axes.mean(axis=0)
    return np.clip((rows @ axes / 4 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_key(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of points with whole coordinates, one row a point.

    Gray-code walk from the highest bit down: at each level the orientation of the sub-cube is undone by exchanging or inverting the lower bits.
    """
    x = [places[:, k].copy() for k in range(places.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for k in range(n):
            flip = (x[k] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] & (1 << level)) > 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | (((x[k] ^ turn) >> level) & 1)
    return key


def _measure(count: Counter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slabs(batch, "text"):
                texts = b.column("text")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count(texts)), pa.array(hilbert_key(grid_places(hashed_vectors(texts))))], ["doc_id", "tokens", "place"])

    return run


def sized_items(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: Counter = byte_tokens) -> DataFrame:
    """(doc_id, tokens, place) of each non-null text."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return src.mapInArrow(_measure(count), "doc_id bigint, tokens bigint, place bigint")


class _Packer:
    """Best fit into open containers, ordered by free room."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.room: list[tuple[int, int]] = []  # (free, container), ascending
        self.inside: dict[int, list[tuple]] = {}

    def put(self, item: tuple, tokens: int) -> None:
        at = bisect_left(self.room, (tokens, -1))
        if at < len(self.room):
            free, c = self.room.pop(at)
        else:
            free, c, self.next = self.capacity, self.next, self.next + 1
            self.inside[c] = []
        self.inside[c].append(item)
        insort(self.room, (free - tokens, c))

    def close(self, keep: int, least: int = 1) -> list[tuple]:
        """Closed containers' rows; the `keep` with most room of at least `least` stay open."""
        first = max(len(self.room) - keep, bisect_left(self.room, (least, -1)))
        done, self.room = self.room[:first], self.room[first:]
        return [(c, *item) for _, c in done for item in self.inside.pop(c)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["container", "doc_id", "piece", "n_pieces", "tokens", "full"])


def _pack(capacity: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items (doc_id, tokens[, piece, n_pieces]) of one range in the order of the curve -> placed rows; full tells what needs no second packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        packer = _Packer(capacity, (2 * part + last) << 36)
        whole: list[tuple] = []
        waiting: list[tuple[int, int, int, int]] = []

        def window() -> list[tuple]:
            for tokens, doc, piece, n in sorted(waiting, key=lambda w: (-w[0], w[1])):
                packer.put((doc, piece, n, tokens), tokens)
            waiting.clear()
            return packer.close(OPEN, capacity // 256)

        for b in batches:
            d = b.to_pydict()
            pieces = zip(d["piece"], d["n_pieces"]) if "piece" in d else None
            for doc, tokens in zip(d["doc_id"], d["tokens"]):
                if pieces is not None:
                    waiting.append((tokens, doc, *next(pieces)))
                elif tokens <= capacity:
                    waiting.append((tokens, doc, 0, 1))
                else:
                    n = -(-tokens // capacity)
                    for k in range(n - 1):
                        whole.append((packer.next, doc, k, n, capacity, True))
                        packer.next += 1
                    waiting.append((tokens - (n - 1) * capacity, doc, n - 1, n))
                if len(waiting) >= WINDOW:
                    yield _rows(whole + [(*r, True) for r in window()])
                    whole = []
        out = whole + [(*r, True) for r in window()]
        poor = capacity // 16
        rest = packer.close(0, capacity + 1) if last else None
        if rest is None:
            out += [(c, *i, free < poor) for free, c in packer.room for i in packer.inside[c]]
        else:
            out += [(*r, True) for r in rest]
        yield _rows(out)

    return run


def packed(items: DataFrame, capacity: int = 8192) -> DataFrame:
    """(container, doc_id, piece, n_pieces, tokens): where every item, or piece of an item longer than a container, lies.

    items: (doc_id, tokens, place).  No container holds more than `capacity` tokens.
    """
    schema = PLACED + ", full boolean"
    items = cut(items)
    along = items.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    first = cut(along.select("doc_id", "tokens").mapInArrow(_pack(capacity, False), schema))
    # at most OPEN containers of each range come back; neighbouring ranges share the second packing
    again = first.where("not full").select("container", "doc_id", "tokens", "piece", "n_pieces")
    group = F.shiftright("container", 37 + 5)
    again = again.repartition(group).sortWithinPartitions("container", "doc_id").select("doc_id", "tokens", "piece", "n_pieces")
    second = again.mapInArrow(_pack(capacity, True), schema)
    return first.where("full").unionAll(second).drop("full")


def containers(placed: DataFrame, capacity: int = 8192) -> DataFrame:
    """(container, n_items, tokens, unused) of each container."""
    return placed.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("unused"))
