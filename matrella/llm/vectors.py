"""Vectors as packed float32 rows, and block-wise work on groups of them.

A vector is stored by component (row id, component, value, time).  The latest value of a component counts; absent,
null and NaN or infinite components are 0; components outside 0..dims-1 and rows with a null id are ignored; of several values
with the same latest time the largest counts (null the least, NaN the largest), so the result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrella.session import cut

#: rows of one side of a block; two blocks of 64-wide float32 vectors are 8 MB
CHUNK = 16_384
#: Groups of more than one block whose sizes are broadcast (20 bytes each); beyond that they are joined.
MAX_HOT = 1_000_000


def pack(rows: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    rows = np.ascontiguousarray(rows, dtype="<f4")
    width = rows.shape[1] * 4
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(rows)])


def unpack(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The matrix of a column of packed vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dims), np.float32)
    data = column.cast(pa.binary())
    start = np.frombuffer(data.buffers()[1], np.int32, 1, data.offset * 4)[0]
    return np.frombuffer(data.buffers()[2], "<f4", len(data) * dims, int(start)).reshape(-1, dims)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; rows of zeros stay zeros."""
    rows = rows.astype(np.float64)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


_NONE = -np.inf  # a null value: less than any other
_EVER = -(2**62)  # a null time: before any other
_PART = ["id", "j", "v", "at"]
PART = "id bigint, j binary, v binary, at binary"


def _latest(id_: np.ndarray, j: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The latest value of each (id, component), sorted by both."""
    if len(id_) > 1 and not np.all((id_[1:] > id_[:-1]) | ((id_[1:] == id_[:-1]) & (j[1:] > j[:-1]))):
        order = np.lexsort((v, at, j, id_))
        id_, j, v, at = id_[order], j[order], v[order], at[order]
        last = np.r_[(id_[1:] != id_[:-1]) | (j[1:] != j[:-1]), True]
        id_, j, v, at = id_[last], j[last], v[last], at[last]
    return id_, j, v, at


def _pieces(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of values as one binary value each."""
    values = np.ascontiguousarray(values)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary runs, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = column.cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)
    width = np.dtype(kind).itemsize
    raw = data.buffers()[2]
    return np.frombuffer(raw, kind, (ends[-1] - ends[0]) // width, int(ends[0])) if raw else np.zeros(0, kind), np.diff(ends) // width


def _parts(dims: int, rows: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Components that a task sees of one vector as one row: places (left out where all are there), values, times (one where all are alike)."""

    def flush(slab: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(slab)
        id_, j, v, at = _latest(t["id"].to_numpy(), t["j"].to_numpy().astype(np.uint16), t["v"].fill_null(_NONE).to_numpy(), t["at"].cast(pa.int64()).fill_null(_EVER).to_numpy())
        start = np.flatnonzero(np.r_[True, id_[1:] != id_[:-1]]) if len(id_) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[start, len(id_)])
        alike = np.ones(len(start), bool)
        alike[np.searchsorted(start, np.flatnonzero(np.r_[False, (at[1:] != at[:-1]) & (id_[1:] == id_[:-1])]), side="right") - 1] = False
        first = np.zeros(len(id_), bool)
        first[start] = True
        full = sizes == dims
        return pa.RecordBatch.from_arrays([
            pa.array(id_[start]), _pieces(j[np.repeat(~full, sizes)], np.where(full, 0, sizes)), _pieces(v.astype("<f4"), sizes), _pieces(at[first | np.repeat(~alike, sizes)], np.where(alike, 1, sizes)),
        ], _PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, held = [], 0
        for b in batches:
            slab.append(b)
            held += b.num_rows
            if held >= rows:
                yield flush(slab)
                slab, held = [], 0
        if held:
            yield flush(slab)

    return run


def _assemble(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole vectors from parts sorted by id; the last id of a batch waits for the next one."""

    def components(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        j, nj = unpacked(b.column("j"), "<u2")
        v, n = unpacked(b.column("v"), "<f4")
        at, na = unpacked(b.column("at"), "<i8")
        full = nj == 0
        places = np.empty(len(v), np.uint16)
        rows = np.repeat(full, n)
        places[rows] = np.tile(np.arange(dims, dtype=np.uint16), int(full.sum()))
        places[~rows] = j
        times = np.empty(len(v), np.int64)
        one = na == 1
        times[np.repeat(one, n)] = np.repeat(at[np.repeat(one, na)], n[one])
        times[np.repeat(~one, n)] = at[np.repeat(~one, na)]
        return np.repeat(b.column("id").to_numpy(), n), places, v, times

    def whole(flat: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        id_, j, v, _ = _latest(*flat)
        ids, row = np.unique(id_, return_inverse=True)
        rows = np.zeros((len(ids), dims), np.float32)
        rows[row, j] = np.where(np.isfinite(v), v, 0)
        rows += 0.0  # no negative zeros: equal vectors have equal bytes
        keep = np.any(rows != 0, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pack(rows[keep])], ["id", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            flat = components(b)
            if waiting is not None:
                flat = tuple(np.concatenate(x) for x in zip(waiting, flat))
            cut_at = int(np.searchsorted(flat[0], flat[0][-1]))
            # what waits is one vector's components, the latest of each: it does not grow with the parts of a hot id
            waiting = _latest(*(x[cut_at:] for x in flat))
            if cut_at:
                yield whole(tuple(x[:cut_at] for x in flat))
        if waiting is not None:
            yield whole(waiting)

    return run


def latest_vectors(parts: DataFrame, row: str, component: str, value: str, at: str, dims: int) -> DataFrame:
    """(id, vec): one packed vector a row, from its latest components; vectors of zeros only are left out.

    Each task packs the components that it sees of a vector into one row before anything is shuffled, so an id with a third of all rows is a row a task.
    """
    src = parts.select(F.col(row).cast("bigint").alias("id"), F.col(component).cast("int").alias("j"), F.col(value).cast("float").alias("v"), F.col(at).alias("at"))
    src = src.where(F.col("id").isNotNull() & F.col("j").between(0, dims - 1)).mapInArrow(_parts(dims), PART)
    return src.repartition("id").sortWithinPartitions("id").mapInArrow(_assemble(dims), "id bigint, vec binary")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec): one row for equal vectors, with the smallest id of them; combines on the map side."""
    return vectors.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")


def in_blocks(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, chunk: int = CHUNK) -> DataFrame:
    """Run `work` over every block of every group: rows asked (is_q) against rows held (is_d).

    rows: (grp, id, vec, is_q, is_d, and whatever else `work` wants).  A group of any size is split into blocks of at most about `chunk` asked and `chunk` held rows, so no task
    sees a whole hot group; a row is copied once for each block of the other side.  `work` gets one block and returns its rows.
    """
    sizes = rows.groupBy("grp").agg(
        F.ceil(F.sum(F.col("is_q").cast("int")) / chunk).cast("int").alias("nq"),
        F.ceil(F.sum(F.col("is_d").cast("int")) / chunk).cast("int").alias("nd"),
    )
    # only groups of more than one block are looked up: at most one for each `chunk` rows
    hot = cut(sizes.where("nq > 1 or nd > 1"))
    n_hot = hot.count()
    one = F.lit(1)
    if not n_hot:
        r = rows.withColumn("nq", one).withColumn("nd", one)
    else:
        r = rows.join(F.broadcast(hot) if n_hot <= MAX_HOT else hot, "grp", "left").withColumns({"nq": F.greatest(F.coalesce("nq", one), one), "nd": F.greatest(F.coalesce("nd", one), one)})
    h = F.xxhash64("id")
    r = r.withColumn("qc", F.pmod(h, F.col("nq")).cast("int")).withColumn("dc", F.pmod(h, F.col("nd")).cast("int"))
    asked = F.when(F.col("is_q"), F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda d: F.struct(F.col("qc").alias("q"), d.alias("d"), F.lit(True).alias("is_q"), (F.col("is_d") & (d == F.col("dc"))).alias("is_d"))))
    others = F.filter(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: ~(F.col("is_q") & (q == F.col("qc"))))
    held = F.when(F.col("is_d"), F.transform(others, lambda q: F.struct(q.alias("q"), F.col("dc").alias("d"), F.lit(False).alias("is_q"), F.lit(True).alias("is_d"))))
    none = F.array().cast("array<struct<q:int,d:int,is_q:boolean,is_d:boolean>>")
    carried = [c for c in rows.columns if c not in ("grp", "is_q", "is_d")]
    cells = r.select("grp", *carried, F.explode(F.concat(F.coalesce(asked, none), F.coalesce(held, none))).alias("c")).select("grp", "c.q", "c.d", *carried, "c.is_q", "c.is_d")
    return cells.groupBy("grp", "q", "d").applyInArrow(work, schema)


def each_batch(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Record batches in slices of at most `rows` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield pa.Table.from_batches([b.slice(at, rows)])
