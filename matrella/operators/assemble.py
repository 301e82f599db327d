"""COO to compressed or dense blocks.

A compressed block is plain arrays (indptr, indices, data, shape): no sparse library is needed to make or read one.  Small results are assembled on the
driver from Arrow columns, large ones block by block in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Compressed:
    """A compressed matrix; kind is csr (rows are major) or csc."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    shape: tuple[int, int]
    kind: str = "csr"

    @property
    def nnz(self) -> int:
        return len(self.data)

    @staticmethod
    def from_ijd(i: np.ndarray, j: np.ndarray, d: np.ndarray, shape: tuple[int, int], kind: str = "csr", make_sorted: bool = True) -> Compressed:
        """From coordinates; they must lie within the shape, and with make_sorted no cell may occur twice."""
        i, j, d = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(d)
        if kind not in ("csr", "csc"):
            raise ValueError(f"unknown kind {kind!r}")
        if not len(i) == len(j) == len(d):
            raise ValueError("coordinates and data differ in length")
        if len(i) and (i.min() < 0 or j.min() < 0 or i.max() >= shape[0] or j.max() >= shape[1]):
            raise ValueError("a coordinate lies outside the shape")
        major, minor = (i, j) if kind == "csr" else (j, i)
        order = np.lexsort((minor, major)) if make_sorted else np.argsort(major, kind="stable")
        major, minor, d = major[order], minor[order], d[order]
        if make_sorted and len(major) > 1 and np.any((major[1:] == major[:-1]) & (minor[1:] == minor[:-1])):
            raise ValueError("a cell occurs twice")
        small = np.int32 if max(len(d), *shape) < 2**31 else np.int64
        n = shape[0] if kind == "csr" else shape[1]
        indptr = np.concatenate([[0], np.cumsum(np.bincount(major, minlength=n))]).astype(small)
        return Compressed(indptr, minor.astype(small), d, shape, kind)

    def _major(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def to_coo(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        major, minor = self._major(), self.indices.astype(np.int64)
        return (major, minor, self.data) if self.kind == "csr" else (minor, major, self.data)

    def to_numpy(self, index: slice | None = None) -> np.ndarray:
        """Dense, in C order; index slices the major axis."""
        n = len(self.indptr) - 1
        lo, hi, _ = (index or slice(None)).indices(n)
        hi = max(lo, hi)
        a, b = self.indptr[lo], self.indptr[hi]
        out = np.zeros((hi - lo, self.shape[1] if self.kind == "csr" else self.shape[0]), self.data.dtype)
        out[np.repeat(np.arange(hi - lo), np.diff(self.indptr[lo : hi + 1])), self.indices[a:b]] = self.data[a:b]
        return out if self.kind == "csr" else np.ascontiguousarray(out.T)

    def to_scipy(self):
        """A matrix of the sparse library, where it is installed."""
        import scipy.sparse as sp

        return (sp.csr_matrix if self.kind == "csr" else sp.csc_matrix)((self.data, self.indices, self.indptr), shape=self.shape)


def added(blocks: Sequence[Compressed]) -> Compressed:
    """The sum of matrices of one shape: cells that occur in several are added."""
    if len({b.shape for b in blocks}) != 1:
        raise ValueError("matrices of different shapes can't be added")
    i, j, d = (np.concatenate(x) for x in zip(*(b.to_coo() for b in blocks)))
    order = np.lexsort((j, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.zeros(0, np.int64)
    total = np.add.reduceat(d, first) if len(first) else d
    return Compressed.from_ijd(i[first], j[first], total, blocks[0].shape, blocks[0].kind)


def padded(block: Compressed, shape: tuple[int, int]) -> Compressed:
    """The matrix in a larger shape, rows and columns of zeros added at the ends."""
    if shape[0] < block.shape[0] or shape[1] < block.shape[1]:
        raise ValueError(f"{shape} is smaller than {block.shape}")
    return Compressed.from_ijd(*block.to_coo(), tuple(shape), block.kind)


def represented(table: pa.Table, shape: tuple[int, int], as_: str = "T", names: Sequence[str] = ("soma_dim_0", "soma_dim_1", "soma_data")) -> Compressed | tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A COO table as sorted triplets ("T"), by rows ("R") or by columns ("C")."""
    if as_ not in ("T", "R", "C"):
        raise ValueError(f"unknown form {as_!r}")
    m = compress(table, shape, "csc" if as_ == "C" else "csr", names)
    return m.to_coo() if as_ == "T" else m


@dataclass
class Labelled:
    """A compressed matrix with the labels of its rows and columns."""

    matrix: Compressed
    rows: list
    columns: list

    def __getitem__(self, at: tuple[object, object]) -> object:
        """The cell at a pair of labels, 0 where nothing is stored."""
        i, j = self.rows.index(at[0]), self.columns.index(at[1])
        major, minor = (i, j) if self.matrix.kind == "csr" else (j, i)
        lo, hi = self.matrix.indptr[major], self.matrix.indptr[major + 1]
        k = lo + np.searchsorted(self.matrix.indices[lo:hi], minor)
        return self.matrix.data[k] if k < hi and self.matrix.indices[k] == minor else self.matrix.data.dtype.type(0)


class IntIndexer:
    """Places of unique integer keys in the order given; -1 for keys that are absent."""

    def __init__(self, keys: object):
        self.keys = np.asarray(keys.to_numpy(zero_copy_only=False) if isinstance(keys, pa.Array | pa.ChunkedArray) else keys, dtype=np.int64)
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted = self.keys[self.order]
        if np.any(self.sorted[1:] == self.sorted[:-1]):
            raise ValueError("keys must be unique")

    def get_indexer(self, target: object) -> np.ndarray:
        target = np.asarray(target.to_numpy(zero_copy_only=False) if isinstance(target, pa.Array | pa.ChunkedArray) else target, dtype=np.int64)
        if not len(self.sorted):
            return np.full(len(target), -1)
        at = np.minimum(np.searchsorted(self.sorted, target), len(self.sorted) - 1)
        return np.where(self.sorted[at] == target, self.order[at], -1)


def compress(table: pa.Table, shape: tuple[int, int], kind: str = "csr", names: Sequence[str] = ("soma_dim_0", "soma_dim_1", "soma_data")) -> Compressed:
    i, j, d = (table[n].to_numpy() for n in names)
    return Compressed.from_ijd(i, j, d, shape, kind)


def dense_rows(table: pa.Table, ids: np.ndarray, width: int, dtype: object = np.float64) -> np.ndarray:
    """Rows of an embedding (soma_dim_0, soma_dim_1, soma_data) in the order of ids, absent components 0."""
    out = np.zeros((len(ids), width), dtype)
    i = IntIndexer(ids).get_indexer(table["soma_dim_0"])
    ok = i >= 0
    out[i[ok], table["soma_dim_1"].to_numpy()[ok]] = table["soma_data"].to_numpy()[ok]
    return out


def strides(coords: object, length: int, stride: int) -> Iterator[object]:
    """Consecutive pieces of a coordinate along one axis: closed slices of a slice, runs of a list of points."""
    if stride < 1:
        raise ValueError("the stride must be positive")
    if coords is None or isinstance(coords, slice):
        s = coords or slice(None)
        if s.step not in (None, 1):
            raise ValueError("slices with steps are not supported")
        lo = 0 if s.start is None else max(0, s.start)
        hi = length - 1 if s.stop is None else min(s.stop, length - 1)
        for at in range(lo, hi + 1, stride):
            yield slice(at, min(at + stride - 1, hi))
    else:
        points = list(coords) if hasattr(coords, "__len__") else [coords]
        for at in range(0, len(points), stride):
            yield points[at : at + stride]


def over_blocks(matrix: DataFrame, dim: str, size: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run `work` on each block of complete rows (or columns) in a task; the column `block` tells which it is.

    A block must fit into a task: choose `size` by the density of the matrix (see `rows_per_block`).
    """
    return matrix.withColumn("block", F.floor(F.col(dim) / size).cast("bigint")).groupBy("block").applyInArrow(work, schema)


#: cells of one block, about 80 % of a 1 GiB buffer
BLOCK_CELLS = 96 * 1024**2


def rows_per_block(rows: int, cells: int) -> int:
    """Rows of a block of about BLOCK_CELLS cells, in steps of 1,024; 32,768 where nothing is known."""
    if not cells:
        return 32_768
    return max(1024, round(rows * BLOCK_CELLS / cells / 1024) * 1024)
