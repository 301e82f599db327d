"""Coordinate selection: which keys of which index columns a read wants.

All slices are closed on both ends; steps are not supported.  Fewer coordinates than index columns leave the rest unrestricted.
An empty list of points selects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parquet turns a membership test into row-group filters up to this many values; longer lists become a join.
MAX_IN = 10
#: A longer list is broadcast up to this many points (8 MB of keys), beyond that joined by a shuffle.
MAX_BROADCAST = 1_000_000


@dataclass(frozen=True)
class SliceSelection:
    """A closed range of keys; None leaves an end open."""

    start: object = None
    stop: object = None


@dataclass(frozen=True)
class PointSelection:
    """A set of keys."""

    points: Sequence


def points_of(coord: object) -> list | None:
    """The points of a list-like coordinate, None if it isn't one."""
    if isinstance(coord, pa.ChunkedArray | pa.Array):
        return coord.to_pylist()
    if isinstance(coord, np.ndarray):
        if coord.ndim != 1:
            raise ValueError("only one-dimensional arrays of points are supported")
        return coord.tolist()
    if isinstance(coord, list | tuple | range | set | frozenset):
        return [c.item() if isinstance(c, np.generic) else c for c in coord]
    return None


def _plain(value: object) -> object:
    if isinstance(value, np.datetime64):
        return value.astype("datetime64[us]").item()
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, pa.Scalar):
        return value.as_py()
    return value


def check_coords(coords: object, ndim: int, names: Sequence[str] | None = None) -> list:
    """Coordinates padded with "all" to one for each index column; they may be given by the columns' names instead, in any order."""
    if isinstance(coords, Mapping):
        if names is None or (unknown := [n for n in coords if n not in names]):
            raise ValueError(f"no such index columns: {', '.join(map(str, coords if names is None else unknown))}")
        coords = [coords.get(n) for n in names]
    if isinstance(coords, str | bytes) or not isinstance(coords, Sequence):
        raise TypeError("coords must be a sequence with one entry for each index column")
    if len(coords) > ndim:
        raise ValueError(f"{len(coords)} coordinates for {ndim} index columns")
    return [_selection(c) for c in coords] + [None] * (ndim - len(coords))


def _selection(coord: object) -> object:
    if isinstance(coord, SliceSelection):
        return slice(coord.start, coord.stop)
    return list(coord.points) if isinstance(coord, PointSelection) else coord


def _bound(value: object, kind: T.DataType) -> Column:
    value = _plain(value)
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        if isinstance(value, int):
            value = datetime(1970, 1, 1) + timedelta(microseconds=value)
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def slice_bounds(s: slice, domain: tuple | None, name: str = "") -> tuple[object, object]:
    """Closed bounds, clamped to the domain; an error where they don't overlap it."""
    if s.step not in (None, 1):
        raise ValueError("slices with steps are not supported")
    lo, hi = _plain(s.start), _plain(s.stop)
    if lo is not None and hi is not None and lo > hi:
        raise ValueError(f"slice {lo}..{hi} of {name} is inverted")
    if isinstance(lo, int) and lo < 0 and domain is not None and isinstance(domain[0], int) and domain[0] >= 0 and not isinstance(lo, bool):
        raise ValueError("negative indexing is not supported")
    if domain is not None and domain[0] is not None and not isinstance(domain[0], str | bytes):
        if (lo is not None and lo > domain[1]) or (hi is not None and hi < domain[0]):
            raise ValueError(f"slice {lo}..{hi} of {name} doesn't overlap the domain {domain[0]}..{domain[1]}")
        lo = domain[0] if lo is None else max(lo, domain[0])
        hi = domain[1] if hi is None else min(hi, domain[1])
    return lo, hi


def select_coords(df: DataFrame, dims: Sequence[str], coords: object = (), domain: Sequence[tuple] | None = None) -> DataFrame:
    """Rows of df whose index columns lie in the coordinates."""
    for k, (name, coord) in enumerate(zip(dims, check_coords(coords, len(dims), dims))):
        dom = domain[k] if domain else None
        kind = df.schema[name].dataType
        col = F.col(f"`{name}`")
        if coord is None or coord is Ellipsis:
            continue
        if isinstance(coord, slice):
            if coord == slice(None):
                continue
            lo, hi = slice_bounds(coord, dom, name)
            if lo is not None:
                df = df.where(col >= _bound(lo, kind))
            if hi is not None:
                df = df.where(col <= _bound(hi, kind))
        elif (points := points_of(coord)) is not None:
            points = list(dict.fromkeys(map(_plain, points)))
            if not points:
                df = df.where(F.lit(False))
            elif len(points) <= MAX_IN:
                df = df.where(col.isin([_bound(p, kind) for p in points]))
            else:
                ids = df.sparkSession.createDataFrame(pa.table({"__point": pa.array(points)})).select(F.col("__point").cast(kind).alias("__point"))
                ids = F.broadcast(ids) if len(points) <= MAX_BROADCAST else ids
                df = df.join(ids, col == ids["__point"], "left_semi")
        elif isinstance(coord, DataFrame):
            ids = coord.select(F.col(coord.columns[0]).cast(kind).alias("__point"))
            df = df.join(ids, col == ids["__point"], "left_semi")
        else:
            df = df.where(col == _bound(coord, kind))
    return df
