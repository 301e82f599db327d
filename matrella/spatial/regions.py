"""Region reads: points in a box, envelopes that overlap a box, pixels of a box.

A region is (low_1, ..., low_n, high_1, ..., high_n).  Only boxes are accepted; other shapes are refused rather than reduced to their box.
Null coordinates lie in no region.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrella.spatial.transforms import AffineTransform


def box_of(region: Sequence[float] | None, ndim: int) -> tuple[list[float | None], list[float | None]]:
    if region is None:
        return [None] * ndim, [None] * ndim
    if not isinstance(region, list | tuple | np.ndarray) or len(region) != 2 * ndim:
        raise NotImplementedError(f"a region must be a box of {2 * ndim} numbers")
    low, high = list(map(float, region[:ndim])), list(map(float, region[ndim:]))
    if any(a > b for a, b in zip(low, high)):
        raise ValueError(f"the region {region} is inverted")
    return low, high


def points_in(df: DataFrame, axes: Sequence[str], region: Sequence[float] | None, region_transform: AffineTransform | None = None) -> DataFrame:
    """Rows whose point lies in the closed box; region_transform maps data coordinates to those of the region."""
    low, high = box_of(region, len(axes))
    if region is not None and region_transform is not None:
        a, b = region_transform.inverse_transform().box(low, high)
        low, high = a.tolist(), b.tolist()
    for axis, lo, hi in zip(axes, low, high):
        whole = isinstance(df.schema[axis].dataType, T.IntegralType)
        if lo is not None:
            df = df.where(F.col(axis) >= (math.ceil(lo) if whole else lo))
        if hi is not None:
            df = df.where(F.col(axis) <= (math.floor(hi) if whole else hi))
    return df


def boxes_overlapping(df: DataFrame, axes: Sequence[str], region: Sequence[float] | None, low_suffix: str = "__min", high_suffix: str = "__max") -> DataFrame:
    """Rows whose envelope (two columns an axis) overlaps the closed box."""
    low, high = box_of(region, len(axes))
    for axis, lo, hi in zip(axes, low, high):
        if hi is not None:
            df = df.where(F.col(axis + low_suffix) <= hi)
        if lo is not None:
            df = df.where(F.col(axis + high_suffix) >= lo)
    return df


def pixel_box(region: Sequence[float] | None, shape: Sequence[int]) -> list[tuple[int, int]]:
    """Closed pixel ranges of a box in pixel coordinates, rounded outward so that partial pixels are in, and cut at the image."""
    low, high = box_of(region, len(shape))
    return [(0 if lo is None else max(0, math.floor(lo)), n - 1 if hi is None else min(n - 1, math.ceil(hi) - 1 if hi > (lo or 0) else math.floor(hi))) for lo, hi, n in zip(low, high, shape)]
