"""Coordinate spaces and affine transforms: small value classes on the driver, applied to frames as column arithmetic.

Affine contains Scale contains UniformScale contains Identity.  `b @ a` first applies a, then b.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    name: str
    unit: str | None = None

    def __post_init__(self) -> None:
        if not self.name or self.name.startswith("soma_"):
            raise ValueError(f"{self.name!r} can't name an axis")


@dataclass(frozen=True)
class CoordinateSpace:
    axes: tuple[Axis, ...]

    def __init__(self, axes: Sequence[Axis | str]):
        got = tuple(a if isinstance(a, Axis) else Axis(a) for a in axes)
        if not got:
            raise ValueError("a coordinate space needs an axis")
        if len({a.name for a in got}) != len(got):
            raise ValueError("axis names must be unique")
        object.__setattr__(self, "axes", got)

    @property
    def axis_names(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.axes)

    def __len__(self) -> int:
        return len(self.axes)

    def to_json(self) -> str:
        return json.dumps([{"name": a.name, "unit": a.unit} for a in self.axes])

    @staticmethod
    def from_json(text: str) -> CoordinateSpace:
        return CoordinateSpace([Axis(a["name"], a.get("unit")) for a in json.loads(text)])


class AffineTransform:
    """output = matrix @ input + offset, between named axes."""

    def __init__(self, input_axes: Sequence[str], output_axes: Sequence[str], matrix: object):
        self.input_axes, self.output_axes = tuple(input_axes), tuple(output_axes)
        m = np.array(matrix, dtype=float)
        rows, cols = len(self.output_axes), len(self.input_axes)
        if m.shape == (rows, cols):
            m = np.hstack([m, np.zeros((rows, 1))])
        elif m.shape == (rows + 1, cols + 1):
            if not np.array_equal(m[-1], np.eye(cols + 1)[-1]):
                raise ValueError("the last row of an augmented matrix must be 0 ... 0 1")
            m = m[:-1]
        if m.shape != (rows, cols + 1):
            raise ValueError(f"a matrix of shape {np.shape(matrix)} doesn't map {cols} axes to {rows}")
        self._linear, self._offset = m[:, :-1], m[:, -1]

    @property
    def linear(self) -> np.ndarray:
        return self._linear

    @property
    def offset(self) -> np.ndarray:
        return self._offset

    @property
    def augmented_matrix(self) -> np.ndarray:
        out = np.zeros((len(self.output_axes) + 1, len(self.input_axes) + 1))
        out[:-1, :-1], out[:-1, -1], out[-1, -1] = self.linear, self.offset, 1
        return out

    def __matmul__(self, first: AffineTransform) -> AffineTransform:
        if first.output_axes != self.input_axes:
            raise ValueError(f"axes don't meet: {first.output_axes} and {self.input_axes}")
        return simplest(first.input_axes, self.output_axes, (self.augmented_matrix @ first.augmented_matrix)[:-1])

    def inverse_transform(self) -> AffineTransform:
        if len(self.input_axes) != len(self.output_axes):
            raise ValueError("only transforms between equally many axes have an inverse")
        back = np.linalg.inv(self.linear)
        return simplest(self.output_axes, self.input_axes, np.hstack([back, -(back @ self.offset)[:, None]]))

    def apply(self, points: object) -> np.ndarray:
        return np.asarray(points, dtype=float) @ self.linear.T + self.offset

    def columns(self, df: DataFrame) -> DataFrame:
        """df with the output axes computed from its input axes; other columns stay."""
        out = {}
        for name, row, off in zip(self.output_axes, self.linear, self.offset):
            total = F.lit(float(off))
            for a, w in zip(self.input_axes, row):
                total = total + F.col(f"`{a}`").cast("double") * F.lit(float(w))
            out[name] = total
        return df.withColumns(out)

    def box(self, low: Sequence[float], high: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """The bounding box of a transformed box."""
        corners = np.array(np.meshgrid(*zip(low, high))).reshape(len(low), -1).T
        moved = self.apply(corners)
        return moved.min(axis=0), moved.max(axis=0)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, AffineTransform) and (self.input_axes, self.output_axes) == (other.input_axes, other.output_axes) and np.allclose(self.augmented_matrix, other.augmented_matrix)

    __hash__ = None

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.input_axes} -> {self.output_axes}, {self.augmented_matrix.tolist()})"

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__, "input_axes": self.input_axes, "output_axes": self.output_axes, "matrix": self.augmented_matrix.tolist()})


class ScaleTransform(AffineTransform):
    def __init__(self, input_axes: Sequence[str], output_axes: Sequence[str], scale: Sequence[float]):
        scale = np.asarray(scale, dtype=float)
        if scale.shape != (len(input_axes),) or len(input_axes) != len(output_axes):
            raise ValueError("one scale factor is needed for each axis")
        super().__init__(input_axes, output_axes, np.diag(scale))

    @property
    def scale_factors(self) -> np.ndarray:
        return np.diag(self.linear)


class UniformScaleTransform(ScaleTransform):
    def __init__(self, input_axes: Sequence[str], output_axes: Sequence[str], scale: float):
        super().__init__(input_axes, output_axes, [float(scale)] * len(input_axes))

    @property
    def scale(self) -> float:
        return float(self.linear[0, 0])


class IdentityTransform(UniformScaleTransform):
    def __init__(self, input_axes: Sequence[str], output_axes: Sequence[str]):
        super().__init__(input_axes, output_axes, 1.0)


def simplest(input_axes: Sequence[str], output_axes: Sequence[str], matrix: np.ndarray) -> AffineTransform:
    """The narrowest class that holds a matrix of shape (n, m + 1)."""
    linear, offset = matrix[:, :-1], matrix[:, -1]
    if linear.shape[0] == linear.shape[1] and not offset.any() and np.array_equal(linear, np.diag(np.diag(linear))):
        d = np.diag(linear)
        if np.all(d == d[0]):
            return IdentityTransform(input_axes, output_axes) if d[0] == 1 else UniformScaleTransform(input_axes, output_axes, d[0])
        return ScaleTransform(input_axes, output_axes, d)
    return AffineTransform(input_axes, output_axes, np.vstack([matrix, np.eye(matrix.shape[1])[-1]]))


def transform_from_json(text: str) -> AffineTransform:
    got = json.loads(text)
    return simplest(got["input_axes"], got["output_axes"], np.array(got["matrix"])[:-1])


def level_scale(from_shape: Sequence[int], to_shape: Sequence[int]) -> list[float]:
    """Scale factors from one image level to another: ratios of their shapes in axis order."""
    return [t / f for f, t in zip(from_shape, to_shape)]
