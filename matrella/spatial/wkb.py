"""Well-known binary geometries: polygons from outlines, and the envelope of any geometry."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the format: kinds of geometry
POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION = range(1, 8)


def polygon_wkb(outline: np.ndarray) -> bytes:
    """A polygon of one ring; the ring is closed if it isn't."""
    ring = np.asarray(outline, float).reshape(-1, 2)
    if len(ring) < 3:
        raise ValueError("an outline needs three points")
    if not np.array_equal(ring[0], ring[-1]):
        ring = np.vstack([ring, ring[:1]])
    return struct.pack("<BIII", 1, POLYGON, 1, len(ring)) + ring.astype("<f8").tobytes()


def point_wkb(*xy: float) -> bytes:
    return struct.pack("<BI", 1, POINT) + np.asarray(xy, "<f8").tobytes()


def _coordinates(blob: bytes, at: int) -> tuple[list[np.ndarray], int]:
    order = "<" if blob[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", blob, at + 1)[0]
    at += 5
    if kind & 0x20000000:  # a spatial reference is given
        at += 4
    extra = bool(kind & 0x80000000) + bool(kind & 0x40000000)
    kind &= 0x0FFFFFFF
    width = 2 + extra + (0, 1, 1, 2)[kind // 1000]
    kind %= 1000

    def points(n: int, at: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(blob, order + "f8", n * width, at).reshape(n, width), at + 8 * n * width

    def number(at: int) -> int:
        return struct.unpack_from(order + "I", blob, at)[0]

    if kind == POINT:
        got, at = points(1, at)
        return [got], at
    if kind == LINESTRING:
        got, at = points(number(at), at + 4)
        return [got], at
    out: list[np.ndarray] = []
    n, at = number(at), at + 4
    if kind == POLYGON:
        for _ in range(n):
            got, at = points(number(at), at + 4)
            out.append(got)
        return out, at
    if MULTIPOINT <= kind <= COLLECTION:
        for _ in range(n):
            got, at = _coordinates(blob, at)
            out += got
        return out, at
    raise ValueError(f"unknown kind of geometry {kind}")


def envelope(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest x and y of a geometry; NaN where it is empty."""
    parts, _ = _coordinates(blob, 0)
    flat = np.vstack([p[:, :2] for p in parts]) if parts else np.zeros((0, 2))
    flat = flat[~np.isnan(flat).any(axis=1)]
    return (flat.min(0), flat.max(0)) if len(flat) else (np.full(2, np.nan), np.full(2, np.nan))


def with_envelope(df: DataFrame, geometry: str = "soma_geometry", axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with <axis>__min and <axis>__max of its geometry column; null for null or empty geometries."""
    names = [f"{a}__{b}" for a in axes for b in ("min", "max")]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.full((b.num_rows, 4), np.nan)
            for k, g in enumerate(b.column(geometry).to_pylist()):
                if g is not None:
                    low, high = envelope(bytes(g))
                    rows[k] = low[0], high[0], low[1], high[1]
            cols = [pa.array(rows[:, k], mask=np.isnan(rows[:, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def _every_other(k: int):
    return lambda _, i: i % 2 == k


def outlines_to_geometry(df: DataFrame, outline: str = "outline", axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with soma_geometry (a polygon) and its envelope for outlines [x0, y0, x1, y1, ...]; the envelope stays in the engine."""
    o = F.col(outline)
    for k, axis in enumerate(axes):
        part = F.filter(o, _every_other(k))
        df = df.withColumn(f"{axis}__min", F.array_min(part)).withColumn(f"{axis}__max", F.array_max(part))
    schema = T.StructType([*df.schema.fields, T.StructField("soma_geometry", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = pa.array([None if x is None else polygon_wkb(np.array(x)) for x in b.column(outline).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, blobs], [*b.schema.names, "soma_geometry"])

    return df.mapInArrow(run, schema)
