"""Spatial objects: point clouds, geometries, multiscale images and scenes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame as Frame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matrella.api.collections import Collection
from matrella.api.objects import DataFrame, DenseNDArray, StoredObject, TableRead
from matrella.operators import core
from matrella.spatial.regions import boxes_overlapping, pixel_box, points_in
from matrella.spatial.transforms import AffineTransform, CoordinateSpace, IdentityTransform, ScaleTransform, level_scale, transform_from_json
from matrella.spatial.wkb import outlines_to_geometry, with_envelope


def _space(owner: StoredObject) -> CoordinateSpace:
    return CoordinateSpace.from_json(owner.metadata["soma_coordinate_space"])


class PointCloudDataFrame(DataFrame):
    """Points by their coordinates and soma_joinid."""

    kind = "PointCloudDataFrame"

    @classmethod
    def create(cls, uri: str, *, schema: pa.Schema, coordinate_space: CoordinateSpace | Sequence[str] = ("x", "y"), domain: Sequence | None = None, spark: SparkSession | None = None, timestamp: int | None = None) -> PointCloudDataFrame:
        space = coordinate_space if isinstance(coordinate_space, CoordinateSpace) else CoordinateSpace(coordinate_space)
        kinds = {str(schema.field(a).type) for a in space.axis_names}
        if len(kinds) != 1 or not kinds <= {"double", "float", "int8", "int16", "int32", "int64"}:
            raise ValueError("all axes must share one integer or float type")
        if "soma_joinid" not in schema.names:
            schema = schema.append(pa.field("soma_joinid", pa.int64(), False))
        out = super().create(uri, schema=schema, index_column_names=[*space.axis_names, "soma_joinid"], domain=domain or [None] * (len(space) + 1), spark=spark, timestamp=timestamp)
        out.metadata["soma_coordinate_space"] = space.to_json()
        return out

    @property
    def coordinate_space(self) -> CoordinateSpace:
        return _space(self)

    def read_spatial_region(self, region: Sequence[float] | None = None, column_names: Sequence[str] | None = None, *, region_transform: AffineTransform | None = None, value_filter: str | None = None, result_order: str = "auto") -> TableRead:
        """Points in a closed box; region_transform maps data coordinates to those of the region."""
        if region_transform is not None and not isinstance(region_transform, ScaleTransform):
            raise NotImplementedError("a region of points may be scaled only")
        df = points_in(self.snapshot(), self.coordinate_space.axis_names, region, region_transform)
        return TableRead(core.in_order(core.read_rows(df, column_names, value_filter), [f"`{k}`" for k in self.state.index] if column_names is None else list(column_names)[:1], result_order))


class GeometryDataFrame(DataFrame):
    """Well-known binary geometries with their envelope; rows are keyed by envelope and soma_joinid."""

    kind = "GeometryDataFrame"
    _reserved = ("soma_geometry",)

    @classmethod
    def create(cls, uri: str, *, schema: pa.Schema, coordinate_space: CoordinateSpace | Sequence[str] = ("x", "y"), spark: SparkSession | None = None, timestamp: int | None = None, **_: object) -> GeometryDataFrame:
        space = coordinate_space if isinstance(coordinate_space, CoordinateSpace) else CoordinateSpace(coordinate_space)
        if len(space) != 2:
            raise NotImplementedError("geometries lie in two dimensions")
        if "soma_geometry" not in schema.names:
            schema = schema.append(pa.field("soma_geometry", pa.binary(), False))
        if "soma_joinid" not in schema.names:
            schema = schema.append(pa.field("soma_joinid", pa.int64(), False))
        hidden = [f"{a}__{b}" for a in space.axis_names for b in ("min", "max")]
        for n in hidden:
            schema = schema.append(pa.field(n, pa.float64(), False))
        out = super().create(uri, schema=schema, index_column_names=["soma_joinid"], domain=[(0, 2**63 - 2)], spark=spark, timestamp=timestamp)
        out.metadata["soma_coordinate_space"] = space.to_json()
        return out

    @property
    def coordinate_space(self) -> CoordinateSpace:
        return _space(self)

    def _completed(self, df: Frame) -> Frame:
        return with_envelope(df, axes=self.coordinate_space.axis_names)

    def from_outlines(self, values: Frame, outline: str = "soma_geometry") -> GeometryDataFrame:
        """Write polygons given as outlines [x0, y0, x1, y1, ...]."""
        df = outlines_to_geometry(values.withColumnRenamed(outline, "__outline"), "__outline", self.coordinate_space.axis_names).drop("__outline")
        self._write(df)
        return self

    def read_spatial_region(self, region: Sequence[float] | None = None, column_names: Sequence[str] | None = None, *, value_filter: str | None = None) -> TableRead:
        """Rows whose envelope overlaps a closed box."""
        df = boxes_overlapping(self.snapshot(), self.coordinate_space.axis_names, region)
        hidden = [f"{a}__{b}" for a in self.coordinate_space.axis_names for b in ("min", "max")]
        return TableRead(core.read_rows(df, column_names or [c for c in df.columns if c not in hidden], value_filter))

    def delete_cells(self, *_: object, **__: object) -> None:
        raise NotImplementedError("rows of a geometry frame can't be deleted")


class MultiscaleImage(Collection):
    """Levels of one image, from large to small."""

    kind = "MultiscaleImage"

    @classmethod
    def create(cls, uri: str, *, type: pa.DataType, level_shape: Sequence[int], level_key: str = "level0", coordinate_space: CoordinateSpace | Sequence[str] = ("x", "y"), data_axis_order: Sequence[str] = ("c", "y", "x"), spark: SparkSession | None = None, timestamp: int | None = None) -> MultiscaleImage:
        out = cls._create(uri, spark, timestamp, options={"type": str(type), "axes": list(data_axis_order)})
        space = coordinate_space if isinstance(coordinate_space, CoordinateSpace) else CoordinateSpace(coordinate_space)
        out.metadata["soma_coordinate_space"] = space.to_json()
        out.add_new_level(level_key, shape=level_shape)
        return out

    @property
    def coordinate_space(self) -> CoordinateSpace:
        return _space(self)

    def add_new_level(self, key: str, *, shape: Sequence[int]) -> DenseNDArray:
        if len(shape) != len(self.state.options["axes"]):
            raise ValueError("a level has one size for each axis")
        return self.add_new_dense_ndarray(key, type=pa.type_for_alias(self.state.options["type"]), shape=tuple(shape))

    def levels(self) -> list[tuple[str, tuple[int, ...]]]:
        """(key, shape), by descending size, then by name."""
        got = [(k, self[k].shape) for k in self.keys()]
        return sorted(got, key=lambda x: ([-n for n in x[1]], x[0]))

    @property
    def level_count(self) -> int:
        return len(self.levels())

    def _level(self, level: int | str) -> tuple[str, tuple[int, ...]]:
        got = self.levels()
        return got[level] if isinstance(level, int) else next(x for x in got if x[0] == level)

    def _spatial(self, shape: Sequence[int]) -> list[int]:
        by = dict(zip(self.state.options["axes"], shape))
        return [by[a] for a in self.coordinate_space.axis_names]

    def get_transform_from_level(self, level: int | str) -> ScaleTransform:
        names = self.coordinate_space.axis_names
        return ScaleTransform(names, names, level_scale(self._spatial(self._level(level)[1]), self._spatial(self.levels()[0][1])))

    def get_transform_to_level(self, level: int | str) -> ScaleTransform:
        return self.get_transform_from_level(level).inverse_transform()

    def read_spatial_region(self, level: int | str, region: Sequence[float] | None = None, *, channel_coords: object = None) -> tuple[pa.Tensor, AffineTransform]:
        """Pixels of a box given in the coordinates of the largest level, partial pixels included, and the transform from these pixels to the region."""
        key, shape = self._level(level)
        names, axes = self.coordinate_space.axis_names, self.state.options["axes"]
        if region is not None:
            low, high = self.get_transform_to_level(level).box(region[: len(names)], region[len(names) :])
            region = [*low, *high]
        box = dict(zip(names, pixel_box(region, self._spatial(shape))))
        coords = [channel_coords if a not in box else slice(*box[a]) for a in axes]
        back = self.get_transform_from_level(level)
        origin = [box[a][0] for a in names]
        moved = AffineTransform(names, names, [[s if i == j else 0 for j in range(len(names))] + [s * origin[i]] for i, s in enumerate(back.linear.diagonal())] + [[0] * len(names) + [1]])
        return self[key].read(coords), moved


class Scene(Collection):
    """A coordinate space with images, and annotations of observations and variables, each with its transform."""

    kind = "Scene"
    slots = {"img": ("Collection",), "obsl": ("Collection",), "varl": ("Collection",)}

    @classmethod
    def create(cls, uri: str, *, coordinate_space: CoordinateSpace | Sequence[str] | None = None, spark: SparkSession | None = None, timestamp: int | None = None) -> Scene:
        out = cls._create(uri, spark, timestamp)
        if coordinate_space is not None:
            out.coordinate_space = coordinate_space
        return out

    @property
    def coordinate_space(self) -> CoordinateSpace | None:
        return _space(self) if "soma_coordinate_space" in self.metadata else None

    @coordinate_space.setter
    def coordinate_space(self, value: CoordinateSpace | Sequence[str]) -> None:
        space = value if isinstance(value, CoordinateSpace) else CoordinateSpace(value)
        self.metadata["soma_coordinate_space"] = space.to_json()

    def set_transform(self, slot: str, key: str, transform: AffineTransform) -> None:
        """The transform from the scene to a member."""
        if slot not in self.slots or slot not in self or key not in self[slot]:
            raise KeyError(f"no {key!r} in {slot!r}")
        if self.coordinate_space is None or transform.input_axes != self.coordinate_space.axis_names:
            raise ValueError("the transform must start from the scene's axes")
        self[slot].metadata[f"soma_scene_registry_{key}"] = transform.to_json()

    def get_transform_to(self, slot: str, key: str) -> AffineTransform:
        text = self[slot].metadata.get(f"soma_scene_registry_{key}")
        if text is None:
            raise KeyError(f"no transform for {key!r} in {slot!r}")
        return transform_from_json(text)

    def get_transform_from(self, slot: str, key: str) -> AffineTransform:
        return self.get_transform_to(slot, key).inverse_transform()


def points_export(df: Frame, axes: Sequence[str], to_scene: AffineTransform | None = None) -> Frame:
    """Points in the scene's coordinates, as (axes..., soma_joinid, other columns)."""
    move = to_scene or IdentityTransform(axes, axes)
    return move.columns(df)


def shapes_export(df: Frame, axes: Sequence[str], radius: float) -> Frame:
    """Points as circles: (axes..., radius, soma_joinid, other columns)."""
    return df.withColumn("radius", F.lit(float(radius)))


def image_export(image: MultiscaleImage, level: int | str = 0, to_scene: AffineTransform | None = None) -> tuple[pa.Tensor, AffineTransform]:
    """All pixels of a level, and the transform from them to the scene (to the largest level where the image has none)."""
    pixels, back = image.read_spatial_region(level)
    return pixels, back if to_scene is None else to_scene @ back


def scene_export(scene: Scene, ids: Frame | None = None, radius: float | None = None, level: int | str = 0) -> dict[str, dict[str, object]]:
    """Members of a scene in its coordinates; of observations only those of the ids, if ids are given."""
    axes = scene.coordinate_space.axis_names

    def back(slot: str, key: str) -> AffineTransform | None:
        return scene.get_transform_from(slot, key) if f"soma_scene_registry_{key}" in scene[slot].metadata else None

    out: dict[str, dict[str, object]] = {"points": {}, "shapes": {}, "images": {}}
    for slot in ("obsl", "varl"):
        for key, m in scene[slot].items() if slot in scene else ():
            if isinstance(m, PointCloudDataFrame):
                df = m.snapshot() if ids is None or slot == "varl" else m.snapshot({"soma_joinid": ids})
                moved = points_export(df, m.coordinate_space.axis_names, back(slot, key))
                far = m.metadata.get("soma_radius", radius)
                out["points" if far is None else "shapes"][key] = moved if far is None else shapes_export(moved, axes, far)
            elif isinstance(m, GeometryDataFrame):
                df = m.read_spatial_region().df
                out["shapes"][key] = df if ids is None or slot == "varl" else core.semi(df, "soma_joinid", ids)
    for key, m in scene["img"].items() if "img" in scene else ():
        out["images"][key] = image_export(m, level, back("img", key))
    return out


__all__ = ["image_export", "scene_export", "GeometryDataFrame", "MultiscaleImage", "PointCloudDataFrame", "Scene", "points_export", "shapes_export"]
