"""Spot tables of spatial assays: positions next to barcodes, as an experiment's scene."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrella.api.collections import Experiment
from matrella.api.spatial import MultiscaleImage, PointCloudDataFrame, Scene
from matrella.sources.bundles import Source, write_experiment
from matrella.spatial.transforms import CoordinateSpace, IdentityTransform, ScaleTransform

#: columns of a spots file without a header, in their order
SPOT_COLUMNS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres")


def read_positions(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A spots file: barcode, in_tissue, array row and column, pixel row and column."""
    kinds = [T.StringType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(SPOT_COLUMNS, kinds)])
    return spark.read.csv(path, header=header, schema=schema)


def spots(positions: DataFrame, obs: DataFrame, obs_id: str = "obs_id", radius: float | None = None) -> DataFrame:
    """(x, y, soma_joinid, in_tissue, array_row, array_col[, radius]) of the spots that are observations."""
    ids = obs.select(F.col(obs_id).alias("barcode"), "soma_joinid")
    out = positions.join(ids, "barcode", "inner").select(F.col("pxl_col_in_fullres").alias("x"), F.col("pxl_row_in_fullres").alias("y"), "soma_joinid", "in_tissue", "array_row", "array_col")
    return out if radius is None else out.withColumn("radius", F.lit(float(radius)))


def presence(observed: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(soma_joinid, scene_id, data) of the observations of each scene."""
    out = None
    for scene, df in observed:
        part = df.select("soma_joinid", F.lit(scene).alias("scene_id"), F.lit(True).alias("data")).distinct()
        out = part if out is None else out.unionAll(part)
    return out


def with_regions(obs: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """obs with the columns of its region; more than one region row a key is an error."""
    twice = regions.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} = {twice[0][0]!r} has more than one region")
    return obs.join(regions, key, "left")


def write_spots(uri: str, source: Source, positions: DataFrame, scene_id: str, measurement_name: str = "RNA", *, radius: float | None = None, images: Mapping[str, np.ndarray] | None = None, scales: Mapping[str, float] | None = None, write_presence: bool = True, spark: SparkSession | None = None) -> str:
    """An assay with spots as an experiment: the source's tables, and a scene with the spots of its observations, their presence, and images.

    positions: as of `read_positions`.  images: pixels by name as (channel, y, x); scales: pixels of an image for one pixel of the full resolution (1 where absent).
    """
    write_experiment(uri, source, measurement_name, spark=spark)
    exp = Experiment.open(uri, "w", spark=spark)
    found = spots(positions, exp.reopen("r")["obs"].snapshot(), source.obs_id, radius)
    exp.reopen("w")
    scene = exp.add_new_collection("spatial").set(scene_id, Scene.create(f"{uri}/spatial/{scene_id}", coordinate_space=["x", "y"], spark=spark))[scene_id]
    box = found.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    n = exp["obs"].domain[0][1]
    domain = [(min(0.0, box[0] or 0.0), max(0.0, box[1] or 0.0)), (min(0.0, box[2] or 0.0), max(0.0, box[3] or 0.0)), (0, n)]
    schema = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("in_tissue", pa.int32()), ("array_row", pa.int32()), ("array_col", pa.int32())])
    obsl = scene.add_new_collection("obsl")
    loc = PointCloudDataFrame.create(f"{obsl.uri}/loc", schema=schema, domain=domain, spark=spark)
    obsl.set("loc", loc)
    if radius is not None:
        loc.metadata["soma_radius"] = float(radius)
    loc.write(found.drop("radius"))
    scene.set_transform("obsl", "loc", IdentityTransform(["x", "y"], ["x", "y"]))
    if images:
        img = scene.add_new_collection("img")
        for name, pixels in images.items():
            image = MultiscaleImage.create(f"{img.uri}/{name}", type=pa.from_numpy_dtype(pixels.dtype), level_shape=pixels.shape, coordinate_space=CoordinateSpace(["x", "y"]), spark=spark)
            image["level0"].write((), pixels)
            img.set(name, image)
            k = float((scales or {}).get(name, 1.0))
            scene.set_transform("img", name, ScaleTransform(["x", "y"], ["x", "y"], [k, k]))
    if write_presence:
        frame = exp.add_new_dataframe("obs_spatial_presence", schema=pa.schema([("scene_id", pa.string()), ("data", pa.bool_())]), index_column_names=["soma_joinid", "scene_id"], domain=[(0, n), ("", "")])
        frame.write(presence([(scene_id, found)]))
    return uri


__all__ = ["SPOT_COLUMNS", "presence", "read_positions", "spots", "with_regions", "write_spots"]
