"""The objects a user works with."""

from matrella.api.collections import Collection, EphemeralCollection, EphemeralExperiment, EphemeralMeasurement, Experiment, Measurement, exists, open_object
from matrella.api.objects import BatchSize, DataFrame, DenseNDArray, IOfN, SparseNDArray, WriteOptions
from matrella.api.query import AxisQuery, Bundle, ExperimentAxisQuery, X_as_series
from matrella.api.spatial import GeometryDataFrame, MultiscaleImage, PointCloudDataFrame, Scene

__all__ = [
    "AxisQuery", "BatchSize", "Bundle", "Collection", "DataFrame", "DenseNDArray", "EphemeralCollection", "EphemeralExperiment", "EphemeralMeasurement", "Experiment", "ExperimentAxisQuery",
    "GeometryDataFrame", "IOfN", "Measurement", "MultiscaleImage", "PointCloudDataFrame", "Scene", "SparseNDArray", "WriteOptions", "X_as_series", "exists", "open_object",
]
