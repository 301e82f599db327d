"""Collections of stored objects, and the experiment's fixed slots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

from pyspark.sql import SparkSession

from matrella.api.objects import DataFrame, DenseNDArray, SparseNDArray, StoredArray, StoredObject, session
from matrella.errors import MatrellaError
from matrella.store.log import Log


def sanitize_key(key: str) -> str:
    """A key as a path element: everything but letters, digits and a few signs percent-encoded."""
    if key in (".", ".."):
        raise ValueError(f"{key!r} can't be a key")
    return quote(key, safe=" -_.()^!@+={}~'")


class Collection(StoredObject):
    """A persistent map of string keys to objects, opened when they are first asked for.  A key can't be set twice."""

    kind = "Collection"
    slots: dict[str, tuple[str, ...]] = {}

    @classmethod
    def create(cls, uri: str, *, spark: SparkSession | None = None, timestamp: int | None = None):
        return cls._create(uri, spark, timestamp)

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self._open: dict[str, StoredObject] = {}

    def members(self) -> dict[str, tuple[str, str]]:
        """key -> (uri, kind)."""
        return {k: (self._uri(u), Log(self.spark, self._uri(u)).state().kind) for k, u in self.state.members.items()}

    def _uri(self, stored: str) -> str:
        return stored if "/" in stored else f"{self.uri}/{stored}"

    def __getitem__(self, key: str) -> StoredObject:
        if key not in self.state.members:
            raise KeyError(f"{key!r} is not in {self.uri}")
        if key not in self._open:
            self._open[key] = open_object(self._uri(self.state.members[key]), self.mode, spark=self.spark, timestamp=self.timestamp)
        return self._open[key]

    def __contains__(self, key: str) -> bool:
        return key in self.state.members

    def __iter__(self) -> Iterator[str]:
        return iter(dict(self.state.members))

    def __len__(self) -> int:
        return len(self.state.members)

    def keys(self) -> list[str]:
        return list(self.state.members)

    def items(self) -> list[tuple[str, StoredObject]]:
        return [(k, self[k]) for k in self.keys()]

    def get(self, key: str, default: object = None) -> object:
        return self[key] if key in self else default

    def set(self, key: str, value: StoredObject) -> Collection:
        self.need("w")
        if key in self.state.members:
            raise MatrellaError(f"{key!r} is set already")
        allowed = self.slots.get(key)
        if allowed and value.kind not in allowed:
            raise TypeError(f"{key!r} takes {' or '.join(allowed)}, not {value.kind}")
        inside = value.uri.rsplit("/", 1)
        self.record({"op": "member", "key": key, "uri": inside[1] if inside[0] == self.uri else value.uri})
        self._open[key] = value
        return self

    __setitem__ = set

    def __delitem__(self, key: str) -> None:
        self.need("d")
        if key not in self.state.members:
            raise KeyError(key)
        self.record({"op": "member", "key": key, "gone": True})
        self._open.pop(key, None)

    def _add(self, cls: type, key: str, **args: object):
        self.need("w")
        if key in self.state.members:
            raise MatrellaError(f"{key!r} is set already")
        made = cls.create(f"{self.uri}/{sanitize_key(key)}", spark=self.spark, timestamp=self.timestamp, **args)
        self.set(key, made)
        return made

    def add_new_collection(self, key: str, kind: type | None = None):
        return self._add(kind or Collection, key)

    def add_new_dataframe(self, key: str, **args: object) -> DataFrame:
        return self._add(DataFrame, key, **args)

    def add_new_sparse_ndarray(self, key: str, **args: object) -> SparseNDArray:
        return self._add(SparseNDArray, key, **args)

    def add_new_dense_ndarray(self, key: str, **args: object) -> DenseNDArray:
        return self._add(DenseNDArray, key, **args)

    def reopen(self, mode: str, timestamp: int | None = None):
        self._open = {}
        return super().reopen(mode, timestamp)

    def close(self) -> None:
        for m in self._open.values():
            m.close()
        super().close()

    def __getattr__(self, name: str):
        if name in type(self).slots:
            try:
                return self[name]
            except KeyError:
                raise AttributeError(name) from None
        raise AttributeError(name)


class EphemeralCollection(dict):
    """A collection that is nowhere stored: string keys, stored objects or further such collections, no key set twice."""

    kind = "Collection"
    slots: dict[str, tuple[str, ...]] = {}

    def set(self, key: str, value: object) -> EphemeralCollection:
        if key in self:
            raise MatrellaError(f"{key!r} is set already")
        allowed = self.slots.get(key)
        if allowed and value.kind not in allowed:
            raise TypeError(f"{key!r} takes {' or '.join(allowed)}, not {value.kind}")
        super().__setitem__(key, value)
        return self

    __setitem__ = set

    def store(self, uri: str, *, spark: SparkSession | None = None) -> Collection:
        """The same collection at a place."""
        out = kinds()[self.kind.lower()].create(uri, spark=spark)
        for key, value in self.items():
            out.set(key, value.store(f"{out.uri}/{sanitize_key(key)}", spark=spark) if isinstance(value, EphemeralCollection) else value)
        return out


class Measurement(Collection):
    kind = "Measurement"
    slots = {"var": ("DataFrame",)} | {s: ("Collection",) for s in ("X", "obsm", "obsp", "varm", "varp")} | {"var_spatial_presence": ("DataFrame",)}


class Experiment(Collection):
    kind = "Experiment"
    slots = {"obs": ("DataFrame",), "ms": ("Collection",), "spatial": ("Collection",), "obs_spatial_presence": ("DataFrame",)}

    def axis_query(self, measurement_name: str, *, obs_query: object = None, var_query: object = None, index_factory: object = None):
        """A query of both axes; index_factory makes of sorted ids what finds their places (`IntIndexer` by default)."""
        from matrella.api.query import AxisQuery, ExperimentAxisQuery, IntIndexer

        return ExperimentAxisQuery(self, measurement_name, obs_query or AxisQuery(), var_query or AxisQuery(), index_factory or IntIndexer)

    def _delete_axis(self, frame: DataFrame, coords: object, value_filter: str | None, targets: Sequence[tuple[StoredObject, Sequence[str]]]) -> None:
        self.need("d")
        for obj, dims in targets:
            if isinstance(obj, DenseNDArray):
                raise NotImplementedError(f"{obj.uri} is dense: its cells can't be deleted")
            if obj.kind == "GeometryDataFrame":
                raise NotImplementedError(f"rows of {obj.uri} can't be deleted")
        doomed = DataFrame.open(frame.uri, "r", spark=self.spark, timestamp=self.timestamp).read(coords, ["soma_joinid"], value_filter=value_filter).df.select("soma_joinid")
        if value_filter is None and all(c is None for c in coords):
            raise ValueError("a delete needs coordinates or a value filter")
        ids = f"{self.uri}/_doomed/{self.stamp()}_{id(doomed):x}"
        doomed.distinct().write.parquet(ids)
        stored = self.spark.read.parquet(ids)
        if not stored.isEmpty():
            for obj, dims in [*targets, (frame, ["soma_joinid"])]:
                have = obj.schema.names
                if all(d in have for d in dims):
                    obj._delete_ids(stored, dims)
        frame.log.files.delete(ids)  # every object has its own copy by now

    def _arrays(self, owner: Collection, slot: str) -> list[StoredArray]:
        return [m for _, m in owner[slot].items() if isinstance(m, StoredArray)] if slot in owner else []

    def obs_axis_delete(self, coords: object = (), *, value_filter: str | None = None) -> None:
        """Delete observations here and in every matrix, pair matrix, embedding, presence frame and scene; a pair goes with either of its ends."""
        targets = []
        if "ms" in self:
            for _, m in self["ms"].items():
                targets += [(a, ["soma_dim_0"]) for s in ("X", "obsm") for a in self._arrays(m, s)]
                targets += [(a, ["soma_dim_0", "soma_dim_1"]) for a in self._arrays(m, "obsp")]
        if "obs_spatial_presence" in self:
            targets.append((self["obs_spatial_presence"], ["soma_joinid"]))
        if "spatial" in self:
            targets += [(a, ["soma_joinid"]) for _, scene in self["spatial"].items() for a in self._arrays(scene, "obsl")]
        self._delete_axis(self["obs"], coords, value_filter, targets)

    def var_axis_delete(self, measurement_name: str, coords: object = (), *, value_filter: str | None = None) -> None:
        """Delete variables of one measurement likewise."""
        m = self["ms"][measurement_name]
        targets = [(a, ["soma_dim_1"]) for a in self._arrays(m, "X")] + [(a, ["soma_dim_0"]) for a in self._arrays(m, "varm")]
        targets += [(a, ["soma_dim_0", "soma_dim_1"]) for a in self._arrays(m, "varp")]
        if "var_spatial_presence" in m:
            targets.append((m["var_spatial_presence"], ["soma_joinid"]))
        self._delete_axis(m["var"], coords, value_filter, targets)


class EphemeralMeasurement(EphemeralCollection):
    kind, slots = Measurement.kind, Measurement.slots


class EphemeralExperiment(EphemeralCollection):
    kind, slots = Experiment.kind, Experiment.slots


def kinds() -> dict[str, type]:
    from matrella.api.spatial import GeometryDataFrame, MultiscaleImage, PointCloudDataFrame, Scene

    return {c.kind.lower(): c for c in (DataFrame, SparseNDArray, DenseNDArray, Collection, Measurement, Experiment, Scene, PointCloudDataFrame, GeometryDataFrame, MultiscaleImage)}


def open_object(uri: str, mode: str = "r", *, soma_type: type | str | None = None, spark: SparkSession | None = None, timestamp: int | None = None) -> StoredObject:
    """Open whatever is stored at a place; soma_type, a class or a name in any case, is checked."""
    kind = Log(session(spark), uri).state(timestamp or None).kind
    if soma_type is not None:
        wanted = soma_type if isinstance(soma_type, str) else soma_type.kind
        if wanted.lower() != kind.lower():
            raise TypeError(f"{uri} is a {kind}, not a {wanted}")
    return kinds()[kind.lower()].open(uri, mode, spark=spark, timestamp=timestamp)


def exists(uri: str, *, spark: SparkSession | None = None) -> bool:
    return StoredObject.exists(uri, spark=spark)
