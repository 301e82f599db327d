"""Two-axis queries: matrix slices chosen through filtered annotation frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame as Frame

from matrella.api.objects import DenseNDArray, SparseNDArray, TableRead, in_row_parts
from matrella.functions.filter_lang import Compare, Logic
from matrella.operators import core
from matrella.operators.assemble import Compressed, IntIndexer, Labelled, compress, dense_rows


MAX_WIDTH = 1 << 20


@dataclass(frozen=True)
class AxisQuery:
    """What is wanted of one axis: coordinates and a value filter."""

    value_filter: str | None = None
    coords: tuple = ()

    def __post_init__(self) -> None:
        if self.value_filter is not None and not isinstance(self.value_filter, str | Compare | Logic):
            raise TypeError("a value filter is a string or a tree")
        if isinstance(self.coords, str | bytes) or not isinstance(self.coords, Sequence):
            raise TypeError("coords are a sequence")
        object.__setattr__(self, "coords", tuple(self.coords))


@dataclass
class Bundle:
    """A query's results in memory: annotation frames, compressed matrices and dense embeddings."""

    obs: pd.DataFrame
    var: pd.DataFrame
    X: Compressed | None = None
    layers: dict[str, Compressed] = field(default_factory=dict)
    obsm: dict[str, np.ndarray] = field(default_factory=dict)
    varm: dict[str, np.ndarray] = field(default_factory=dict)
    obsp: dict[str, Compressed] = field(default_factory=dict)
    varp: dict[str, Compressed] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)


class Indexer:
    """Places of ids in the query's axes, -1 where they are not in it."""

    def __init__(self, query: ExperimentAxisQuery, factory: Callable = IntIndexer):
        self.query, self.factory = query, factory
        self._made: dict[str, object] = {}

    def _by(self, axis: str, ids: object) -> np.ndarray:
        if axis not in self._made:
            self._made[axis] = self.factory(np.sort(self.query._ids(axis).toArrow()["soma_joinid"].to_numpy()))
        return self._made[axis].get_indexer(ids)

    def by_obs(self, ids: object) -> np.ndarray:
        return self._by("obs", ids)

    def by_var(self, ids: object) -> np.ndarray:
        return self._by("var", ids)


class ExperimentAxisQuery:
    """All accessors are lazy; ids of an axis are kept (cached by the engine) once they are used."""

    def __init__(self, experiment, measurement_name: str, obs_query: AxisQuery, var_query: AxisQuery, index_factory: Callable = IntIndexer):
        if measurement_name not in experiment["ms"]:
            raise ValueError(f"no measurement {measurement_name!r}")
        self.experiment, self.ms = experiment, experiment["ms"][measurement_name]
        self._axis = {"obs": (experiment["obs"], obs_query), "var": (self.ms["var"], var_query)}
        self._kept: dict[str, Frame] = {}
        self.index_factory = index_factory  # sorted ids -> an object with get_indexer(ids)
        self.indexer = Indexer(self, index_factory)

    def __enter__(self) -> ExperimentAxisQuery:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for f in self._kept.values():
            f.unpersist()
        self._kept = {}

    def _frame(self, axis: str, column_names: Sequence[str] | None = None, result_order: str = "auto") -> TableRead:
        frame, q = self._axis[axis]
        return frame.read(q.coords, column_names, value_filter=q.value_filter, result_order=result_order)

    def obs(self, column_names: Sequence[str] | None = None, *, result_order: str = "auto") -> TableRead:
        return self._frame("obs", column_names, result_order)

    def var(self, column_names: Sequence[str] | None = None, *, result_order: str = "auto") -> TableRead:
        return self._frame("var", column_names, result_order)

    def _ids(self, axis: str) -> Frame:
        if axis not in self._kept:
            self._kept[axis] = self._frame(axis, ["soma_joinid"]).df.select("soma_joinid").persist()
        return self._kept[axis]

    def obs_joinids(self) -> pa.ChunkedArray:
        return self._ids("obs").toArrow()["soma_joinid"]

    def var_joinids(self) -> pa.ChunkedArray:
        return self._ids("var").toArrow()["soma_joinid"]

    @property
    def n_obs(self) -> int:
        return self._ids("obs").count()

    @property
    def n_vars(self) -> int:
        return self._ids("var").count()

    def _layer(self, slot: str, name: str) -> SparseNDArray:
        if slot not in self.ms:
            raise ValueError(f"the measurement has no {slot}")
        if name not in self.ms[slot]:
            raise KeyError(f"no layer {name!r} in {slot}")
        got = self.ms[slot][name]
        if not isinstance(got, SparseNDArray):
            raise TypeError(f"{slot} layer {name!r} is not sparse")
        return got

    def _slice(self, slot: str, name: str, axes: Sequence[str], result_order: str = "auto") -> TableRead:
        # ids are keys: cells outside them are gone before versions are resolved
        df = self._layer(slot, name).snapshot([self._ids(axis) for axis in axes])
        return TableRead(core.in_order(df, ["soma_dim_0", "soma_dim_1"], result_order))

    def X(self, layer_name: str, *, result_order: str = "auto") -> TableRead:
        return self._slice("X", layer_name, ("obs", "var"), result_order)

    def X_parts(self, layer_name: str) -> Frame:
        """X by ranges of rows of about equal work, each with complete rows in order; how many depends on the layer's density."""
        return in_row_parts(self._layer("X", layer_name), self.X(layer_name).df)

    def read(self, X_layers: Sequence[str] = (), obs_column_names: Sequence[str] | None = None, var_column_names: Sequence[str] | None = None) -> dict[str, Frame | dict[str, Frame]]:
        """Everything asked for as lazy frames: obs, var and X by layer."""
        return {"obs": self.obs(obs_column_names).df, "var": self.var(var_column_names).df, "X": {n: self.X(n).df for n in X_layers}}

    def _labels(self, axis: str, column: str | None, ids: np.ndarray) -> list:
        if column is None:
            return ids.tolist()
        t = self._frame(axis, ["soma_joinid", column]).concat()
        by = dict(zip(t["soma_joinid"].to_pylist(), t[column].to_pylist()))
        labels = [by[k] for k in ids.tolist()]
        if len(set(labels)) < len(labels) or None in labels:
            raise ValueError(f"values of {column!r} are not unique labels")
        return labels

    def to_labelled_matrix(self, collection: str, layer_name: str, obs_index: str | None = None, var_index: str | None = None) -> Labelled:
        """A layer of X, obsm, varm, obsp or varp in memory, with its labels: values of the index columns, joinids where none are named, column numbers of embeddings."""
        axes = {"X": ("obs", "var"), "obsm": ("obs", None), "varm": ("var", None), "obsp": ("obs", "obs"), "varp": ("var", "var")}
        if collection not in axes:
            raise ValueError(f"unknown collection {collection!r}")
        a, b = axes[collection]
        layer = self.ms[collection].get(layer_name) if collection in self.ms else None
        if layer is None:
            raise KeyError(f"no layer {layer_name!r} in {collection}")
        ids = {x: np.sort((self.obs_joinids() if x == "obs" else self.var_joinids()).to_numpy()) for x in {a, b} - {None}}
        if isinstance(layer, DenseNDArray):
            # a dense layer has every cell; it is read as cells of the ids asked for
            df = core.axis_matrix(layer.snapshot(), self._ids(a), None if b is None else self._ids(b))
            t = df.where("soma_data <> 0").toArrow()
        else:
            t = self._slice(collection, layer_name, (a,) if b is None else (a, b)).concat()
        at = {x: self.index_factory(v) for x, v in ids.items()}
        columns = t["soma_dim_1"].to_numpy() if b is None else at[b].get_indexer(t["soma_dim_1"])
        shape = (len(ids[a]), layer.shape[1] if b is None else len(ids[b]))
        matrix = Compressed.from_ijd(at[a].get_indexer(t["soma_dim_0"]), columns, t["soma_data"].to_numpy(), shape)
        name = {"obs": obs_index, "var": var_index}
        return Labelled(matrix, self._labels(a, name[a], ids[a]), list(range(shape[1])) if b is None else self._labels(b, name[b], ids[b]))

    def obsp(self, layer: str) -> TableRead:
        return self._slice("obsp", layer, ("obs", "obs"))

    def varp(self, layer: str) -> TableRead:
        return self._slice("varp", layer, ("var", "var"))

    def obsm(self, layer: str) -> TableRead:
        return self._slice("obsm", layer, ("obs",))

    def varm(self, layer: str) -> TableRead:
        return self._slice("varm", layer, ("var",))

    def X_reindexed(self, layer_name: str) -> Frame:
        """(i, j, soma_data) with places in the query's axes, as a lazy frame."""
        return core.reindexed(self.X(layer_name).df, self._ids("obs"), self._ids("var")).select("i", "j", "soma_data")

    def _scenes(self, presence, axis: str) -> list[str]:
        df = core.semi(presence.snapshot(), "soma_joinid", self._ids(axis))
        flag = "data" if "data" in df.columns else "soma_data"
        return sorted(r[0] for r in df.where(f"`{flag}`").select("scene_id").distinct().collect())

    def spatial(self, *, radius: float | None = None, level: int | str = 0) -> dict[str, dict[str, object]]:
        """What the scenes of the query's observations hold, in each scene's coordinates: {scene: {"points" | "shapes" | "images": {name: ...}}}.

        Points and shapes are lazy frames of the query's observations (shapes are points with a radius and geometries), images are pixels with their transform.
        """
        from matrella.api.spatial import scene_export

        return {s: scene_export(self.experiment["spatial"][s], self._ids("obs"), radius, level) for s in self.obs_scene_ids()}

    def obs_scene_ids(self) -> list[str]:
        return self._scenes(self.experiment["obs_spatial_presence"], "obs")

    def var_scene_ids(self) -> list[str]:
        return self._scenes(self.ms["var_spatial_presence"], "var")

    def _annotations(self, axis: str, names: Sequence[str] | None, drop_levels: bool, id_name: str | None) -> pd.DataFrame:
        frame = self._axis[axis][0]
        asked = None if names is None else list(dict.fromkeys(["soma_joinid", *names]))
        pdf = self._frame(axis, asked).concat().to_pandas().sort_values("soma_joinid", kind="stable").reset_index(drop=True)
        for c in frame.state.schema:
            if "levels" in c and c["name"] in pdf:
                used = set(pdf[c["name"]].dropna())
                levels = [v for v in c["levels"] if v in used] if drop_levels else c["levels"]
                pdf[c["name"]] = pd.Categorical(pdf[c["name"]], levels, ordered=c["ordered"])
        back = id_name or frame.metadata.get("dataframe_index_name")
        return pdf.set_index(back) if back in pdf.columns else pdf

    def to_bundle(self, X_name: str | None = "", *, column_names: dict[str, Sequence[str]] | None = None, X_layers: Sequence[str] = (), obsm_layers: Sequence[str] = (), obsp_layers: Sequence[str] = (), varm_layers: Sequence[str] = (), varp_layers: Sequence[str] = (), drop_levels: bool = False, obs_id_name: str | None = None, var_id_name: str | None = None, width_hints: dict[str, int] | None = None) -> Bundle:
        """Everything the query selects, in memory.  X_name: unset takes `data` if there is such a layer, None takes none.

        An embedding is as wide as its hint says, else as its shape, or, where that is wider than MAX_WIDTH, as the columns written.
        """
        if X_name == "":
            X_name = "data" if "X" in self.ms and "data" in self.ms["X"] else None
        if X_name is None and X_layers:
            raise ValueError("layers need an X")
        names = column_names or {}
        for n in [x for x in (X_name, *X_layers) if x is not None]:
            if isinstance(self.ms["X"].get(n), DenseNDArray):
                raise NotImplementedError("dense layers are not supported here")
        with ThreadPoolExecutor(4) as pool:
            obs = pool.submit(self._annotations, "obs", names.get("obs"), drop_levels, obs_id_name)
            var = pool.submit(self._annotations, "var", names.get("var"), drop_levels, var_id_name)
            ids = {"obs": np.sort(self.obs_joinids().to_numpy()), "var": np.sort(self.var_joinids().to_numpy())}
            index = {a: self.index_factory(x) for a, x in ids.items()}

            def matrix(slot: str, name: str, axes: tuple[str, str]) -> Compressed:
                t = self._slice(slot, name, axes).concat()
                t = pa.table({"soma_dim_0": index[axes[0]].get_indexer(t["soma_dim_0"]), "soma_dim_1": index[axes[1]].get_indexer(t["soma_dim_1"]), "soma_data": t["soma_data"]})
                return compress(t, (len(ids[axes[0]]), len(ids[axes[1]])))

            def embedding(slot: str, name: str, axis: str) -> np.ndarray:
                layer = self._layer(slot, name)
                width = (width_hints or {}).get(name) or layer.shape[1]
                if width > MAX_WIDTH:
                    width = 0 if (domain := layer.non_empty_domain()) is None else domain[1][1] + 1
                return dense_rows(self._slice(slot, name, (axis,)).concat(), ids[axis], width, layer.type.to_pandas_dtype())

            x = pool.submit(matrix, "X", X_name, ("obs", "var")) if X_name is not None else None
            many = {
                "layers": {n: pool.submit(matrix, "X", n, ("obs", "var")) for n in X_layers},
                "obsm": {n: pool.submit(embedding, "obsm", n, "obs") for n in obsm_layers},
                "varm": {n: pool.submit(embedding, "varm", n, "var") for n in varm_layers},
                "obsp": {n: pool.submit(matrix, "obsp", n, ("obs", "obs")) for n in obsp_layers},
                "varp": {n: pool.submit(matrix, "varp", n, ("var", "var")) for n in varp_layers},
            }
            return Bundle(obs.result(), var.result(), x.result() if x else None, **{k: {n: f.result() for n, f in v.items()} for k, v in many.items()})


def X_as_series(table: pa.Table) -> pd.Series:
    """A COO table as a series by (soma_dim_0, soma_dim_1)."""
    return pd.Series(table["soma_data"].to_numpy(), pd.MultiIndex.from_arrays([table["soma_dim_0"].to_numpy(), table["soma_dim_1"].to_numpy()], names=["soma_dim_0", "soma_dim_1"]), name="soma_data")
