"""In and out of experiments: bundles of frames and matrices, registration of several inputs, appending, updating, resizing.

An input is a `Source`: annotation frames with an id column each, matrices as COO by place (row of obs, row of var) or as compressed blocks or frames.  No
single-cell file library is needed; whoever has one hands over its tables.  Annotations and matrices may be Spark frames of any size: annotations then have
a column `place` (0, 1, ...), and neither labels nor ids nor cells come to the driver, only counts, levels of categoricals and a few labels for messages.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame as Frame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from matrella.api.collections import Collection, Experiment, Measurement
from matrella.api.objects import MAX_LEVELS, DataFrame, DenseNDArray, SparseNDArray, StoredArray, session
from matrella.api.query import AxisQuery, Bundle
from matrella.errors import MatrellaError
from matrella.operators import core
from matrella.operators.assemble import Compressed

Matrix = object  # Compressed, two-dimensional array, or a Spark frame (i, j, value)


@dataclass
class Source:
    """One input: obs and var with the columns that hold their ids, and matrices by place; obs and var may be Spark frames with a column `place`."""

    obs: pd.DataFrame | Frame
    var: pd.DataFrame | Frame
    X: Matrix | None = None
    layers: Mapping[str, Matrix] = field(default_factory=dict)
    obsm: Mapping[str, np.ndarray] = field(default_factory=dict)
    varm: Mapping[str, np.ndarray] = field(default_factory=dict)
    obsp: Mapping[str, Matrix] = field(default_factory=dict)
    varp: Mapping[str, Matrix] = field(default_factory=dict)
    uns: Mapping[str, object] = field(default_factory=dict)
    obs_id: str = "obs_id"
    var_id: str = "var_id"


# --- annotation frames -------------------------------------------------------------------------------------------------------------------


def coerce(pdf: pd.DataFrame) -> pa.Table:
    """A frame as Arrow with supported types only: half floats widened, categories of more than MAX_LEVELS levels as plain values."""
    pdf = pdf.copy(deep=False)
    for name in pdf.columns:
        col = pdf[name]
        if isinstance(col.dtype, pd.CategoricalDtype) and len(col.cat.categories) > MAX_LEVELS:
            pdf[name] = col.astype(col.cat.categories.dtype)
        elif col.dtype == np.float16:
            pdf[name] = col.astype(np.float32)
    t = pa.Table.from_pandas(pdf, preserve_index=False).replace_schema_metadata(None)
    return t.cast(pa.schema([f.with_nullable(f.name != "soma_joinid") for f in t.schema]))


@dataclass
class _Annotation:
    """An annotation frame as a lazy frame with `place`, its Arrow schema, and the levels of its categoricals."""

    frame: Frame
    schema: pa.Schema
    levels: dict[str, list]

    def labels(self, column: str) -> Frame:
        return self.frame.select(F.col(f"`{column}`").cast("string").alias("label"), "place")


def _plain(t: pa.Table) -> pa.Table:
    """Categoricals as their values, unsigned integers widened, times in microseconds: what a Spark frame takes."""
    cols = []
    for c in t.columns:
        k = c.type.value_type if pa.types.is_dictionary(c.type) else c.type
        k = pa.decimal128(20, 0) if pa.types.is_uint64(k) else pa.int64() if pa.types.is_unsigned_integer(k) else pa.timestamp("us") if pa.types.is_timestamp(k) and k.unit != "us" else k
        cols.append(c.cast(k))
    return pa.table(cols, names=t.column_names)


def _annotation(spark: SparkSession, a: pd.DataFrame | Frame) -> _Annotation:
    if isinstance(a, Frame):
        if "place" not in a.columns:
            raise ValueError("a Spark frame of annotations needs a column `place`")
        fields = [f.with_nullable(f.name != "soma_joinid") for f in to_arrow_schema(a.drop("place").schema)]
        return _Annotation(a, pa.schema(fields), {})
    t = coerce(a)
    levels = {n: list(a[n].cat.categories) for n in a.columns if isinstance(a[n].dtype, pd.CategoricalDtype)}
    df = spark.createDataFrame(_plain(t).append_column("place", pa.array(np.arange(t.num_rows))))
    return _Annotation(df, t.schema, levels)


def _numbered(pdf: pd.DataFrame, ids: Sequence[int]) -> pd.DataFrame:
    out = pdf.reset_index(drop=True)
    out.insert(0, "soma_joinid", np.asarray(ids, np.int64))
    return out


def _declare_levels(frame: DataFrame, t: pa.Table) -> None:
    for f, c in zip(t.schema, t.columns):
        if pa.types.is_dictionary(f.type):
            frame.extend_enumeration_values({f.name: c.combine_chunks().dictionary if c.num_chunks == 1 else c.unify_dictionaries().chunk(0).dictionary}, deduplicate=True)


def write_frame(parent: Collection, key: str, pdf: pd.DataFrame, index_name: str | None = None, rows: int | None = None, schema_only: bool = False) -> DataFrame:
    """A new annotation frame, or rows appended to the one that is there; columns unknown to it are an error."""
    t = coerce(pdf)
    if schema_only:
        t = t.slice(0, 0)
    if key in parent:
        frame = DataFrame.open(parent[key].uri, "w", spark=parent.spark, timestamp=parent.timestamp)
        if extra := [n for n in t.column_names if n not in frame.schema.names]:
            raise MatrellaError(f"{key} has no columns {', '.join(extra)}")
    else:
        frame = parent.add_new_dataframe(key, schema=t.schema, domain=[(0, max(0, (rows or t.num_rows) - 1))])
        if index_name:
            frame.metadata["dataframe_index_name"] = index_name
    _declare_levels(frame, t)
    if t.num_rows:
        frame.write(t)
    return frame


def _write_annotation(parent: Collection, key: str, a: _Annotation, ids: Frame | None, fresh: Frame | None, index: str, rows: int, schema_only: bool) -> DataFrame:
    """Annotations by joinid: ids is a map (place, soma_joinid), places are joinids where it is absent; only joinids in `fresh` are written if that is given."""
    df = a.frame
    if "soma_joinid" in df.columns:
        df = df.drop("soma_joinid")
    df = df.withColumn("soma_joinid", F.col("place")) if ids is None else df.join(ids, "place")
    if fresh is not None:
        df = df.join(fresh.where("is_new").select("soma_joinid"), "soma_joinid", "left_semi")
    # of rows that share a joinid the first counts
    df = core.latest(df, ["soma_joinid"], [F.asc("place")]).drop("place")
    kept = [f for f in a.schema if f.name != "soma_joinid"]
    if key in parent:
        frame = DataFrame.open(parent[key].uri, "w", spark=parent.spark, timestamp=parent.timestamp)
        if extra := [f.name for f in kept if f.name not in frame.schema.names]:
            raise MatrellaError(f"{key} has no columns {', '.join(extra)}")
    else:
        frame = parent.add_new_dataframe(key, schema=pa.schema([pa.field("soma_joinid", pa.int64(), False), *kept]), domain=[(0, max(0, rows - 1))])
        frame.metadata["dataframe_index_name"] = index
    have = {c["name"] for c in frame.state.schema if "levels" in c}
    if add := {n: v for n, v in a.levels.items() if n in have and v}:
        frame.extend_enumeration_values(add, deduplicate=True)
    if not schema_only:
        frame.write(df)
    return frame


# --- matrices --------------------------------------------------------------------------------------------------------------------------


def coo_frame(spark: SparkSession, m: Matrix) -> Frame:
    """A matrix as a lazy frame (i, j, value); zeros of dense input are left out."""
    if isinstance(m, Frame):
        return m.toDF("i", "j", "value")
    if isinstance(m, np.ndarray):
        i, j = np.nonzero(m)
        d = m[i, j]
    elif isinstance(m, Compressed):
        i, j, d = m.to_coo()
    else:
        raise TypeError(f"can't read a matrix from a {type(m).__name__}")
    if d.dtype == np.float16:
        d = d.astype(np.float32)
    t = pa.table({"i": np.asarray(i, np.int64), "j": np.asarray(j, np.int64), "value": d})
    return spark.createDataFrame(t) if t.num_rows else spark.createDataFrame([], f"i bigint, j bigint, value {'float' if d.dtype == np.float32 else 'double'}")


def _arrow_kind(m: Matrix) -> pa.DataType:
    if isinstance(m, Frame):
        return {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}[m.schema[2].dataType.simpleString()]
    data = m.data if isinstance(m, Compressed) else m
    return pa.float32() if data.dtype == np.float16 else pa.from_numpy_dtype(data.dtype)


def write_matrix(parent: Collection, key: str, m: Matrix, shape: tuple[int, int], rows: Frame | None = None, cols: Frame | None = None, dense: bool = False) -> StoredArray:
    """Write a matrix by place into an array by joinid; rows and cols are (place, soma_joinid) maps, absent where places are joinids."""
    if dense:
        array = parent.add_new_dense_ndarray(key, type=_arrow_kind(m), shape=shape)
        array.write((), m if isinstance(m, np.ndarray) else m.to_numpy())
        return array
    df = coo_frame(parent.spark, m)
    for name, dim, ids in (("i", "soma_dim_0", rows), ("j", "soma_dim_1", cols)):
        if ids is None:
            df = df.withColumnRenamed(name, dim)
        else:
            df = df.join(ids.select(F.col("place").alias(name), F.col("soma_joinid").alias(dim)), name).drop(name)
    df = df.select("soma_dim_0", "soma_dim_1", F.col("value").alias("soma_data"))
    array = SparseNDArray.open(parent[key].uri, "w", spark=parent.spark, timestamp=parent.timestamp) if key in parent else parent.add_new_sparse_ndarray(key, type=_arrow_kind(m), shape=shape)
    return array.write(df)


# --- registration ------------------------------------------------------------------------------------------------------------------------


@dataclass
class Registration:
    """Ids of all inputs with their joinids (lazy frames label, soma_joinid, is_new), the sizes after appending, and new levels."""

    obs: Frame
    var: Frame
    obs_size: int
    var_size: int
    levels: dict[str, dict[str, list]]
    prepared: bool = False

    def of(self, axis: str, labels: Sequence[str] | Frame, spark: SparkSession) -> Frame:
        """(place, soma_joinid) of an input's labels, a list or a frame (label, place); one that isn't registered is an error."""
        if isinstance(labels, Frame):
            df = labels
        else:
            t = pa.table({"label": pa.array(list(labels), pa.string()), "place": np.arange(len(labels))})
            df = spark.createDataFrame(t) if len(labels) else spark.createDataFrame([], "label string, place bigint")
        known = (self.obs if axis == "obs" else self.var).select("label", "soma_joinid")
        out = df.join(known, "label", "left")
        missing = [r.label for r in out.where("soma_joinid is null").select("label").limit(5).collect()]
        if missing:
            raise ValueError(f"{axis} labels aren't registered: {', '.join(map(str, missing))}")
        return out.select("place", "soma_joinid")

    def subset(self, source: Source, spark: SparkSession | None = None) -> Registration:
        """What one input needs of a registration of many: its own labels, all levels, the sizes as they are."""
        spark = session(spark)
        own = {}
        for axis, a, col in (("obs", source.obs, source.obs_id), ("var", source.var, source.var_id)):
            labels = _annotation(spark, a).labels(col).select("label").distinct()
            own[axis] = (self.obs if axis == "obs" else self.var).join(labels, "label", "left_semi")
        return Registration(own["obs"], own["var"], self.obs_size, self.var_size, self.levels, self.prepared)

    def prepare(self, experiment_uri: str, measurement_name: str, spark: SparkSession | None = None) -> None:
        """Grow the experiment to the registered sizes and extend its levels, before any input is written."""
        exp = Experiment.open(experiment_uri, "w", spark=spark)
        resize_experiment(experiment_uri, nobs=self.obs_size, nvars={measurement_name: self.var_size}, spark=spark)
        for axis, frame in (("obs", exp["obs"]), ("var", exp["ms"][measurement_name]["var"])):
            have = [c["name"] for c in frame.state.schema if "levels" in c]
            if add := {c: v for c, v in self.levels[axis].items() if c in have and v}:
                frame.extend_enumeration_values(add, deduplicate=True)
        self.prepared = True


def register(sources: Sequence[Source], experiment_uri: str | None = None, measurement_name: str = "RNA", *, allow_duplicate_obs_ids: bool = False, spark: SparkSession | None = None) -> Registration:
    """Joinids for the ids of all inputs: known ones keep theirs, new ones follow the largest, by the first place of each, inputs one after the other.

    An obs id that occurs in two inputs, or is stored already, is an error unless duplicates are allowed.
    """
    spark = session(spark)
    levels: dict[str, dict[str, list]] = {"obs": {}, "var": {}}

    def axis(name: str, known: Frame | None) -> tuple[Frame, int]:
        labels = spark.createDataFrame([], "label string, input int, pos bigint")
        for k, s in enumerate(sources):
            a, col = (s.obs, s.obs_id) if name == "obs" else (s.var, s.var_id)
            a = _annotation(spark, a)
            labels = labels.unionAll(a.labels(col).select("label", F.lit(k), F.col("place")))
            for c, values in a.levels.items():
                have = levels[name].setdefault(c, [])
                have += [v for v in values if v not in have]
        first = labels.where("label is not null").groupBy("label").agg(F.min(F.struct("input", "pos")).alias("seen"), F.count(F.lit(1)).alias("n"))
        if known is None:
            known = spark.createDataFrame([], "label string, soma_joinid bigint")
        if name == "obs" and not allow_duplicate_obs_ids:
            again = first.where("n > 1").select("label").unionAll(first.join(known, "label", "left_semi").select("label"))
            if twice := again.limit(5).collect():
                raise MatrellaError(f"obs ids occur more than once: {', '.join(r.label for r in twice)}")
        start = known.agg(F.max("soma_joinid")).first()[0]
        new = first.join(known.select("label"), "label", "left_anti").select("label", "seen.input", "seen.pos")
        got = core.numbered(new, ["input", "pos"], "soma_joinid", 0 if start is None else start + 1).select("label", "soma_joinid")
        out = known.withColumn("is_new", F.lit(False)).unionByName(got.withColumn("is_new", F.lit(True))).persist()
        size = out.agg(F.max("soma_joinid")).first()[0]
        return out, 0 if size is None else size + 1

    known_obs = known_var = None
    if experiment_uri is not None and Experiment.exists(experiment_uri, spark=spark):
        exp = Experiment.open(experiment_uri, spark=spark)
        obs_id, var_id = sources[0].obs_id if sources else "obs_id", sources[0].var_id if sources else "var_id"
        known_obs = exp["obs"].snapshot().select(F.col(f"`{obs_id}`").cast("string").alias("label"), "soma_joinid")
        known_var = exp["ms"][measurement_name]["var"].snapshot().select(F.col(f"`{var_id}`").cast("string").alias("label"), "soma_joinid")
    obs, n_obs = axis("obs", known_obs)
    var, n_var = axis("var", known_var)
    return Registration(obs, var, n_obs, n_var, levels, prepared=known_obs is None)


# --- whole experiments -----------------------------------------------------------------------------------------------------------------


def _slot(parent: Collection, key: str, kind: type = Collection) -> Collection:
    if key in parent:
        return kind.open(parent[key].uri, "w", spark=parent.spark, timestamp=parent.timestamp)
    return parent.add_new_collection(key, kind)


def write_experiment(uri: str, source: Source, measurement_name: str = "RNA", *, registration: Registration | None = None, X_layer_name: str = "data", schema_only: bool = False, dense_X: bool = False, timestamp: int | None = None, spark: SparkSession | None = None) -> str:
    """Write or append an input as an experiment; with a registration rows and columns go to their joinids, without one to their places.

    Appending to an experiment needs a registration that it was prepared for.
    """
    spark = session(spark)
    there = Experiment.exists(uri, spark=spark)
    if there and (registration is None or not registration.prepared):
        raise MatrellaError("appending needs a registration that the experiment was prepared for")
    exp = Experiment.open(uri, "w", spark=spark, timestamp=timestamp) if there else Experiment.create(uri, spark=spark, timestamp=timestamp)
    rows = cols = None
    obs, var = _annotation(spark, source.obs), _annotation(spark, source.var)
    if registration is not None:
        rows = registration.of("obs", obs.labels(source.obs_id), spark).persist()
        cols = registration.of("var", var.labels(source.var_id), spark).persist()
        n_obs, n_var = registration.obs_size, registration.var_size
    else:
        n_obs, n_var = obs.frame.count(), var.frame.count()

    def annotate(parent: Collection, key: str, a: _Annotation, ids: Frame | None, size: int, index: str) -> None:
        known = None if registration is None or key not in parent else registration.obs if key == "obs" else registration.var
        _write_annotation(parent, key, a, ids, known, index, size, schema_only)

    annotate(exp, "obs", obs, rows, n_obs, source.obs_id)
    m = _slot(_slot(exp, "ms"), measurement_name, Measurement)
    annotate(m, "var", var, cols, n_var, source.var_id)
    for slot, many, shape, a, b in (
        ("X", ({X_layer_name: source.X} if source.X is not None else {}) | dict(source.layers), (n_obs, n_var), rows, cols),
        ("obsm", source.obsm, (n_obs, None), rows, None),
        ("varm", source.varm, (n_var, None), cols, None),
        ("obsp", source.obsp, (n_obs, n_obs), rows, rows),
        ("varp", source.varp, (n_var, n_var), cols, cols),
    ):
        if not many:
            continue
        parent = _slot(m, slot)
        for name, x in many.items():
            size = (shape[0], shape[1] or (x.agg(F.max(x.columns[1])).first()[0] + 1 if isinstance(x, Frame) else x.shape[1]))
            if schema_only:
                if name not in parent:
                    parent.add_new_sparse_ndarray(name, type=_arrow_kind(x), shape=size)
            else:
                write_matrix(parent, name, x, size, a, b, dense=dense_X and slot == "X")
    if source.uns:
        update_uns(_slot(m, "uns"), source.uns, "ignore")
    return uri


def append(uri: str, source: Source, registration: Registration, measurement_name: str = "RNA", **args: object) -> str:
    return write_experiment(uri, source, measurement_name, registration=registration, **args)


def to_bundle(uri_or_experiment: str | Experiment, measurement_name: str = "RNA", X_layer_name: str | None = "data", spark: SparkSession | None = None, **args: object) -> Bundle:
    """A whole experiment in memory."""
    exp = uri_or_experiment if isinstance(uri_or_experiment, Experiment) else Experiment.open(uri_or_experiment, spark=spark)
    m = exp["ms"][measurement_name]
    every = {f"{s}_layers": m[s].keys() for s in ("obsm", "varm", "obsp", "varp") if s in m}
    if "X" in m:
        every["X_layers"] = [k for k in m["X"].keys() if k != X_layer_name and isinstance(m["X"][k], SparseNDArray)]
    with exp.axis_query(measurement_name, obs_query=AxisQuery(), var_query=AxisQuery()) as q:
        out = q.to_bundle(X_layer_name if "X" in m and X_layer_name in m["X"] else None, **(every | args))
    if "uns" in m:
        out.uns = read_uns(m["uns"])
    return out


# --- free-form entries -------------------------------------------------------------------------------------------------------------------


def write_uns(parent: Collection, entries: Mapping[str, object], strict: bool = True) -> None:
    """Scalars as metadata, maps as collections, frames as frames, number arrays as dense arrays, string arrays as frames with a hint."""
    for key, v in entries.items():
        if isinstance(v, Mapping):
            write_uns(_slot(parent, key), v, strict)
        elif isinstance(v, str | int | float | bytes | bool | np.generic):
            parent.metadata[key] = int(v) if isinstance(v, bool | np.bool_) else v
        elif isinstance(v, pd.DataFrame):
            write_frame(parent, key, _numbered(v, np.arange(len(v))))
        elif isinstance(v, list | tuple | np.ndarray):
            a = np.asarray(v)
            if a.dtype.kind in "biuf" and a.size:
                arr = parent.add_new_dense_ndarray(key, type=pa.from_numpy_dtype(a.dtype if a.dtype != np.float16 else np.float32), shape=a.shape or (1,))
                arr.write((), a.reshape(a.shape or (1,)).astype(np.float32) if a.dtype == np.float16 else a.reshape(a.shape or (1,)))
            elif a.dtype.kind in "UO" and a.ndim in (1, 2):
                flat = pd.DataFrame(a.astype(str).reshape(len(a), -1), columns=[f"values_{k}" for k in range(a.reshape(len(a), -1).shape[1])])
                frame = write_frame(parent, key, _numbered(flat, np.arange(len(flat))))
                frame.metadata["uns_hint"] = json.dumps({"strings": a.ndim})
            elif strict:
                raise TypeError(f"{key!r}: arrays of {a.dtype} can't be stored")
        elif v is not None and strict:
            raise TypeError(f"{key!r}: a {type(v).__name__} can't be stored")


def update_uns(parent: Collection, entries: Mapping[str, object], strict: str = "raise") -> None:
    """Set scalars anew and add what isn't there.  What is stored as an object already stays: an error under `raise`, silently under `ignore`."""
    for key, v in entries.items():
        if isinstance(v, Mapping) and (key not in parent or isinstance(parent[key], Collection)):
            update_uns(_slot(parent, key), v, strict)
        elif isinstance(v, str | int | float | bytes | np.generic) and key not in parent:
            parent.metadata[key] = v
        elif key not in parent:
            write_uns(parent, {key: v}, strict == "raise")
        elif strict == "raise":
            raise ValueError(f"{key!r} is stored already and can't be replaced")


def read_uns(parent: Collection) -> dict:
    out: dict[str, object] = {k: v for k, v in parent.metadata.items() if not k.startswith("soma_")}
    for k, m in parent.items():
        if isinstance(m, Collection):
            out[k] = read_uns(m)
        elif isinstance(m, DenseNDArray):
            out[k] = m.read().to_numpy()
        elif isinstance(m, DataFrame):
            pdf = m.read().concat().to_pandas().sort_values("soma_joinid").drop(columns="soma_joinid").reset_index(drop=True)
            hint = json.loads(m.metadata.get("uns_hint", "{}"))
            out[k] = pdf if not hint else pdf["values_0"].to_numpy() if hint["strings"] == 1 else pdf.to_numpy()
    return out


# --- updates ---------------------------------------------------------------------------------------------------------------------------


def update_axis(frame_uri: str, new: pd.DataFrame | Frame, spark: SparkSession | None = None) -> None:
    """Replace an annotation frame's contents, with columns added and dropped; as many rows as before, no type changed.  A Spark frame has a column soma_joinid or `place`."""
    frame = DataFrame.open(frame_uri, "w", spark=spark)
    spark = session(spark)
    if isinstance(new, Frame) and "place" not in new.columns:
        new = new.withColumn("place", F.col("soma_joinid"))
    a = _annotation(spark, new)
    df = a.frame.drop("place") if "soma_joinid" in a.schema.names else a.frame.withColumnRenamed("place", "soma_joinid")
    n = frame.count
    got = df.agg(F.count(F.lit(1)), F.countDistinct("soma_joinid"), F.min("soma_joinid"), F.max("soma_joinid")).first()
    if tuple(got) != ((n, n, 0, n - 1) if n else (0, 0, None, None)):
        raise ValueError(f"an update needs the {n} rows 0..{n - 1} again")
    have, want = {f.name: f for f in frame.schema}, {f.name: f for f in a.schema} | {"soma_joinid": frame.schema.field("soma_joinid")}

    def plain(k: pa.DataType) -> pa.DataType:
        k = k.value_type if pa.types.is_dictionary(k) else k
        return pa.string() if pa.types.is_large_string(k) else k

    if changed := [c for c in want if c in have and plain(have[c].type) != plain(want[c].type)]:
        raise ValueError(f"types can't change: {', '.join(changed)}")
    add, drop = [f for c, f in want.items() if c not in have], [c for c in have if c not in want]
    if add or drop:
        frame.update_schema(add, drop)
    levels = {c["name"] for c in frame.state.schema if "levels" in c}
    if more := {c: v for c, v in a.levels.items() if c in levels and v}:
        frame.extend_enumeration_values(more, deduplicate=True)
    frame.write(df)


def update_obs(experiment_uri: str, new: pd.DataFrame | Frame, spark: SparkSession | None = None) -> None:
    update_axis(Experiment.open(experiment_uri, spark=spark)["obs"].uri, new, spark)


def update_var(experiment_uri: str, new: pd.DataFrame | Frame, measurement_name: str = "RNA", spark: SparkSession | None = None) -> None:
    update_axis(Experiment.open(experiment_uri, spark=spark)["ms"][measurement_name]["var"].uri, new, spark)


def update_matrix(array: StoredArray, new: Matrix) -> None:
    """Overwrite cells of a matrix; cells that the new values lack stay."""
    if isinstance(array, DenseNDArray):
        array.write((), new if isinstance(new, np.ndarray) else new.to_numpy())
    else:
        array.write(coo_frame(array.spark, new).toDF("soma_dim_0", "soma_dim_1", "soma_data"))


def add_X_layer(experiment_uri: str, measurement_name: str, name: str, m: Matrix, spark: SparkSession | None = None) -> None:
    add_matrix_to_collection(experiment_uri, measurement_name, "X", name, m, spark)


def add_matrix_to_collection(experiment_uri: str, measurement_name: str, collection: str, name: str, m: Matrix, spark: SparkSession | None = None) -> None:
    exp = Experiment.open(experiment_uri, "w", spark=spark)
    ms = exp["ms"][measurement_name]
    n_obs, n_var = exp["obs"].domain[0][1] + 1, ms["var"].domain[0][1] + 1
    shape = {"X": (n_obs, n_var), "obsp": (n_obs, n_obs), "varp": (n_var, n_var)}.get(collection) or (n_obs if collection == "obsm" else n_var, m.shape[1])
    write_matrix(_slot(ms, collection), name, m, shape)


# --- shapes ----------------------------------------------------------------------------------------------------------------------------


def experiment_shapes(uri: str, spark: SparkSession | None = None) -> dict[str, dict]:
    """Path -> kind, shape or domain, and the largest one, of every array of an experiment."""
    out: dict[str, dict] = {}

    def walk(c: Collection, path: str) -> None:
        for k, m in c.items():
            here = f"{path}/{k}" if path else k
            if isinstance(m, Collection):
                walk(m, here)
            elif isinstance(m, SparseNDArray | DenseNDArray):
                out[here] = {"kind": m.kind, "shape": m.shape, "maxshape": m.maxshape, "non_empty_domain": m.non_empty_domain()}
            else:
                out[here] = {"kind": m.kind, "domain": m.domain, "maxdomain": m.maxdomain, "non_empty_domain": m.non_empty_domain()}

    walk(Experiment.open(uri, spark=spark), "")
    return out


def show_experiment_shapes(uri: str, spark: SparkSession | None = None) -> str:
    return "\n".join(f"[{v['kind']}] {k}: {v.get('shape') or v.get('domain')} of {v.get('maxshape') or v.get('maxdomain')}" for k, v in experiment_shapes(uri, spark).items())


def resize_experiment(uri: str, *, nobs: int, nvars: Mapping[str, int], check_only: bool = False, spark: SparkSession | None = None) -> tuple[bool, str]:
    """Grow obs, var and all their matrices; with check_only only say whether that can be done."""
    exp = Experiment.open(uri, "w", spark=spark)
    jobs: list[tuple[StoredArray, list]] = [(exp["obs"], [(0, nobs - 1)])]
    for name, ms in exp["ms"].items():
        n = nvars.get(name, ms["var"].domain[0][1] + 1)
        jobs.append((ms["var"], [(0, n - 1)]))
        for slot, (a, b) in {"X": (nobs, n), "obsp": (nobs, nobs), "varp": (n, n), "obsm": (nobs, None), "varm": (n, None)}.items():
            if slot in ms:
                jobs += [(x, [(0, a - 1), (0, b - 1) if b else x.domain[1]]) for _, x in ms[slot].items()]
    for array, want in jobs:
        ok, why = array._grow(want, True)
        if not ok:
            if check_only:
                return False, f"{array.uri}: {why}"
            raise ValueError(f"{array.uri}: {why}")
    if not check_only:
        for array, want in jobs:
            if [list(w) for w in want] != [list(d) for d in array.domain]:
                array._grow(want, False)
    return True, ""
