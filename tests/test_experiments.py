from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from matrella.api import AxisQuery, DataFrame, Experiment, GeometryDataFrame, MultiscaleImage, PointCloudDataFrame, Scene
from matrella.errors import MatrellaError
from matrella.sources import bundles, spots
from matrella.spatial.transforms import AffineTransform, Axis, CoordinateSpace, IdentityTransform, ScaleTransform, UniformScaleTransform, transform_from_json
from matrella.spatial.wkb import envelope, point_wkb, polygon_wkb

VARS = {100: ["AKT1", "APOE", "ESR1", "TP53"], 200: ["APOE", "EGFR", "TP53", "VEGFA"]}


def source(ids, base, **more):
    x = np.array([[base + 10 * i + j if (i + j) % 2 else 0 for j in range(4)] for i in range(3)], "f4")
    obs = pd.DataFrame({"obs_id": ids, "cell_type": pd.Categorical(["B cell", "T cell", "B cell"]), "is_primary_data": [True, False, True]})
    var = pd.DataFrame({"var_id": VARS[base], "means": np.arange(4, dtype="f4")})
    return bundles.Source(obs, var, x, obsm={"pca": np.arange(6.0).reshape(3, 2) + base}, obsp={"nn": np.ones((3, 3))}, **more)


@pytest.fixture(scope="module")
def uri(spark, tmp_path_factory):
    u = str(tmp_path_factory.mktemp("e") / "exp")
    a, b = source(["A", "B", "C"], 100, uns={"n": 1, "deep": {"s": "x", "v": np.arange(3)}, "names": ["p", "q"]}), source(["D", "E", "F"], 200)
    bundles.write_experiment(u, a, registration=bundles.register([a]))
    with pytest.raises(MatrellaError):
        bundles.write_experiment(u, b)
    reg = bundles.register([a, b], u, allow_duplicate_obs_ids=True)  # the first one's ids are stored already
    with pytest.raises(MatrellaError):
        bundles.append(u, b, reg)
    reg.prepare(u, "RNA")
    bundles.append(u, b, reg)
    return u


def test_append_by_registration(uri):
    b = bundles.to_bundle(uri)
    assert b.obs.index.tolist() == list("ABCDEF") and b.obs["cell_type"].cat.categories.tolist() == ["B cell", "T cell"]
    assert b.var.index.tolist() == ["AKT1", "APOE", "ESR1", "TP53", "EGFR", "VEGFA"]
    x = b.X.to_numpy()
    assert x[0].tolist() == [0, 101, 0, 103, 0, 0] and x[3].tolist() == [0, 0, 0, 0, 201, 203] and x[4].tolist() == [0, 210, 0, 212, 0, 0]
    assert b.obsm["pca"][3].tolist() == [200, 201] and b.obsp["nn"].nnz == 18
    assert b.uns["n"] == 1 and b.uns["deep"]["v"].tolist() == [0, 1, 2] and b.uns["names"].tolist() == ["p", "q"]


def test_registration_rules(spark):
    a = source(["A", "B", "C"], 100)
    with pytest.raises(MatrellaError):
        bundles.register([a, source(["C", "D", "E"], 200)])
    r = bundles.register([a, source(["C", "D", "E"], 200)], allow_duplicate_obs_ids=True)
    assert r.obs_size == 5 and r.var_size == 6
    with pytest.raises(ValueError):
        r.of("obs", ["A", "zzz"], spark)


def test_axis_query(uri):
    exp = Experiment.open(uri)
    with exp.axis_query("RNA", obs_query=AxisQuery(value_filter="cell_type == 'B cell'"), var_query=AxisQuery(coords=(slice(1, 3),))) as q:
        assert (q.n_obs, q.n_vars) == (4, 3)
        assert sorted(q.obs_joinids().to_pylist()) == [0, 2, 3, 5]
        assert q.indexer.by_obs(pa.array([0, 1, 3])).tolist() == [0, -1, 2]
        assert q.indexer.by_var([3, 5]).tolist() == [2, -1]
        assert sorted(tuple(r.values()) for r in q.X("data").concat().to_pylist())[:2] == [(0, 1, 101.0), (0, 3, 103.0)]
        assert sorted(map(tuple, q.X_reindexed("data").collect()))[0] == (0, 0, 101.0)
        assert q.obs(["obs_id"]).concat().column_names == ["obs_id", "cell_type"]
        assert q.obsm("pca").concat().num_rows == 8 and q.obsp("nn").concat().num_rows == 8
        b = q.to_bundle(obsm_layers=["pca"], obsp_layers=["nn"], drop_levels=True)
        assert q.to_bundle(obsm_layers=["pca"], width_hints={"pca": 3}).obsm["pca"].shape == (4, 3)
        assert b.X.shape == (4, 3) and b.obs["cell_type"].cat.categories.tolist() == ["B cell"] and b.obsm["pca"].shape == (4, 2)
        with pytest.raises(KeyError):
            q.X("zzz")
        with pytest.raises(ValueError):
            q.to_bundle(None, X_layers=["data"])
    with pytest.raises(ValueError):
        exp.axis_query("zzz")
    with pytest.raises(TypeError):
        AxisQuery(coords="abc")
    with exp.axis_query("RNA", obs_query=AxisQuery(coords=([],))) as q:
        assert q.n_obs == 0 and q.X("data").concat().num_rows == 0


def test_updates_and_shapes(spark, tmp_path):
    u = f"{tmp_path}/e"
    a = source(["A", "B", "C"], 100)
    bundles.write_experiment(u, a)
    new = a.obs.assign(extra=[1, 2, 3]).drop(columns="is_primary_data")
    bundles.update_obs(u, new)
    assert bundles.to_bundle(u).obs["extra"].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        bundles.update_obs(u, new.iloc[:2])
    with pytest.raises(ValueError):
        bundles.update_var(u, a.var.assign(means=["a", "b", "c", "d"]))
    bundles.add_X_layer(u, "RNA", "twice", a.X * 2)
    exp = Experiment.open(u, "w")
    bundles.update_matrix(exp["ms"]["RNA"]["X"]["twice"], np.full((3, 4), 7, "f4"))
    b = bundles.to_bundle(u)
    assert b.layers["twice"].to_numpy().tolist() == [[7] * 4] * 3
    assert bundles.resize_experiment(u, nobs=2, nvars={}, check_only=True)[0] is False
    bundles.resize_experiment(u, nobs=10, nvars={"RNA": 5})
    shapes = bundles.experiment_shapes(u)
    assert shapes["ms/RNA/X/data"]["shape"] == (10, 5) and shapes["ms/RNA/obsp/nn"]["shape"] == (10, 10) and shapes["obs"]["domain"] == ((0, 9),)
    assert "ms/RNA/X/data" in bundles.show_experiment_shapes(u)
    bundles.write_experiment(f"{tmp_path}/s", a, schema_only=True)
    assert Experiment.open(f"{tmp_path}/s")["obs"].count == 0


def test_cascading_deletes(spark, tmp_path):
    u = f"{tmp_path}/e"
    bundles.write_experiment(u, source(["A", "B", "C"], 100))
    exp = Experiment.open(u, "w")
    p = exp.add_new_dataframe("obs_spatial_presence", schema=pa.schema([("scene_id", pa.string()), ("data", pa.bool_())]), index_column_names=["soma_joinid", "scene_id"], domain=[(0, 2), ("", "")])
    p.write(pa.table({"soma_joinid": [0, 1, 2], "scene_id": ["s1", "s2", "s2"], "data": [True, True, False]}))
    with exp.reopen("r").axis_query("RNA", obs_query=AxisQuery(coords=(slice(0, 2),))) as q:
        assert q.obs_scene_ids() == ["s1", "s2"]
    with pytest.raises(ValueError):
        exp.reopen("d").obs_axis_delete()
    exp.obs_axis_delete(value_filter="obs_id == 'zzz'")
    exp.obs_axis_delete(value_filter="obs_id == 'A'")
    Experiment.open(u, "d").var_axis_delete("RNA", (slice(3, 3),))
    b = bundles.to_bundle(u)
    assert b.obs.index.tolist() == ["B", "C"] and b.var.index.tolist() == ["AKT1", "APOE", "ESR1"]
    assert b.obsp["nn"].nnz == 4 and b.X.to_numpy().tolist() == [[110, 0, 112], [0, 121, 0]]
    assert Experiment.open(u)["obs_spatial_presence"].count == 2


# --- spatial ---------------------------------------------------------------------------------------------------------------------------


def test_transforms():
    s = ScaleTransform(["x", "y"], ["u", "v"], [2, 4])
    a = AffineTransform(["u", "v"], ["p", "q"], [[1, 1, 5], [0, 1, -1], [0, 0, 1]])
    both = a @ s
    assert both.apply([[1, 1]]).tolist() == [[11, 3]] and np.allclose((both.inverse_transform() @ both).augmented_matrix, np.eye(3))
    assert isinstance(s.inverse_transform() @ s, IdentityTransform)
    assert type(UniformScaleTransform(["x"], ["y"], 3) @ UniformScaleTransform(["z"], ["x"], 2)) is UniformScaleTransform
    assert transform_from_json(both.to_json()) == both
    low, high = a.box([0, 0], [1, 1])
    assert low.tolist() == [5, -1] and high.tolist() == [7, 0]
    with pytest.raises(ValueError):
        s @ s
    with pytest.raises(ValueError):
        CoordinateSpace(["x", "x"])
    with pytest.raises(ValueError):
        Axis("soma_x")
    space = CoordinateSpace([Axis("x", "um"), Axis("y")])
    assert CoordinateSpace.from_json(space.to_json()) == space


def test_geometry_codec():
    blob = polygon_wkb([0, 0, 2, 0, 2, 3])
    assert [x.tolist() for x in envelope(blob)] == [[0, 0], [2, 3]]
    assert envelope(point_wkb(4, 5))[0].tolist() == [4, 5]
    many = b"\x01" + (7).to_bytes(4, "little") + (2).to_bytes(4, "little") + blob + point_wkb(-1, 9)
    assert [x.tolist() for x in envelope(many)] == [[-1, 0], [2, 9]]
    with pytest.raises(ValueError):
        polygon_wkb([0, 0, 1, 1])


def test_spatial_objects(spark, tmp_path):
    p = PointCloudDataFrame.create(f"{tmp_path}/p", schema=pa.schema([("x", pa.float64()), ("y", pa.float64())]), domain=[(-10, 100), (-10, 100), (0, 10)])
    p.write(pa.table({"x": [1.0, 2, 50], "y": [1.0, 5, 50], "soma_joinid": [0, 1, 2]}))
    ids = lambda read: sorted(read.concat()["soma_joinid"].to_pylist())
    assert ids(p.reopen("r").read_spatial_region([0, 0, 2, 5])) == [0, 1]
    assert ids(p.read_spatial_region([0, 0, 20, 20], region_transform=ScaleTransform(["x", "y"], ["x", "y"], [10, 10]), value_filter="y < 3")) == [0]
    with pytest.raises(NotImplementedError):
        p.read_spatial_region("circle")
    with pytest.raises(ValueError):
        p.read_spatial_region([5, 5, 0, 0])
    g = GeometryDataFrame.create(f"{tmp_path}/g", schema=pa.schema([("quality", pa.float32())]))
    g.from_outlines(spark.createDataFrame([(0, 1.0, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0]), (1, 2.0, [5.0, 5.0, 6.0, 5.0, 6.0, 6.0])], "soma_joinid bigint, quality float, soma_geometry array<double>"))
    g.write(pa.table({"soma_joinid": [2], "quality": pa.array([3], pa.float32()), "soma_geometry": [polygon_wkb([1.5, 1.5, 9, 9, 1.5, 9])]}))
    assert ids(g.reopen("r").read_spatial_region([0.5, 0.5, 2, 2])) == [0, 2]
    with pytest.raises(NotImplementedError):
        g.reopen("d").delete_cells(())
    m = MultiscaleImage.create(f"{tmp_path}/m", type=pa.uint8(), level_shape=(1, 8, 8))
    m["level0"].write((), np.arange(64, dtype="u1").reshape(1, 8, 8))
    m.add_new_level("half", shape=(1, 4, 4))
    assert m.levels() == [("level0", (1, 8, 8)), ("half", (1, 4, 4))]
    t, back = m.reopen("r").read_spatial_region(0, [2.5, 1, 4, 3])
    assert t.to_numpy().tolist() == [[[10, 11], [18, 19]]] and back.apply([[0, 0]]).tolist() == [[2, 1]]
    t, back = m.read_spatial_region("half", [2, 2, 6, 6])
    assert t.shape == (1, 2, 2) and back.apply([[1, 1]]).tolist() == [[4, 4]]
    s = Scene.create(f"{tmp_path}/s", coordinate_space=["x", "y"])
    s.add_new_collection("img").set("slide", m.reopen("w"))
    s.set_transform("img", "slide", ScaleTransform(["x", "y"], ["x", "y"], [2, 2]))
    assert s.reopen("r").get_transform_from("img", "slide").linear[0, 0] == 0.5
    with pytest.raises(KeyError):
        s.get_transform_to("img", "zzz")


def test_spots(spark, tmp_path):
    path = f"{tmp_path}/spots.csv"
    with open(path, "w") as f:
        f.write("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nA,1,0,0,10.5,20.5\nB,0,1,1,11,21\n")
    obs = spark.createDataFrame([("A", 7), ("C", 8)], "obs_id string, soma_joinid bigint")
    got = spots.spots(spots.read_positions(spark, path), obs, radius=2)
    assert [r.asDict() for r in got.collect()] == [{"x": 20.5, "y": 10.5, "soma_joinid": 7, "in_tissue": 1, "array_row": 0, "array_col": 0, "radius": 2.0}]
    assert spots.presence([("s", got)]).collect()[0].data
    with pytest.raises(ValueError):
        spots.with_regions(obs, spark.createDataFrame([("A", 1), ("A", 2)], "obs_id string, r int"), "obs_id")


def test_streamed_appends(spark, tmp_path):
    from matrella.streaming.appends import append_stream, follow

    f = DataFrame.create(f"{tmp_path}/f", schema=pa.schema([("soma_joinid", pa.int64()), ("v", pa.int64())]), domain=[(0, 99)])
    src = f"{tmp_path}/src"
    spark.createDataFrame([(1, 1), (2, 2)], "soma_joinid bigint, v bigint").write.parquet(src)
    stream = lambda: spark.readStream.schema("soma_joinid bigint, v bigint").parquet(src)
    append_stream(stream(), f, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(2, 20), (3, 30)], "soma_joinid bigint, v bigint").write.mode("append").parquet(src)
    append_stream(stream(), f, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r.values()) for r in f.reopen("r").read().concat().to_pylist()) == [(1, 1), (2, 20), (3, 30)]
    q = follow(f).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("followed").count() == 4


def test_streams_do_not_share_a_ledger(spark, tmp_path):
    """Checkpoints of the same name, and a checkpoint begun anew, are other queries; following after a consolidation gives no row twice."""
    from matrella.streaming.appends import append_stream, follow

    f = DataFrame.create(f"{tmp_path}/f", schema=pa.schema([("soma_joinid", pa.int64()), ("v", pa.int64())]), domain=[(0, 99)], allows_duplicates=True)
    for k, name in enumerate(("one", "two")):
        spark.range(5 * k, 5 * k + 5).selectExpr("id as soma_joinid", "id as v").write.parquet(f"{tmp_path}/{name}/src")
        stream = spark.readStream.schema("soma_joinid bigint, v bigint").parquet(f"{tmp_path}/{name}/src")
        for _ in range(2):
            append_stream(stream, f, f"{tmp_path}/{name}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert f.reopen("r").count == 10

    seen = []
    sink = lambda: follow(f).writeStream.foreachBatch(lambda b, _: seen.extend(r.soma_joinid for r in b.collect())).option("checkpointLocation", f"{tmp_path}/follow").trigger(availableNow=True).start().awaitTermination()
    sink()
    with pytest.raises(MatrellaError):
        f.reopen("w").write(pa.table({"soma_joinid": [500], "v": [1]}))
    f.reopen("w").consolidate_and_vacuum()
    f.write(pa.table({"soma_joinid": [50], "v": [1]}))
    sink()
    assert sorted(seen) == [*range(10), 50]


def test_stored_ids_are_refused(spark, uri):
    with pytest.raises(MatrellaError, match="A"):
        bundles.register([source(["A", "X", "Y"], 100)], uri)
    r = bundles.register([source(["X", "A", "Y"], 100)], uri, allow_duplicate_obs_ids=True)
    assert {x.label: x.soma_joinid for x in r.obs.where("is_new").collect()} == {"X": 6, "Y": 7} and r.obs_size == 8
    part = r.subset(source(["Y", "A", "A"], 200))
    assert sorted(x.label for x in part.obs.collect()) == ["A", "Y"] and part.obs_size == 8 and part.var.count() == 4


def test_inputs_may_be_spark_frames(spark, tmp_path):
    """Frames and COO in, nothing of them on the driver: the same experiment as from pandas."""
    u = f"{tmp_path}/e"
    obs = lambda ids: spark.createDataFrame([(k, i, 1.5 * k) for k, i in enumerate(ids)], "place bigint, obs_id string, n double")
    var = lambda ids: spark.createDataFrame(list(enumerate(ids)), "place bigint, var_id string")
    x = lambda base: spark.createDataFrame([(i, j, float(base + 10 * i + j)) for i in range(3) for j in range(4) if (i + j) % 2], "i bigint, j bigint, value double")
    a = bundles.Source(obs("CAB"), var(VARS[100]), x(100), obsm={"pca": spark.createDataFrame([(0, 1, 2.0)], "i bigint, j bigint, v double")})
    b = bundles.Source(obs("FDE"), var(VARS[200]), x(200))
    bundles.write_experiment(u, a, registration=bundles.register([a]))
    reg = bundles.register([b], u)
    reg.prepare(u, "RNA")
    bundles.append(u, b, reg)
    got = bundles.to_bundle(u)
    assert got.obs.index.tolist() == list("CABFDE") and got.var.index.tolist() == ["AKT1", "APOE", "ESR1", "TP53", "EGFR", "VEGFA"]
    assert got.X.to_numpy()[3].tolist() == [0, 0, 0, 0, 201, 203] and got.obsm["pca"].tolist()[0] == [0, 2] and got.obs["n"].tolist() == [0, 1.5, 3] * 2
    new = spark.createDataFrame([(k, f"x{k}") for k in range(6)], "place bigint, obs_id string")
    bundles.update_obs(u, new)
    assert Experiment.open(u)["obs"].schema.names == ["soma_joinid", "obs_id"]
    with pytest.raises(ValueError):
        bundles.update_obs(u, new.where("place <> 2"))
    with pytest.raises(ValueError):
        bundles.register([bundles.Source(new.drop("place"), var("ab"))])


def test_labelled_matrices_and_parts(spark, uri):
    exp = Experiment.open(uri)
    with exp.axis_query("RNA", obs_query=AxisQuery(value_filter="cell_type == 'B cell'")) as q:
        m = q.to_labelled_matrix("X", "data", "obs_id", "var_id")
        assert m.rows == ["A", "C", "D", "F"] and m["A", "APOE"] == 101 and m["A", "AKT1"] == 0 and m.matrix.shape == (4, 6)
        assert q.to_labelled_matrix("obsm", "pca", "obs_id").columns == [0, 1]
        with pytest.raises(ValueError):
            q.to_labelled_matrix("X", "data", "cell_type")
        with pytest.raises(KeyError):
            q.to_labelled_matrix("X", "zzz")
        parts = q.X_parts("data")
        assert parts.count() == q.X("data").df.count()
        got = q.read(["data"], ["obs_id"])
        assert set(got) == {"obs", "var", "X"} and got["X"]["data"].count() == parts.count()

    class Backwards:
        def __init__(self, ids):
            self.ids = list(ids)

        def get_indexer(self, target):
            return np.array([self.ids.index(int(x)) for x in np.asarray(target)], np.int64)

    with exp.axis_query("RNA", index_factory=Backwards) as q:
        assert q.indexer.by_obs([3]).tolist() == [3] and q.to_bundle().X.shape == (6, 6)


def test_collections_in_memory(spark, uri, tmp_path):
    from matrella.api.collections import EphemeralExperiment, EphemeralMeasurement

    exp = Experiment.open(uri)
    e = EphemeralExperiment()
    e.set("obs", exp["obs"])
    with pytest.raises(MatrellaError):
        e["obs"] = exp["obs"]
    with pytest.raises(TypeError):
        EphemeralMeasurement().set("var", exp["ms"])
    e["ms"] = exp["ms"]
    stored = e.store(f"{tmp_path}/e")
    assert stored.reopen("r")["obs"].count == exp["obs"].count and stored.kind == "Experiment"


def test_spots_become_a_scene(spark, tmp_path):
    from matrella.api.spatial import scene_export

    path = f"{tmp_path}/spots.csv"
    with open(path, "w") as f:
        f.write("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nA,1,0,0,10.5,20.5\nC,0,1,1,11,21\nZ,1,5,5,1,1\n")
    u = f"{tmp_path}/e"
    spots.write_spots(u, source(["A", "B", "C"], 100), spots.read_positions(spark, path), "s1", radius=2, images={"hires": np.arange(12, dtype="u1").reshape(1, 3, 4)}, scales={"hires": 0.5})
    exp = Experiment.open(u)
    with exp.axis_query("RNA", obs_query=AxisQuery(value_filter="obs_id in ['A', 'B']")) as q:
        got = q.spatial()
    assert list(got) == ["s1"] and not got["s1"]["points"]
    assert [(r.soma_joinid, r.x, r.y, r.radius) for r in got["s1"]["shapes"]["loc"].collect()] == [(0, 20.5, 10.5, 2.0)]
    pixels, back = got["s1"]["images"]["hires"]
    assert pixels.shape == (1, 3, 4) and back.apply([[1, 1]]).tolist() == [[2, 2]]
    assert exp["obs_spatial_presence"].count == 2 and scene_export(exp["spatial"]["s1"])["shapes"]["loc"].count() == 2


def test_diagnostics(spark, uri):
    from matrella import diagnostics

    obs = Experiment.open(uri)["obs"]
    assert diagnostics.object_stats(obs)["fragments"] == 2 and "pyspark" in diagnostics.versions()
    assert "Scan parquet" in diagnostics.explained(obs.read().df)
    eta = diagnostics.Eta()
    assert eta.left(10) is None
    for k in range(4):
        eta.add(2.0 * k, at=float(k))
    assert abs(eta.left(10) - 2) < 1e-9
    with diagnostics.timed("nothing") as t:
        pass
    assert t["seconds"] >= 0
    diagnostics.set_log_level("error")


def test_geometries_can_be_streamed(spark, tmp_path):
    from matrella.streaming.appends import append_stream

    g = GeometryDataFrame.create(f"{tmp_path}/g", schema=pa.schema([("quality", pa.float32())]))
    rows = [(k, float(k), bytearray(point_wkb(k, k + 1))) for k in range(4)]
    spark.createDataFrame(rows, "soma_joinid bigint, quality float, soma_geometry binary").write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema("soma_joinid bigint, quality float, soma_geometry binary").parquet(f"{tmp_path}/src")
    append_stream(stream, g, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(g.reopen("r").read_spatial_region([1, 0, 2, 9]).concat()["soma_joinid"].to_pylist()) == [1, 2]
