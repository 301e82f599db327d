from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from matrella.api import BatchSize, Collection, DataFrame, DenseNDArray, Experiment, IOfN, SparseNDArray, X_as_series, exists, open_object
from matrella.api.collections import sanitize_key
from matrella.errors import AlreadyExistsError, ConflictError, DoesNotExistError, MatrellaError
from matrella.operators.assemble import Compressed

SCHEMA = pa.schema([("soma_joinid", pa.int64()), ("float", pa.float64()), ("string", pa.large_string())])


def rows(obj, *args, **kw):
    return sorted(tuple(r.values()) for r in obj.read(*args, **kw).concat().to_pylist())


def table(ids, base=0.0, text="x"):
    return pa.table({"soma_joinid": pa.array(ids, pa.int64()), "float": [base + i for i in ids], "string": [f"{text}{i}" for i in ids]})


def test_time_travel_and_upsert(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA, domain=[(0, 9)], timestamp=10)
    f.reopen("w", 20).write(table([0, 1], 0, "a"))
    f.reopen("w", 30).write(table([1, 2], 100, "b"))
    assert rows(f.reopen("r")) == [(0, 0.0, "a0"), (1, 101.0, "b1"), (2, 102.0, "b2")]
    assert rows(f.reopen("r", 20)) == [(0, 0.0, "a0"), (1, 1.0, "a1")]
    assert rows(f.reopen("r", 15)) == []
    with pytest.raises(DoesNotExistError):
        f.reopen("r", 5).count
    assert (f.reopen("r").count, len(f), f.fragment_cell_count(), f.non_empty_domain()) == (3, 3, 4, ((0, 2),))
    # a value filter sees the latest version only
    assert rows(f, value_filter="string == 'a1'") == []
    assert rows(f, value_filter="string %in% c('b1', 'b2') && float > 101", syntax="r") == [(2, 102.0, "b2")]


def test_ledger(spark, tmp_path):
    """Random writes and deletes against a plain model: latest wins, deletes hit what was there, nothing comes back."""
    rng = np.random.default_rng(5)
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA, domain=[(0, 19)], timestamp=1)
    model: dict[int, float] = {}
    history = {}
    for step in range(2, 14):
        if rng.random() < 0.65:
            ids = sorted(set(rng.integers(0, 20, 5).tolist()))
            f.reopen("w", step).write(table(ids, step * 100.0))
            model |= {i: step * 100.0 + i for i in ids}
        else:
            lo = int(rng.integers(0, 18))
            f.reopen("d", step).delete_cells((slice(lo, lo + 2),), value_filter=f"float < {step * 60}")
            model = {i: v for i, v in model.items() if not (lo <= i <= lo + 2 and v < step * 60)}
        history[step] = dict(model)
    for step, want in history.items():
        assert {r[0]: r[1] for r in rows(f.reopen("r", step))} == want
    f.reopen("w", 50).consolidate_and_vacuum()
    assert {r[0]: r[1] for r in rows(f.reopen("r"))} == model
    assert len(f.state.fragments) == 1 and not f.state.deletes


def test_frame_rules(spark, tmp_path):
    u = str(tmp_path)
    with pytest.raises(ValueError):
        DataFrame.create(f"{u}/a", schema=pa.schema([("soma_x", pa.int64())]))
    with pytest.raises(ValueError):
        DataFrame.create(f"{u}/a", schema=SCHEMA, index_column_names=["nope"])
    with pytest.raises(ValueError):
        DataFrame.create(f"{u}/a", schema=SCHEMA, domain=[(5, 1)])
    for bad in (pa.float16(), pa.date32(), pa.time64("us"), pa.duration("s"), pa.timestamp("us", "UTC"), pa.list_(pa.int32())):
        with pytest.raises(TypeError):
            DataFrame.create(f"{u}/a", schema=pa.schema([("c", bad)]))
    with pytest.raises(TypeError):
        DataFrame.create(f"{u}/a", schema=pa.schema([("c", pa.dictionary(pa.int8(), pa.string()))]), index_column_names=["c"])
    f = DataFrame.create(f"{u}/f", schema=SCHEMA, domain=[(0, 4)])
    with pytest.raises(AlreadyExistsError):
        DataFrame.create(f"{u}/f", schema=SCHEMA)
    with pytest.raises(MatrellaError):
        f.write(table([7]))
    with pytest.raises(ValueError):
        f.write(table([1]).append_column("more", pa.array([1])))
    with pytest.raises(MatrellaError):
        f.write(pa.table({"soma_joinid": [1], "float": ["text"], "string": ["a"]}))
    with pytest.raises(MatrellaError):
        f.read()
    assert f.reopen("r").count == 0 and f.non_empty_domain() is None
    with pytest.raises(NotImplementedError):
        f.read(batch_size=BatchSize(count=5))
    with pytest.raises(ValueError):
        f.read(partitions=IOfN(0, 2))
    assert f.read(partitions=IOfN(0, 1)).concat().num_rows == 0
    assert f.schema.names == ["soma_joinid", "float", "string"]
    assert DataFrame.exists(f"{u}/f") and not SparseNDArray.exists(f"{u}/f") and not exists(f"{u}/none")


def test_index_types_and_slices(spark, tmp_path):
    schema = pa.schema([("name", pa.string()), ("n", pa.uint32()), ("at", pa.timestamp("s")), ("big", pa.uint64()), ("v", pa.int8())])
    f = DataFrame.create(f"{tmp_path}/f", schema=schema, index_column_names=["name", "n"], domain=[("", ""), (0, 100)])
    t = pa.table({"soma_joinid": [0, 1, 2], "name": ["a", "b", "c"], "n": pa.array([1, 2, 3], pa.uint32()), "at": pa.array([0, 1, 2], pa.timestamp("s")), "big": pa.array([0, 1, 2**64 - 1], pa.uint64()), "v": pa.array([1, None, 3], pa.int8())})
    f.write(t)
    f.reopen("r")
    got = f.read((slice("a", "b"),), ["name", "big"], result_order="column-major").concat()
    assert got.column_names == ["name", "big"] and got.num_rows == 2
    assert f.read(([], )).concat().num_rows == 0
    assert [r["name"] for r in f.read(value_filter="at >= 1 and v != None").concat().to_pylist()] == ["c"]
    assert int(f.read(("c", 3)).concat()["big"][0].as_py()) == 2**64 - 1
    assert sum(t.num_rows for t in f.read()) == 3


def test_levels(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=pa.schema([("c", pa.dictionary(pa.int8(), pa.string(), ordered=True)), ("p", pa.string())]), domain=[(0, 9)])
    f.write(pa.table({"soma_joinid": [0, 1], "c": pa.array(["x", None]).dictionary_encode(), "p": pa.array(["k", "k"]).dictionary_encode()}))
    assert f.get_enumeration_values(["c"]) == {"c": ["x"]}
    f.extend_enumeration_values({"c": ["y"]})
    with pytest.raises(ValueError):
        f.extend_enumeration_values({"c": ["y", "z"]})
    with pytest.raises(ValueError):
        f.extend_enumeration_values({"c": ["z", "z"]}, deduplicate=True)
    f.extend_enumeration_values({"c": ["y", "z"]}, deduplicate=True)
    assert f.get_enumeration_values(["c"]) == {"c": ["x", "y", "z"]}
    with pytest.raises(KeyError):
        f.get_enumeration_values(["p"])
    assert f.schema.field("c").type.ordered


def test_schema_and_domain(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA, domain=[(0, 1)])
    f.write(table([0, 1]))
    f.update_schema([pa.field("new", pa.int32())], ["string"])
    f.reopen("r")
    assert f.read().concat().to_pylist() == [{"soma_joinid": 0, "float": 0.0, "new": None}, {"soma_joinid": 1, "float": 1.0, "new": None}]
    f.reopen("w")
    assert f.change_domain([(0, 0)], check_only=True)[0] is False
    with pytest.raises(ValueError):
        f.change_domain([(1, 5)])
    assert f.resize_soma_joinid_shape(5) == (True, "") and f.domain == ((0, 4),)
    with pytest.raises(ValueError):
        f.update_schema(drop=["soma_joinid"])


def test_metadata(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA, timestamp=10)
    for k, v in {"a": 1, "b": 2.5, "c": "x", "d": b"\x00\xff", "e": float("inf")}.items():
        f.metadata[k] = v
    assert dict(f.reopen("r").metadata) == {"a": 1, "b": 2.5, "c": "x", "d": b"\x00\xff", "e": float("inf")}
    with pytest.raises(MatrellaError):
        f.metadata["a"] = 2
    f.reopen("w", 20)
    del f.metadata["a"]
    with pytest.raises(TypeError):
        f.metadata["l"] = [1]
    assert "a" not in f.metadata and "a" in f.reopen("r", 15).metadata


def test_deletes(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA, domain=[(0, 7)])
    f.write(table(range(8)))
    f.reopen("d")
    for bad, kind in (({}, ValueError), ({"coords": (slice(20, 30),)}, IndexError), ({"coords": ([99],)}, IndexError), ({"coords": (slice(5, 2),)}, ValueError)):
        with pytest.raises(kind):
            f.delete_cells(**bad)
    f.delete_cells(([],))
    f.delete_cells(([1, 2],))
    f.delete_cells((slice(4, 7),), value_filter="float > 5")
    assert [r[0] for r in rows(f.reopen("r"))] == [0, 3, 4, 5]
    assert f.domain == ((0, 7),) and f.non_empty_domain() == ((0, 7),)
    f.reopen("w").write(table([1], 50.0))
    assert [r[:2] for r in rows(f.reopen("r"))] == [(0, 0.0), (1, 51.0), (3, 3.0), (4, 4.0), (5, 5.0)]


def test_duplicates_and_repeated_rows(spark, tmp_path):
    one = DataFrame.create(f"{tmp_path}/one", schema=SCHEMA, domain=[(0, 9)])
    one.write(pa.concat_tables([table([1, 1]), table([1], 5.0)]))
    assert rows(one.reopen("r")) == [(1, 6.0, "x1")]
    many = DataFrame.create(f"{tmp_path}/many", schema=SCHEMA, domain=[(0, 9)], allows_duplicates=True)
    many.write(table([1, 1]))
    many.write(table([1], 5.0))
    assert len(rows(many.reopen("r"))) == 3


@pytest.mark.parametrize("how", ["table", "coo", "csr", "csc", "block"])
def test_sparse_writes(spark, tmp_path, how):
    dense = np.zeros((5, 4), np.float32)
    dense[0, 1], dense[4, 3], dense[2, 2] = 1, 2, 3
    i, j = np.nonzero(dense)
    values = {
        "table": lambda: pa.table({"soma_dim_0": i, "soma_dim_1": j, "soma_data": dense[i, j]}),
        "coo": lambda: pa.SparseCOOTensor.from_dense_numpy(dense),
        "csr": lambda: pa.SparseCSRMatrix.from_dense_numpy(dense),
        "csc": lambda: pa.SparseCSCMatrix.from_dense_numpy(dense),
        "block": lambda: Compressed.from_ijd(i, j, dense[i, j], (5, 4), "csc"),
    }[how]()
    a = SparseNDArray.create(f"{tmp_path}/a", type=pa.float32(), shape=(5, 4))
    a.write(values)
    a.reopen("r")
    assert (a.nnz, a.shape, a.ndim, str(a.type)) == (3, (5, 4), 2, "float")
    data, at = next(a.read().coos()).to_numpy()
    back = np.zeros((5, 4), np.float32)
    back[at[:, 0], at[:, 1]] = data.ravel()
    assert np.array_equal(back, dense)
    assert X_as_series(a.read().tables().concat()).loc[(4, 3)] == 2


def test_sparse_blocks_deletes_resize(spark, tmp_path):
    a = SparseNDArray.create(f"{tmp_path}/a", type=pa.int32(), shape=(4, 4))
    i, j = np.indices((4, 4))
    a.write(pa.table({"soma_dim_0": i.ravel(), "soma_dim_1": j.ravel(), "soma_data": np.arange(16, dtype="i4")}))
    a.reopen("r")
    got = [(b.to_numpy().tolist(), ids[0].tolist()) for b, ids in a.read((slice(1, 3),)).blockwise(0, size=2).compressed()]
    assert got == [([[4, 5, 6, 7], [8, 9, 10, 11]], [1, 2]), ([[12, 13, 14, 15]], [3])]
    cols = [b.to_numpy().tolist() for b, _ in a.read(([0, 2], [3, 1])).blockwise(1, size=1).compressed()]
    assert cols == [[[3], [11]], [[1], [9]]]
    t, ids = next(a.read().blockwise(0, size=2, reindex_disable_on_axis=[0, 1]).tables())
    assert t.num_rows == 8 and ids[0].tolist() == [0, 1]
    with pytest.raises(NotImplementedError):
        a.read().blockwise(0).coos()
    with pytest.raises(ValueError):
        next(a.read().blockwise(0, reindex_disable_on_axis=0).compressed())
    with pytest.raises(ValueError):
        next(a.read().coos((4,)))
    a.reopen("d").delete_cells((slice(1, 2), [0, 3]))
    assert sorted(a.reopen("r").read().tables().concat()["soma_data"].to_pylist()) == [0, 1, 2, 3, 5, 6, 9, 10, 12, 13, 14, 15]
    assert a.resize((2, 4), check_only=True)[0] is False
    a.reopen("w").resize((6, 4))
    assert a.shape == (6, 4)
    for shape in ((), (0, 3), (None, 2)):
        with pytest.raises(ValueError):
            SparseNDArray.create(f"{tmp_path}/b", type=pa.int32(), shape=shape)
    with pytest.raises(TypeError):
        SparseNDArray.create(f"{tmp_path}/b", type=pa.string(), shape=(2,))


def test_dense(spark, tmp_path):
    d = DenseNDArray.create(f"{tmp_path}/d", type=pa.float32(), shape=(3, 4))
    d.write((slice(0, 1), slice(1, 2)), np.array([[1, 2], [3, 4]], "f4"))
    d.write((0, 1), np.array([[9]], "f4"))
    d.reopen("r")
    assert d.read().to_numpy().tolist() == [[0, 9, 2, 0], [0, 3, 4, 0], [0, 0, 0, 0]]
    assert d.read((1, slice(1, 2)), result_order="column-major").to_numpy().tolist() == [[3], [4]]
    assert d.read_frame((slice(0, 1),)).count() == 8
    with pytest.raises(ValueError):
        d.read(result_order="auto")
    with pytest.raises(NotImplementedError):
        d.delete_cells(())
    with pytest.raises(ValueError):
        d.reopen("w").write((), np.zeros((2, 2), "f4"))


def test_collections(spark, tmp_path):
    c = Collection.create(f"{tmp_path}/c")
    c.add_new_collection("inner").add_new_dataframe("f r/ame", schema=SCHEMA)
    with pytest.raises(MatrellaError):
        c.add_new_collection("inner")
    c.reopen("r")
    assert c.keys() == ["inner"] and isinstance(c["inner"]["f r/ame"], DataFrame)
    with pytest.raises(KeyError):
        c["zzz"]
    with pytest.raises(MatrellaError):
        del c["inner"]
    del c.reopen("d")["inner"]
    assert len(c.reopen("r")) == 0
    assert open_object(f"{tmp_path}/c", soma_type="collection").kind == "Collection"
    with pytest.raises(TypeError):
        open_object(f"{tmp_path}/c", soma_type=Experiment)
    with pytest.raises(DoesNotExistError):
        open_object(f"{tmp_path}/zzz")
    with pytest.raises(ValueError):
        sanitize_key("..")
    e = Experiment.create(f"{tmp_path}/e")
    with pytest.raises(TypeError):
        e.set("obs", c)
    with Collection.open(f"{tmp_path}/c") as again:
        pass
    with pytest.raises(MatrellaError):
        again.keys()


def test_log_entries_are_never_overwritten(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA)
    with pytest.raises(ConflictError):
        f.log.files.create(f"{f.log.folder}/{0:012d}.json", "{}")


def test_pandas_and_nulls(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA, domain=[(0, 9)])
    f.write(pd.DataFrame({"soma_joinid": [0, 1], "float": [np.nan, 1.0], "string": [None, ""]}))
    got = f.reopen("r").read(value_filter="string == None").concat().to_pylist()
    assert len(got) == 1 and got[0]["string"] is None
    with pytest.raises(ValueError):
        f.reopen("w").write(pa.table({"soma_joinid": pa.array([None], pa.int64()), "float": [1.0], "string": ["a"]}))


def test_order_within_a_millisecond(spark, tmp_path):
    """Of two writes, or a delete and a write, at one time the later one counts."""
    for k in range(3):
        f = DataFrame.create(f"{tmp_path}/f{k}", schema=SCHEMA, domain=[(0, 9)], timestamp=1)
        f.reopen("w", 5).write(table([1, 2], 10.0))
        f.reopen("w", 5).write(table([1], 20.0))
        assert [r[:2] for r in rows(f.reopen("r"))] == [(1, 21.0), (2, 12.0)]
        f.reopen("d", 7).delete_cells(([1, 2],))
        f.reopen("w", 7).write(table([2], 30.0))
        assert [r[:2] for r in rows(f.reopen("r"))] == [(2, 32.0)]
        f.reopen("w", 7).consolidate_and_vacuum()
        f.reopen("w", 7).write(table([2, 3], 40.0))
        f.reopen("d", 7).delete_cells(([3],))
        assert [r[:2] for r in rows(f.reopen("r"))] == [(2, 42.0)]


def test_consolidation_leaves_what_it_has_not_seen(spark, tmp_path):
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA, domain=[(0, 9)], timestamp=1)
    f.reopen("w", 2).write(table([1, 2, 3]))
    f.reopen("w", 3).write(table([3], 10.0))
    slow = DataFrame.open(f.uri, "w", timestamp=9)
    assert len(slow.state.fragments) == 2
    f.reopen("w", 5).write(table([1], 50.0))
    f.reopen("d", 6).delete_cells(([2],))
    slow.consolidate_and_vacuum()
    assert [r[:2] for r in rows(f.reopen("r"))] == [(1, 51.0), (3, 13.0)]


def test_long_logs_are_packed(spark, tmp_path, monkeypatch):
    from matrella.store import log

    monkeypatch.setattr(log, "PACK", 8)
    f = DataFrame.create(f"{tmp_path}/f", schema=SCHEMA)
    for k in range(20):
        f.metadata["n"] = k
    names = f.log.files.names(f.log.folder)
    assert sum(n.endswith(".pack") for n in names) == 2 and sum(n.endswith(".json") for n in names) == 21
    again, read = log.Log(spark, f.uri), []
    plain = again.files.read
    monkeypatch.setattr(again.files, "read", lambda uri: read.append(uri) or plain(uri))
    assert again.state().metadata == {"n": 19} and len(read) == 1 + 5


def test_coordinates_by_name_and_kind(spark, tmp_path):
    from matrella.functions.coords import PointSelection, SliceSelection, select_coords

    df = spark.createDataFrame([(k, -k) for k in range(9)], "a int, x int")
    assert select_coords(df, ["x"], [slice(-5, -3)]).count() == 3  # a signed key without a domain
    assert select_coords(df, ["a", "x"], {"x": SliceSelection(None, -7), "a": PointSelection([8, 1])}).count() == 1
    with pytest.raises(ValueError):
        select_coords(df, ["a"], {"b": 1})
    a = SparseNDArray.create(f"{tmp_path}/a", type=pa.int32(), shape=(4, 4))
    with pytest.raises(ValueError):
        a.write(pa.table({"soma_dim_0": [1], "soma_dim_1": [1], "soma_data": pa.array([1], pa.int32())}), bbox=[(0, 9), (0, 3)])
    with pytest.raises(MatrellaError):
        a.write(pa.table({"soma_dim_0": [3], "soma_dim_1": [1], "soma_data": pa.array([1], pa.int32())}), bbox=[(0, 2), (0, 3)])
    a.write(pa.table({"soma_dim_0": [2], "soma_dim_1": [1], "soma_data": pa.array([1], pa.int32())}), bbox=[(0, 2), (0, 3)])
    with pytest.raises(ValueError):
        a.reopen("r").read((slice(-1, 2),))


def test_blocks_in_one_job(spark, tmp_path):
    a = SparseNDArray.create(f"{tmp_path}/a", type=pa.int64(), shape=(10, 6))
    cells = [(i, j) for i in (0, 1, 7, 8) for j in (0, 5)]
    a.write(pa.table({"soma_dim_0": [i for i, _ in cells], "soma_dim_1": [j for _, j in cells], "soma_data": [10 * i + j for i, j in cells]}))
    blocks = a.reopen("r").read().blockwise(0, size=3)
    group = "blocks"
    spark.sparkContext.setJobGroup(group, group)
    got = [(t.num_rows, ids[0].tolist(), ids[1].tolist()) for t, ids in blocks.tables()]
    assert [x[0] for x in got] == [4, 0, 4, 0] and [x[1] for x in got] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]] and got[0][2] == list(range(6))
    rows = {r.block: r for r in blocks.assembled().collect()}
    assert sorted(rows) == [0, 2] and rows[2].indptr == [0, 0, 2, 4] and rows[2].indices == [0, 5, 0, 5] and rows[2].data == [70, 75, 80, 85] and rows[2].n_columns == 6
    sums = blocks.over(lambda block, t: pa.table({"block": [block], "n": [t.num_rows]}), "block bigint, n bigint")
    assert sorted(map(tuple, sums.collect())) == [(0, 4), (2, 4)]
    with pytest.raises(ValueError):
        next(a.read(([1, 1],)).blockwise(0).tables())


def test_forms_of_reads(spark, tmp_path):
    from matrella.api.objects import WriteOptions

    a = SparseNDArray.create(f"{tmp_path}/a", type=pa.int32(), shape=(3, 4))
    a.write_options = WriteOptions(compression="snappy", row_group_bytes=1 << 20, max_file_bytes=40)
    a.write(pa.table({"soma_dim_0": [2, 0, 1], "soma_dim_1": [1, 3, 0], "soma_data": pa.array([5, 6, 7], pa.int32())}))
    files = [p for p in (tmp_path / "a" / "frag").rglob("*.parquet")]
    assert len(files) == 3 and all(".snappy." in p.name for p in files)
    read = a.reopen("r").read()
    assert [x.tolist() for x in read.matrix("T")] == [[0, 1, 2], [3, 0, 1], [6, 7, 5]]
    assert read.matrix("R").kind == "csr" and read.matrix("C").to_numpy().tolist() == read.matrix("R").to_numpy().tolist()
    with pytest.raises(ValueError):
        read.matrix("X")
    for as_, kind in (("R", "csr"), ("C", "csc")):
        assert [m.kind for m, _ in read.blockwise(0, size=2).matrices(as_)] == [kind, kind]
    assert [m[2].tolist() for m, _ in read.blockwise(0, size=2).matrices("T")] == [[6, 7], [5]]
    d = DenseNDArray.create(f"{tmp_path}/d", type=pa.int32(), shape=(2, 2))
    d.write((0, slice(0, 1)), np.array([[1, 2]], "i4"))
    assert d.reopen("r").read_table(result_order="column-major")["soma_data"].to_pylist() == [1, 0, 2, 0]


def test_tensors_in_pieces(spark, tmp_path, monkeypatch):
    """Tensors of a bounded number of cells, together all of them; a read of nothing has none."""
    from matrella.api import objects

    monkeypatch.setattr(objects, "TENSOR_CELLS", 4, raising=False)
    a = SparseNDArray.create(f"{tmp_path}/a", type=pa.int32(), shape=(6, 3))
    i, j = np.indices((6, 3))
    a.write(pa.table({"soma_dim_0": i.ravel(), "soma_dim_1": j.ravel(), "soma_data": np.arange(18, dtype="i4")}))
    a.reopen("r")
    got = list(a.read().coos())
    assert [t.non_zero_length for t in got] == [4, 4, 4, 4, 2] and all(t.shape == (6, 3) for t in got)
    cells = [(*k, v) for t in got for v, k in zip(t.to_numpy()[0].ravel().tolist(), t.to_numpy()[1].tolist())]
    assert sorted(cells) == [(k // 3, k % 3, k) for k in range(18)]
    assert [t.non_zero_length for t in a.read((slice(0, 3),)).coos()] == [4, 4, 4]
    assert not list(a.read(([],)).coos())
    sums = a.read().coos_over(lambda t: pa.table({"n": [t.non_zero_length], "columns": [t.shape[1]]}), "n bigint, columns bigint", (6, 5)).collect()
    assert sum(r.n for r in sums) == 18 and {r.columns for r in sums} == {5}
    with pytest.raises(ValueError):
        a.read().coos_over(lambda t: None, "n bigint", (4,))
    series = a.read(result_order="column-major").tables().over(lambda t: pa.Table.from_pandas(X_as_series(t).reset_index(), preserve_index=False), "soma_dim_0 bigint, soma_dim_1 bigint, soma_data int")
    assert sorted(map(tuple, series.collect())) == [(k // 3, k % 3, k) for k in range(18)]
