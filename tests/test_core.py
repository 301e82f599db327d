from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matrella.functions.coords import check_coords, select_coords
from matrella.functions.labels import plain_integer
from matrella.operators import core
from matrella.operators.assemble import Compressed, IntIndexer, dense_rows, over_blocks, rows_per_block, strides


def ids(df, col="k"):
    return sorted(r[0] for r in df.select(col).collect())


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, chr(97 + k), datetime(2024, 1, 1 + k)) for k in range(20)] + [(None, None, None)], "k bigint, s string, t timestamp_ntz")


@pytest.mark.parametrize(
    ("dim", "coord", "want"),
    [
        ("k", slice(2, 4), [2, 3, 4]),
        ("k", slice(None, 1), [0, 1]),
        ("k", slice(18, None), [18, 19]),
        ("k", 7, [7]),
        ("k", [3, 3, 5, 99], [3, 5]),
        ("k", np.array([1, 2]), [1, 2]),
        ("k", pa.array([4]), [4]),
        ("k", pa.chunked_array([[4], [6]]), [4, 6]),
        ("k", list(range(0, 40, 2)), list(range(0, 20, 2))),
        ("k", [], []),
        ("s", slice("c", "e"), [2, 3, 4]),
        ("s", "d", [3]),
        ("t", slice(datetime(2024, 1, 2), datetime(2024, 1, 3)), [1, 2]),
        ("t", slice(np.datetime64("2024-01-02"), np.datetime64("2024-01-02")), [1]),
        ("t", slice(None, 0), []),
    ],
)
def test_coordinates(frame, dim, coord, want):
    assert ids(select_coords(frame, [dim], [coord])) == want


def test_coordinates_refused(frame):
    for bad, kind in (("abc", TypeError), ([1, 2], ValueError), ([np.zeros((2, 2))], ValueError), ([slice(1, 5, 2)], ValueError), ([slice(5, 1)], ValueError)):
        with pytest.raises(kind):
            select_coords(frame, ["k"], bad)
    with pytest.raises(ValueError):
        select_coords(frame, ["k"], [slice(50, 60)], [(0, 19)])
    assert check_coords((1,), 3) == [1, None, None]
    # a negative start is refused where the domain has no negative keys
    with pytest.raises(ValueError):
        select_coords(frame, ["k"], [slice(-3, 5)], [(0, 9)])
    assert select_coords(frame, ["k"], [slice(-3, 5)]).count() == frame.where("k between -3 and 5").count()


def test_pushdown_reaches_the_scan(spark, sf):
    df = select_coords(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderkey"], [slice(5, 9)]).select("o_custkey")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,5)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def test_labels(spark):
    raw = ["3", " 3", "03", "3.0", "3.", "-2", "3.5", "x", "", None, "1e3", "9" * 30, "\t4\n"]
    df = spark.createDataFrame([(x,) for x in raw], "s string").select(plain_integer(core.F.col("s")).alias("n"))
    assert [r.n for r in df.collect()] == [3, 3, 3, 3, 3, -2, None, None, None, None, None, None, 4]


def test_ordinals_and_lookup(spark, monkeypatch):
    keys = spark.createDataFrame([(k,) for k in (30, 10, 20, 10, None, 10**15)], "soma_joinid bigint")
    want = [(10, 0), (20, 1), (30, 2), (10**15, 3)]
    assert sorted(map(tuple, core.ordinals(keys).collect())) == want
    monkeypatch.setattr(core, "NUMBERING_STEP", 2)  # numbering in several ranges
    assert sorted(map(tuple, core.ordinals(keys).collect())) == want
    looked = core.lookup(spark.createDataFrame([(20,), (5,), (None,)], "x bigint"), "x", core.ordinals(keys))
    assert sorted((r.x is None, r.x, r.ordinal) for r in looked.collect()) == [(False, 5, -1), (False, 20, 1), (True, None, -1)]


def test_number_new(spark):
    known = spark.createDataFrame([("a", 0), ("b", 7)], "label string, soma_joinid bigint")
    inc = spark.createDataFrame([("b",), ("d",), ("c",), ("d",), (None,)], "label string")
    assert sorted(map(tuple, core.number_new(known, inc, "label").collect())) == [("a", 0, False), ("b", 7, False), ("c", 8, True), ("d", 9, True)]
    assert sorted(map(tuple, core.number_new(known.limit(0), inc, "label").collect())) == [("b", 0, True), ("c", 1, True), ("d", 2, True)]


def test_values_are_filtered_after_versions(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "k int, v int, s string")
    last = core.latest(df, ["k"], [core.F.desc("v")])
    assert core.read_rows(last, None, "s == 'old'").count() == 0


def test_projection_adds_filter_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert core.read_rows(df, ["a"], "b > 1").columns == ["a", "b"]
    with pytest.raises(ValueError):
        core.read_rows(df, ["zzz"])


cells = st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 4)), st.integers(1, 9), max_size=20)


@settings(max_examples=60, deadline=None)
@given(cells=cells, kind=st.sampled_from(["csr", "csc"]))
def test_compressed_round_trip(cells, kind):
    i, j = (np.array([c[k] for c in cells], np.int64) for k in range(2))
    d = np.array(list(cells.values()), np.int64)
    dense = np.zeros((7, 5), np.int64)
    dense[i, j] = d
    m = Compressed.from_ijd(i, j, d, (7, 5), kind)
    assert np.array_equal(m.to_numpy(), dense)
    a, b, c = m.to_coo()
    assert dict(zip(zip(a.tolist(), b.tolist()), c.tolist())) == cells
    piece = m.to_numpy(slice(1, 3))
    assert np.array_equal(piece, dense[1:3] if kind == "csr" else dense[:, 1:3])


def test_compressed_refused():
    with pytest.raises(ValueError):
        Compressed.from_ijd([0, 0], [1, 1], [1, 2], (2, 2))
    with pytest.raises(ValueError):
        Compressed.from_ijd([5], [0], [1], (2, 2))


@settings(max_examples=60, deadline=None)
@given(keys=st.lists(st.integers(-50, 50), unique=True), asked=st.lists(st.integers(-60, 60)))
def test_indexer(keys, asked):
    assert IntIndexer(keys).get_indexer(np.array(asked, np.int64)).tolist() == [keys.index(a) if a in keys else -1 for a in asked]


def test_indexer_refuses_copies():
    with pytest.raises(ValueError):
        IntIndexer([1, 1])


def test_strides():
    assert list(strides(slice(1, 7), 10, 3)) == [slice(1, 3), slice(4, 6), slice(7, 7)]
    assert list(strides(None, 4, 3)) == [slice(0, 2), slice(3, 3)]
    assert list(strides([5, 1, 2], 10, 2)) == [[5, 1], [2]]
    assert rows_per_block(10, 0) == 32768 and rows_per_block(1000, 10) >= 1024


def test_dense_box_and_blocks(spark):
    x = spark.createDataFrame([(0, 1, 5), (2, 0, 7), (3, 3, 1)], "soma_dim_0 bigint, soma_dim_1 bigint, soma_data int")
    box = core.dense_box(x, ["soma_dim_0", "soma_dim_1"], [(0, 2), (0, 1)], "soma_data")
    assert sorted(map(tuple, box.collect())) == [(0, 0, 0), (0, 1, 5), (1, 0, 0), (1, 1, 0), (2, 0, 7), (2, 1, 0)]
    got = over_blocks(x, "soma_dim_0", 2, lambda t: pa.table({"block": t["block"].slice(0, 1), "n": pa.array([t.num_rows])}), "block bigint, n bigint")
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 2)]
    ptr = core.row_pointers(x, "soma_dim_0", 1)
    assert sorted(map(tuple, ptr.collect())) == [(0, 1, 0, 1), (2, 1, 1, 2), (3, 1, 2, 3)]
    assert dense_rows(pa.table({"soma_dim_0": [9, 4], "soma_dim_1": [1, 0], "soma_data": [1.0, 2.0]}), np.array([4, 9]), 2).tolist() == [[2, 0], [0, 1]]


def test_sums_padding_and_forms():
    from matrella.operators.assemble import Compressed, added, padded, represented

    a = Compressed.from_ijd([0, 1], [1, 0], np.array([1.0, 2.0]), (2, 2))
    b = Compressed.from_ijd([0, 1], [1, 1], np.array([5.0, 7.0]), (2, 2), "csc")
    assert added([a, b]).to_numpy().tolist() == [[0, 6], [2, 7]] and added([a]).to_numpy().tolist() == a.to_numpy().tolist()
    assert padded(a, (3, 4)).to_numpy().tolist() == [[0, 1, 0, 0], [2, 0, 0, 0], [0, 0, 0, 0]]
    for bad in (lambda: padded(a, (1, 2)), lambda: added([a, padded(a, (3, 3))])):
        with pytest.raises(ValueError):
            bad()
    t = pa.table({"soma_dim_0": [1, 0], "soma_dim_1": [0, 1], "soma_data": [2.0, 1.0]})
    assert [x.tolist() for x in represented(t, (2, 2))] == [[0, 1], [1, 0], [1.0, 2.0]]
    assert represented(t, (2, 2), "R").kind == "csr" and represented(t, (2, 2), "C").kind == "csc"


def test_new_labels_follow_their_first_place(spark):
    known = spark.createDataFrame([("b", 7)], "label string, soma_joinid bigint")
    inc = spark.createDataFrame([("z", 0, 4), ("a", 0, 9), ("z", 0, 1), ("b", 0, 0), (None, 0, 0), ("c", 1, 0)], "label string, input int, pos bigint")
    assert sorted(map(tuple, core.number_new(known, inc, "label", place=["input", "pos"]).collect())) == [("a", 9, True), ("b", 7, False), ("c", 10, True), ("z", 8, True)]


def test_rows_in_sequence(spark):
    """Places follow the order of the rows over all partitions, empty ones among them."""
    parts = spark.range(0, 100, 1, 3).union(spark.range(0, 9, 1, 2).where("id < 0")).union(spark.range(100, 130, 1, 4)).withColumnRenamed("id", "k")
    assert sorted(map(tuple, core.in_sequence(parts, "nth", 3).collect())) == [(k, k + 3) for k in range(130)]
    df = spark.range(0, 5000, 1, 7).selectExpr("id * 37 % 5000 AS k")
    for places in (4, 9):
        ordered = df.repartitionByRange(places, "k").sortWithinPartitions("k")
        assert sorted(map(tuple, core.in_sequence(ordered, "nth").collect())) == [(k, k) for k in range(5000)]
    assert sorted(map(tuple, core.in_sequence(core.in_order(df, ["k"], "row-major"), "nth").collect())) == [(k, k) for k in range(5000)]
    assert core.in_sequence(df.where("k < 0"), "nth").collect() == []
