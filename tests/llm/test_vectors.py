from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from matrella.llm import clusters, graph, neighbours, queries, vectors

T = lambda d: datetime(2024, 1, d)


def frame(spark, ids, rows):
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "vec": vectors.pack(np.asarray(rows, np.float32))}))


def cosine(rows):
    u = vectors.unit(np.asarray(rows, np.float32))
    return np.round(u @ u.T, 6)


def brute_nearest(ids, rows, k, least):
    ids, s = np.asarray(ids), cosine(rows)
    np.fill_diagonal(s, -2)
    out = set()
    for r in range(len(ids)):
        order = np.lexsort((ids, -s[r]))[:k]
        out |= {(int(ids[r]), int(ids[c])) for c in order if s[r, c] >= least}
    return out


def brute_groups(ids, rows, least):
    hit = cosine(rows) >= least
    label = np.arange(len(ids))
    while True:
        new = np.array([label[hit[k]].min() for k in range(len(ids))])
        if np.array_equal(new, label):
            break
        label = new
    out = set()
    for k in np.unique(label):
        m = [int(ids[x]) for x in np.flatnonzero(label == k)]
        out |= {(min(m), x) for x in m} if len(m) > 1 else set()
    return out


def clustered(rng, n, dims=16, centres=12, noise=0.12):
    c = rng.standard_normal((centres, dims))
    return (c[rng.integers(centres, size=n)] + noise * rng.standard_normal((n, dims))) * rng.uniform(0.1, 9, (n, 1))


def test_latest_vectors(spark):
    parts = [(1, 0, 1.0, T(1)), (1, 0, 1.0, T(1)), (1, 0, 5.0, T(2)), (1, 2, 3.0, T(1)), (2, 0, 0.0, T(1)), (None, 0, 9.0, T(1)), (3, 1, float("nan"), T(1)), (3, 2, -0.0, T(1)), (4, 1, 2.0, None), (4, None, 2.0, T(1)), (5, 7, 1.0, T(1)), (6, 1, 4.0, T(3)), (6, 1, None, T(4))]
    df = spark.createDataFrame(parts, "soma_dim_0 bigint, soma_dim_1 bigint, soma_data double, written_at timestamp_ntz")
    got = vectors.latest_vectors(df, "soma_dim_0", "soma_dim_1", "soma_data", "written_at", 3)
    rows = {r.id: np.frombuffer(bytes(r.vec), "<f4").tolist() for r in got.collect()}
    assert rows == {1: [5, 0, 3], 4: [0, 2, 0]}
    assert vectors.latest_vectors(df.limit(0), "soma_dim_0", "soma_dim_1", "soma_data", "written_at", 3).count() == 0


def test_pack_round_trip():
    rows = np.random.default_rng(0).standard_normal((9, 5)).astype("f4")
    col = vectors.pack(rows)
    assert np.array_equal(vectors.unpack(col, 5), rows) and np.array_equal(vectors.unpack(col.slice(3, 4), 5), rows[3:7])


def test_hadamard_is_a_rotation():
    rows = np.random.default_rng(1).standard_normal((7, 16))
    turned = neighbours.hadamard(rows)
    assert np.allclose(turned @ turned.T, rows @ rows.T)
    axes = neighbours.nearest_axes(vectors.unit(rows), 0, 3)
    assert axes.shape == (7, 3) and all(len(set((a // 2).tolist())) == 3 for a in axes)
    assert not np.array_equal(axes, neighbours.nearest_axes(vectors.unit(rows), 1, 3))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 600)
    rows = np.vstack([rows, rows[:40], rows[:40] * 3, np.repeat(rows[:1], 30, 0)])
    ids = rng.permutation(len(rows)) * 7
    got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, ids, rows), 16).collect()}
    want = brute_nearest(ids, rows, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, ids = 1 + 0.05 * rng.standard_normal((300, 8)), np.arange(300)
    monkeypatch.setattr(vectors, "CHUNK", 50)
    monkeypatch.setattr(vectors.in_blocks, "__defaults__", (50,))
    got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, ids, rows), 8).collect()}
    want = brute_nearest(ids, rows, 5, 0.9)
    assert len(got & want) >= 0.99 * len(want)
    assert {tuple(r) for r in clusters.linked_groups(frame(spark, ids, rows), 8).collect()} == {(0, k) for k in range(300)}


def test_copies_have_their_smallest_fellows(spark):
    ids, rows = list(range(20)), [[1.0, 0, 0, 0]] * 20
    got = {}
    for r in neighbours.nearest(frame(spark, ids, rows), 4).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got[19] == {0, 1, 2, 3, 4} and got[0] == {1, 2, 3, 4, 5} and got[3] == {0, 1, 2, 4, 5}


@pytest.mark.parametrize("n", [50, 4500])
def test_near_ties_go_to_the_smallest_ids(spark, n):
    """Vectors of one direction but different length have distinct bytes and one rounded cosine."""
    rng = np.random.default_rng(10)
    rows, ids = rng.standard_normal(16) * rng.uniform(0.1, 9, (n, 1)), rng.permutation(n)
    got = {}
    for r in neighbours.nearest(frame(spark, ids, rows), 16).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got == {k: set([x for x in range(6) if x != k][:5]) for k in range(n)}


def test_nothing_to_compare(spark):
    empty = frame(spark, [], np.zeros((0, 4)))
    assert neighbours.nearest(empty, 4).count() == 0 and clusters.linked_groups(empty, 4).count() == 0 and clusters.describe(empty, 4).count() == 0
    one = frame(spark, [7], [[1, 2, 3, 4]])
    assert neighbours.nearest(one, 4).count() == 0 and clusters.linked_groups(one, 4).count() == 0


@pytest.mark.parametrize(("noise", "most"), [(0.1, 4096), (0.22, 4096), (0.22, 5)])
def test_groups_are_exact(spark, monkeypatch, noise, most):
    """Also where the leaves that are kept can't hold most vectors."""
    monkeypatch.setattr(clusters, "MAX_LEAVES", most)
    rng = np.random.default_rng(4)
    rows = np.vstack([clustered(rng, 500, noise=noise), rng.standard_normal((60, 16))])
    rows = np.vstack([rows, rows[:20]])
    ids = rng.permutation(len(rows)) + 100
    got = {(r.cluster_key, r.id) for r in clusters.linked_groups(frame(spark, ids, rows), 16).collect()}
    assert got == brute_groups(ids, rows, 0.9)


def test_chains_are_followed(spark):
    angles = np.arange(0, 2.4, 0.3)  # neighbours are linked, the ends are opposite
    rows = np.stack([np.cos(angles), np.sin(angles)], 1)
    got = clusters.linked_groups(frame(spark, range(10, 10 + len(rows)), rows), 2)
    assert {tuple(r) for r in got.collect()} == {(10, 10 + k) for k in range(len(rows))}


def test_features_add_up():
    rng = np.random.default_rng(5)
    rows = vectors.unit(clustered(rng, 400, noise=0.05))
    whole = clusters.CFTree(16, 0.22)
    whole.add(rows, np.ones(400, np.int64), rows)
    assert whole.n.sum() == 400 and np.allclose(whole.total.sum(0), rows.sum(0)) and np.allclose(whole.branch_total.sum(0), rows.sum(0))
    label = clusters.ward(vectors.unit(whole.total), whole.n, whole.total, 0.9)
    assert len(np.unique(label)) <= 14


def test_described_clusters(spark):
    rng = np.random.default_rng(6)
    base = np.eye(8)[:3]
    rows = np.vstack([base[k] + 0.03 * rng.standard_normal((n, 8)) for k, n in enumerate((30, 20, 10))] + [base[:1]])
    got = clusters.describe(frame(spark, range(61), np.vstack([rows[:60], rows[:1]])), 8).collect()
    assert sorted({(r.cluster, r.size) for r in got}, key=lambda x: -x[1]) and sorted({r.size for r in got}) == [10, 20, 31]
    assert all(r.nearness > 0.98 and r.nth <= 3 for r in got) and len(got) == 9


@pytest.mark.parametrize("most", [0, 2, 4096])
def test_described_clusters_hold_every_vector(spark, monkeypatch, most):
    """Groups of four cells, and cells unlike all others, are found however few leaves are kept."""
    monkeypatch.setattr(clusters, "MAX_LEAVES", most)
    rng = np.random.default_rng(8)
    base = np.eye(32)
    rows = np.vstack([np.repeat(base[:12], 4, 0) + 0.01 * rng.standard_normal((48, 32)), base[12:20], base[12:13]])
    got = clusters.describe(frame(spark, range(57), rows), 32).collect()
    assert sum(r.size for r in got if r.nth == 1) == 57
    assert sorted(r.size for r in got if r.nth == 1) == [1] * 7 + [2] + [4] * 12
    assert all({r.id // 4 for r in got if r.cluster == c} == {c} for c in range(12))


def test_ward_by_components_is_ward(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MAX_LEAVES", 0)
    rng = np.random.default_rng(9)
    rows = np.vstack([clustered(rng, 300, noise=0.25), rng.standard_normal((30, 16))])
    u = vectors.unit(np.asarray(rows, np.float32))
    label = clusters.ward(u, np.ones(330, np.int64), u, 0.9)
    want = {frozenset(np.flatnonzero(label == k).tolist()) for k in np.unique(label)}
    found = {}
    for r in clusters.describe(frame(spark, range(330), rows), 16, typical=330).collect():
        found.setdefault(r.cluster, set()).add(r.id)
    assert len(want) > 30 and max(map(len, want)) > 5 and {frozenset(x) for x in found.values()} == want


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500 + k, 501 + k) for k in range(40)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in x:
                want[n] = x
    assert got == {n: min(s) for n, s in want.items()}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_registered_queries(spark, sf):
    v = {r.id: np.frombuffer(bytes(r.vec), "<f4") for r in queries._vectors(spark, sf).collect()}
    ids, rows = list(v), np.array(list(v.values()))
    pairs = {tuple(sorted(p)) for p in brute_nearest(ids, rows, 5, 0.9)}
    assert {tuple(r) for r in queries.p2_found(spark, sf).collect()} == pairs
    assert {tuple(r) for r in queries.p5_found(spark, sf).collect()} == brute_groups(np.array(ids), rows, 0.9)
    assert queries.p5_clusters(spark, sf).count() > 0


def test_more_sets_of_leaves_where_the_first_is_full(spark, monkeypatch):
    """Vectors outside a full set of leaves get leaves of their own, set after set; the groups stay exact."""
    monkeypatch.setattr(clusters, "MAX_LEAVES", 5)
    monkeypatch.setattr(clusters, "LOOSE", 10)
    rng = np.random.default_rng(14)
    rows = np.vstack([clustered(rng, 400, centres=30), rng.standard_normal((40, 16))])
    v = frame(spark, range(440), rows)
    centres, cluster = clusters.warded_leaves(vectors.distinct_vectors(v), 16, 0.22, 0.9)
    assert len(centres) == len(cluster) > 20 and len(centres) <= 5 * clusters.ROUNDS
    assert {(r.cluster_key, r.id) for r in clusters.linked_groups(v, 16).collect()} == brute_groups(np.arange(440), rows, 0.9)


def test_buckets_grow_with_the_collection(spark, monkeypatch):
    """Several hashes name a bucket of a large collection; own buckets come first, and recall holds."""
    assert [neighbours.hashes_for(n, 50) for n in (0, 500, 750_000, 10**8, 10**10)] == [1, 1, 1, 2, 3]
    rng = np.random.default_rng(15)
    rows = clustered(rng, 900, centres=40)
    u = vectors.unit(rows).astype(np.float32)
    two = neighbours.buckets(u, 0, 2, 4)
    assert two.shape == (900, 4) and all(len(set(r)) == 4 for r in two.tolist())
    assert np.array_equal(two[:, 0], neighbours.nearest_axes(u, 0, 1, 0)[:, 0] * 32 + neighbours.nearest_axes(u, 0, 1, 1)[:, 0])
    monkeypatch.setattr(neighbours, "hashes_for", lambda n, dims: 2)
    monkeypatch.setattr(neighbours, "SMALL", 4)
    got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, range(900), rows), 16).collect()}
    want = brute_nearest(range(900), rows, 5, 0.9)
    assert len(got & want) >= 0.95 * len(want)


def test_parts_of_a_vector_meet_across_tasks(spark, monkeypatch):
    """Components of one id in any number of parts, with late and repeated ones, in small slabs."""
    rng = np.random.default_rng(16)
    values, rows = {}, []
    for k in range(3000):
        i, j, t = int(rng.integers(3)), int(rng.integers(4)), int(rng.integers(1, 28))
        v = float(np.float32(rng.standard_normal()))
        rows.append((i, j, v, T(t)))
        values[i, j] = max(values.get((i, j), (0, -9.0)), (t, v))
    df = spark.createDataFrame(rows, "soma_dim_0 bigint, soma_dim_1 bigint, soma_data double, written_at timestamp_ntz").repartition(7)
    monkeypatch.setattr(vectors._parts, "__defaults__", (50,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r.id: np.frombuffer(bytes(r.vec), "<f4").tolist() for r in vectors.latest_vectors(df, "soma_dim_0", "soma_dim_1", "soma_data", "written_at", 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: [values[i, j][1] for j in range(4)] for i in range(3)}
