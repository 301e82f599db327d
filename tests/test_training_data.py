"""References, drift and skew: registered queries are compared with SQL elsewhere; here brute force and edge cases."""

from __future__ import annotations

import collections
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from matrella.functions.labels import plain_integer
from matrella.operators import drift, eager_agg, orphans
from matrella.plans import training_data

REF = "k bigint, at timestamp_ntz, extra string"
T = lambda d, m=1: datetime(2024, m, d)


def found(spark, refs, parents, deletes, always=()):
    r = spark.createDataFrame([(*x, "e") for x in refs], REF)
    p = spark.createDataFrame(list(parents), "soma_joinid bigint, at timestamp_ntz")
    d = spark.createDataFrame(list(deletes), "soma_joinid bigint, at timestamp_ntz")
    a = spark.createDataFrame([(x,) for x in always], "soma_joinid bigint")
    got = orphans.orphans(orphans.references({"r": (r, "k", "at")}), p, d, a)
    return sorted((x.soma_joinid, x.period, x.reason) for x in got.collect()), got


def test_orphan_reasons(spark):
    refs = [(1, T(5)), (2, T(1)), (2, T(20)), (3, T(1)), (3, T(10)), (3, T(20)), (3, T(25)), (4, T(3)), (None, T(1)), (5, None), (6, T(4)), (9, T(4)), (9, T(4)), (9, T(4, 2))]
    parents = [(2, T(10)), (2, T(10)), (3, T(2)), (3, T(22)), (6, T(1)), (None, T(1))]
    deletes = [(3, T(9)), (3, T(12)), (3, T(9)), (4, T(1)), (None, T(2)), (6, T(4)), (6, None)]
    got, _ = found(spark, refs, parents, deletes, [1])
    assert got == [(2, "2024-01", "late"), (3, "2024-01", "deleted"), (3, "2024-01", "late"), (4, "2024-01", "missing"), (6, "2024-01", "deleted"), (9, "2024-01", "missing"), (9, "2024-02", "missing")]


def test_orphans_of_empty_tables(spark):
    assert found(spark, [], [(1, T(1))], [])[0] == []
    assert found(spark, [(1, T(1))], [], [])[0] == [(1, "2024-01", "missing")]
    assert found(spark, [(1, T(2))], [(1, None)], [])[0] == [(1, "2024-01", "late")]


def test_load_and_delete_at_once_is_a_load(spark):
    assert found(spark, [(1, T(3))], [(1, T(2))], [(1, T(2))])[0] == []


def test_filter_has_no_false_negatives_when_it_is_full(spark, monkeypatch):
    monkeypatch.setattr(orphans, "MAX_WORDS", 4)
    keys = spark.range(0, 4000, 2).withColumnRenamed("id", "k")
    f = orphans.key_filter(keys, "k")
    assert f.frame.count() <= 64
    assert f.split(spark.range(0, 4000, 2).withColumnRenamed("id", "k"), "k").where("not maybe_known").count() == 0


def test_filter_proves_most_orphans(spark):
    f = orphans.key_filter(spark.range(5000).withColumnRenamed("id", "k"), "k")
    odd = f.split(spark.range(10**6, 10**6 + 5000).withColumnRenamed("id", "k"), "k")
    assert odd.where("maybe_known").count() < 500


def test_hot_key_is_one_row_before_the_join(spark):
    plan = found(spark, [(1, T(1))] * 3, [(2, T(1))], [])[1]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


# --- drift -----------------------------------------------------------------------------------------------------------------------------

FILES = "stream_id string, file_id bigint, exported_at timestamp_ntz, received_at timestamp_ntz, line_no int, payload string"


def files(spark, *streams):
    rows, n = [], 0
    for s, fs in enumerate(streams):
        for k, lines in enumerate(fs):
            n += 1
            rows += [(f"s{s}", n, T(1 + k), T(28 - k), i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, FILES)


def changed(spark, *streams):
    return sorted((r.file_id, r.change_kind, r.old_field, r.new_field) for r in drift.changes(files(spark, *streams)).collect())


def lines(**fields):
    return [{"soma_joinid": k, **{n.replace("__", "/"): f(k) for n, f in fields.items()}} for k in range(6)]


def test_renames_need_five_equal_texts(spark):
    a, b = lines(x=lambda k: k), lines(y=lambda k: k)
    assert changed(spark, [a, b]) == [(2, "renamed", "x", "y")]
    assert changed(spark, [a[:4], b]) == [(2, "added", "y", "y"), (2, "removed", "x", "x")]
    assert changed(spark, [a, lines(y=lambda k: k if k else 99)]) == [(2, "added", "y", "y"), (2, "removed", "x", "x")]
    assert changed(spark, [a, lines(y=lambda k: str(k))]) == [(2, "renamed", "x", "y"), (2, "retyped", "y", "y")]
    assert changed(spark, [a, lines(X=lambda k: k)]) == [(2, "renamed", "x", "X")]
    assert changed(spark, [a, [{"soma_joinid": k, "o": {"x": k}} for k in range(6)]]) == [(2, "renamed", "x", "o/x")]


def test_numbers_are_compared_as_written(spark):
    a, b = ['{"soma_joinid": %d, "x": %d.0}' % (k, k) for k in range(6)], ['{"soma_joinid": %d, "y": %d}' % (k, k) for k in range(6)]
    assert changed(spark, [a, b]) == [(2, "added", "y", "y"), (2, "removed", "x", "x")]
    c = ['{"soma_joinid": %d, "x": 1e%d}' % (k, k) for k in range(6)]
    assert changed(spark, [a, c]) == []
    assert changed(spark, [a, ['{"soma_joinid": %d, "x": %d}' % (k, k) for k in range(6)]]) == [(2, "retyped", "x", "x")]


def test_nulls_keep_the_type(spark):
    i, n, s = lines(x=lambda k: k), lines(x=lambda k: None), lines(x=lambda k: str(k))
    assert changed(spark, [i, n, i]) == []
    assert changed(spark, [i, n, s]) == [(3, "retyped", "x", "x")]
    assert changed(spark, [n, i]) == []


def test_dirty_lines_and_order(spark):
    dirt = ["", None, '{"soma_joinid": 1, "z"', "[1]", "NaN", '{"soma_joinid": 1, "bad": NaN}']
    assert changed(spark, [[*lines(x=lambda k: k), *dirt], [*dirt, *lines(x=lambda k: k)] * 2]) == []
    assert changed(spark, [dirt, lines(x=lambda k: k)]) == [(2, "added", "x", "x")]
    assert changed(spark, [lines(x=lambda k: k)]) == []
    assert drift.changes(files(spark, []).limit(0)).count() == 0


def brute(df):
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    when = {}
    for r in df.collect():
        when[r.stream_id, r.file_id] = r.exported_at
        got = by[r.stream_id, r.file_id]
        if (obj := drift.parse_line(r.payload)) is not None:
            joinid = obj.pop("soma_joinid", None)
            for n, v in drift.flat_fields(obj):
                got[n].append((joinid, *drift.kind_and_text(v)))
    out = set()
    for stream in {s for s, _ in when}:
        known, before = {}, None
        for f in sorted((f for s, f in when if s == stream), key=lambda f: (when[stream, f], f)):
            now, old = by[stream, f], dict(known)
            for n, vs in now.items():
                if kinds := {k for _, k, _ in vs if k}:
                    known[n] = max(kinds, key=drift.WIDTH.get)
            if before is not None:
                gone, new = set(before) - set(now), set(now) - set(before)
                pairs = set()
                for g in gone:
                    for n in new:
                        a, b = ({j: t for j, _, t in x if t is not None and j is not None} for x in (before[g], now[n]))
                        both = set(a) & set(b)
                        if len(both) >= 5 and all(a[j] == b[j] for j in both):
                            pairs.add((g, n))
                out |= {(f, "renamed", g, n) for g, n in pairs} | {(f, "retyped", n, n) for g, n in pairs if old[g] != known[n]}
                out |= {(f, "removed", g, g) for g in gone - {g for g, _ in pairs}} | {(f, "added", n, n) for n in new - {n for _, n in pairs}}
                out |= {(f, "retyped", n, n) for n in set(now) & set(before) if old.get(n) and known.get(n) and old[n] != known[n]}
            before = now
    return out


def test_changes_against_brute_force(spark, sf):
    got = {tuple(r) for r in training_data.p3_found(spark, sf).collect()}
    assert got and got == brute(spark.read.parquet(f"{sf}/obs_files.parquet"))


TARGET = {"x": "int", "name": "string"}


def test_rescue_and_replay(spark):
    f = files(spark, [[{"soma_joinid": 1, "x": "3.0", "other": {"a": 1}}, {"soma_joinid": 2, "x": "many"}, {"soma_joinid": 3, "X_old": 4, "name": None}, "cut {"]])
    t = drift.ingest(f, TARGET)
    rows = {r.soma_joinid: r for r in t.collect()}
    assert len(rows) == 3 and rows[1].x == 3 and json.loads(rows[1]._rescued) == {"other/a": "1"}
    assert rows[2].x is None and json.loads(rows[2]._rescued) == {"x": "many"} and json.loads(rows[3]._rescued) == {"X_old": "4"}
    rows = {r.soma_joinid: r for r in drift.replay(t, TARGET, {"X_old": "x", "other/a": "name"}).collect()}
    assert rows[3].x == 4 and rows[3]._rescued is None and rows[1].name == "1" and json.loads(rows[2]._rescued) == {"x": "many"}


def test_promotions(spark):
    f = drift.changes(files(spark, [lines(x=lambda k: k), lines(y=lambda k: k), lines(z=lambda k: k)], [lines(p=lambda k: k), lines(q=lambda k: k)]))
    assert drift.promotions(f, TARGET) == {"x": "x", "y": "x", "z": "x"}


def test_a_chance_rename_undoes_no_promotion(spark):
    edges = [(k, "renamed", "x", "X_drift") for k in range(3)] + [(k + 10, "renamed", "label", "name") for k in range(2)] + [(20, "renamed", "X_drift", "label"), (21, "removed", "label", "label")]
    found = spark.createDataFrame(edges, "file_id bigint, change_kind string, old_field string, new_field string")
    with pytest.warns(UserWarning, match="X_drift, label, name, x"):
        assert drift.promotions(found, TARGET) == {"x": "x", "X_drift": "x", "label": "name", "name": "name"}
    even = spark.createDataFrame([(1, "renamed", "x", "y"), (2, "renamed", "y", "name")], found.schema)
    with pytest.warns(UserWarning):
        assert drift.promotions(even, TARGET) == {"x": "x", "name": "name"}


def test_spellings_without_case_need_no_rename(spark):
    f = files(spark, [[{"soma_joinid": 1, "X": "3.0"}, {"soma_joinid": 2, "x": "many", "X": 5}, {"soma_joinid": 3, "inner": {"NAME": "n"}}, {"soma_joinid": 4, "x": 1, "X": 2}]])
    rows = {r.soma_joinid: r for r in drift.ingest(f, TARGET).collect()}
    assert rows[1].x == 3 and rows[1]._rescued is None and rows[3].name == "n" and rows[3]._rescued is None
    assert rows[2].x == 5 and json.loads(rows[2]._rescued) == {"x": "many"} and rows[4].x == 1 and json.loads(rows[4]._rescued) == {"X": "2"}


def test_no_value_is_lost_between_lines_and_table(spark, sf):
    """Every non-null field of every valid line is in a typed column or still rescued."""
    t = training_data.p3_table(spark, sf)
    assert t.count() == sum(drift.parse_line(r.payload) is not None for r in spark.read.parquet(f"{sf}/obs_files.parquet").collect())
    assert t.where("obs_id is not null").count() > 0.7 * t.count()


# --- skew ------------------------------------------------------------------------------------------------------------------------------


def test_states_equal_the_plain_join(spark):
    facts = spark.createDataFrame([(1, 2.0, "g"), (1, float("nan"), "g"), (1, None, "g"), (2, 5.0, "g"), (3, 7.0, "g"), (None, 1.0, "g")], "k int, v double, n string")
    dims = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (9, "c"), (None, "a")], "k int, g string")
    groups = dims.groupBy(F.col("k").alias("key"), F.col("g").alias("group_key")).agg(F.count(F.lit(1)).alias("n_dim"))
    got = eager_agg.with_mean(eager_agg.join_states(eager_agg.fact_states(facts, F.col("k"), F.col("v")), groups))
    plain = facts.join(dims, "k").groupBy("g").agg(F.count(F.lit(1)), F.count_if(F.col("v").isNotNull() & ~F.isnan("v")), F.sum(F.when(~F.isnan("v"), F.col("v"))))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(map(tuple, plain.collect()))
    assert eager_agg.fact_states(facts.limit(0), F.col("k"), F.col("v")).count() == 0


def test_heavy_keys_count_nulls_in_the_total(spark):
    df = spark.createDataFrame([(1,)] * 4 + [(2,)] * 2 + [(None,)] * 4, "k int")
    s = eager_agg.fact_states(df, F.col("k"), F.col("k"))
    assert sorted(r.key for r in eager_agg.heavy_keys(s, 0.2).collect()) == [1, 2]
    assert [r.key for r in eager_agg.heavy_keys(s, 0.21).collect()] == [1]


def test_facts_combine_before_the_shuffle(spark, sf):
    s = eager_agg.fact_states(spark.read.parquet(f"{sf}/x_rna.parquet"), F.col("soma_dim_0"), F.col("soma_data"))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "partial_count" in plan


@pytest.mark.parametrize("label", ["7", " 7 ", "07", "7.0"])
def test_labels_are_one(spark, label):
    assert spark.createDataFrame([(label,)], "s string").select(plain_integer(F.col("s"))).first()[0] == 7


def test_roll_ups_of_joined_states(spark):
    """Keys of one side only, null keys and several groups a key: per key, per group and per joined group."""
    facts = spark.createDataFrame([(1, 2.0)] * 3 + [(2, 5.0), (3, 7.0), (None, 1.0), (None, 4.0)], "k int, v double")
    dims = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (9, "c"), (None, "a")], "k int, g string")
    groups = dims.groupBy(F.col("k").alias("key"), F.col("g").alias("group_key")).agg(F.count(F.lit(1)).alias("n_dim"))
    joined = eager_agg.join_inputs(eager_agg.fact_states(facts, F.col("k"), F.col("v")), groups)
    assert {(r.key, r.n_rows, r.sum_values) for r in eager_agg.per_key(joined).collect()} == {(1, 3, 6.0), (2, 1, 5.0), (3, 1, 7.0), (None, 2, 5.0)}
    assert {tuple(r) for r in eager_agg.per_group(joined).collect()} == {("a", 3), ("b", 1), (None, 1), ("c", 1)}
    assert {tuple(r) for r in eager_agg.per_joined_group(joined).collect()} == {("a", 6, 6, 12.0), ("b", 3, 3, 6.0)}
    assert [r.key for r in eager_agg.heavy_keys(eager_agg.per_key(joined), 3 / 7).collect()] == [1]
    empty = eager_agg.join_inputs(eager_agg.fact_states(facts.limit(0), F.col("k"), F.col("v")), groups.limit(0))
    assert eager_agg.heavy_keys(eager_agg.per_key(empty), 0.5).count() == 0 and eager_agg.per_group(empty).count() == 0


def test_table_against_brute_force(spark, sf):
    """Each line's typed fields and rescued texts, by its own names, spellings, and then promoted names in their order."""
    target = training_data.TARGET
    raw = spark.read.parquet(f"{sf}/obs_files.parquet")
    promoted = drift.promotions(drift.changes(raw), target)
    want = []
    for r in raw.collect():
        if (obj := drift.parse_line(r.payload)) is None:
            continue
        joinid = obj.pop("soma_joinid", None)
        left = {n: t for n, v in drift.flat_fields(obj) if (t := drift.kind_and_text(v)[1]) is not None}
        row = {}
        for names in (lambda f: sorted((n for n in left if n.rsplit("/", 1)[-1].lower() == f), key=lambda n: (n != f, n)), lambda f: sorted(n for n in left if promoted.get(n) == f)):
            for f, kind in target.items():
                tried = {n: v for n in names(f) if (v := drift.CASTS[kind](left[n])) is not None}
                if row.get(f) is None:
                    row[f] = next(iter(tried.values()), None)
                for n, v in tried.items():
                    if v == row[f]:
                        del left[n]
        want.append((r.file_id, r.line_no, int(joinid) if joinid is not None else None, *row.values(), json.dumps(left, sort_keys=True) if left else None))
    got = [(*list(r)[:-1], json.dumps(json.loads(r[-1]), sort_keys=True) if r[-1] else None) for r in training_data.p3_table(spark, sf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[-1] is None for r in got) > 100


def test_the_rescue_table_keeps_lines_as_they_were(spark):
    """One parse: changes and the table come from the same written lines; what is typed keeps its text for the comparison."""
    f = files(spark, [[*lines(x=lambda k: f"{k}.0"), "cut {"], lines(X_new=lambda k: k), ["", None]])
    t = drift.rescued_lines(f, TARGET)
    assert t.count() == 15 and drift.table_of(t).count() == 12
    assert sorted((r.file_id, r.change_kind, r.old_field, r.new_field) for r in drift.changes_in(t).collect()) == [(2, "added", "X_new", "X_new"), (2, "removed", "x", "x"), (3, "removed", "X_new", "X_new")]
    first = t.where("file_id = 1 and soma_joinid = 3").first()
    assert first.x == 3 and first._rescued is None and first.texts == ["3.0"] and first.widths == [5]
    with pytest.raises(ValueError):
        drift.rescued_lines(f, {"x": "date"})


def test_large_filters_are_joined_by_word(spark, monkeypatch):
    """More keys than a broadcast filter holds: the filter grows, is not broadcast, and still proves most orphans."""
    monkeypatch.setattr(orphans, "BROADCAST_WORDS", 64)
    f = orphans.key_filter(spark.range(5000).withColumnRenamed("id", "k"), "k")
    assert f.words > 64
    odd = f.split(spark.range(10**6, 10**6 + 5000).withColumnRenamed("id", "k"), "k")
    assert odd.where("maybe_known").count() < 500
    assert f.split(spark.range(5000).withColumnRenamed("id", "k"), "k").where("not maybe_known").count() == 0
    assert orphans.key_filter(spark.range(5000).withColumnRenamed("id", "k"), "k", 64).words == 64


def test_references_are_reduced_before_anything_else(spark, sf):
    """What is returned starts from the written reduction: no table of references is read again for it."""
    plan = training_data.p1_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and not any(t in plan for t in ("x_rna", "obsm_pca", "obs_presence"))
