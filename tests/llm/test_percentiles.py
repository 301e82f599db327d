from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matrella.llm import percentiles, queries
from matrella.llm.percentiles import Sketch, rank_of
from tests.oracle import connection, rows


def made(values, parts, section=8):
    whole = None
    for p in np.array_split(np.asarray(values, float), parts):
        s = Sketch(section)
        for q in np.array_split(p, 3):
            s.add(q)
        whole = s if whole is None else (whole.merge(s), whole)[1]
    return whole


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=900), parts=st.integers(1, 9), at=st.floats(-1e6, 1e6))
def test_ranks_lie_within_their_bounds(values, parts, at):
    s = made(values, parts)
    assert s.n == len(values) == sum(len(x) << h for h, x in enumerate(s.levels))
    for v in (at, values[0], max(values)):
        count, off = s.below(v)
        assert abs(count - sum(x < v for x in values)) <= off


def test_error_at_the_protected_tail():
    rng = np.random.default_rng(0)
    values = rng.lognormal(size=200_000)
    s = made(values, 32, 64)
    assert sum(map(len, s.levels)) < 12_000
    ordered = np.sort(values)
    for share, most in ((0.5, 0.01), (0.9, 0.01), (0.99, 0.02), (0.999, 0.02)):
        v = ordered[int(share * len(values))]
        assert abs(s.below(v)[0] - int((values < v).sum())) <= most * (1 - share) * len(values) + 1


def test_small_sketches_are_exact():
    s = made(range(300), 4, 64)
    assert [s.value_at(rank_of(p, 300)) for p in (1, 50, 90, 99, 100)] == [2, 149, 269, 296, 299]
    assert rank_of(50, 1) == 1 and rank_of(0, 5) == 1 and rank_of(90, 10) == 9


def test_order_of_merging_keeps_the_bound():
    rng = np.random.default_rng(1)
    values = rng.normal(size=5000)
    a, b = made(values[:2500], 5), made(values[2500:], 1)
    b.merge(a)
    count, off = b.below(0.3)
    assert b.n == 5000 and abs(count - (values < 0.3).sum()) <= off


def test_states_of_days_can_be_merged(spark):
    rng = np.random.default_rng(2)
    data = [(d % 2, float(v)) for d in range(6) for v in rng.normal(size=3000)] + [(0, None), (1, float("nan")), (None, 1.0)]
    df = spark.createDataFrame(data, "g int, v double").repartition(5)
    states = None
    for d in range(3):
        part = percentiles.merge(percentiles.sketches(df.where(F.pmod(F.hash("v"), F.lit(3)) == d), ["g"], F.col("v")))
        states = part if states is None else states.unionAll(part)
    got = {(json.loads(r.key)["g"], r.pct): r for r in percentiles.percentiles(states, (50, 99)).collect()}
    for g in (0, 1):
        mine = np.sort([v for k, v in data if k == g and v is not None and v == v])
        for pct in (50, 99):
            r = got[g, pct]
            true_low, true_high = np.searchsorted(mine, r.value) + 1, np.searchsorted(mine, r.value, side="right")
            assert r.n == len(mine) and r.low <= true_low and true_high <= r.high
            assert abs(true_low - rank_of(pct, len(mine))) <= 0.02 * len(mine)
    assert got[None, 50].value == 1.0


def test_no_values_no_sketch(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "g int, v double")
    assert percentiles.merge(percentiles.sketches(df, ["g"], F.col("v"))).count() == 0
    assert percentiles.percentiles(percentiles.sketches(df, ["g"], F.col("v")), (50,)).count() == 0


@pytest.mark.parametrize("section", [4, 64])
def test_found_equals_sql(spark, sf, monkeypatch, section):
    """Also where small sections make nearly every group doubtful, so that it is counted."""
    monkeypatch.setattr(Sketch.__init__, "__defaults__", (section,))
    got, want = queries.p4_found(spark, sf).toPandas(), connection(sf).execute(queries.SQL["p4_found"]).fetch_df()
    assert rows(got) == rows(want)


def test_undecided_groups_are_said(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(20_000)], "g int, v double").repartition(8)
    r = percentiles.against_limits(percentiles.sketches(df, ["g"], F.col("v")), lambda key: [(50, 100.0), (50, 9999.0), (50, 19_000.0)]).collect()
    assert [x.reaches for x in sorted(r, key=lambda x: x.limit_value)] == [True, None, False]
