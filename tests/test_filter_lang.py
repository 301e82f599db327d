from __future__ import annotations

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matrella.errors import FilterError
from matrella.functions.filter_lang import columns_of, compile_filter, parse, parse_r

ROWS = [(k, None if k % 5 == 0 else k * 1.5, float("nan") if k % 7 == 3 else k / 2, "abc"[k % 3] if k % 4 else None, k % 2 == 0) for k in range(12)]
NAMES = ["i", "maybe", "real", "text", "flag"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "i int, maybe double, real double, text string, flag boolean")


def pick(frame, text, syntax="python"):
    cond, _ = compile_filter(text, frame.schema, syntax)
    return sorted(r.i for r in frame.where(cond).select("i").collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("i > 8", [9, 10, 11]),
        ("3 <= i < 6", [3, 4, 5]),
        ("10 <= i", [10, 11]),
        ("i in [1, 3, 99]", [1, 3]),
        ("i not in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]", [10, 11]),
        ("not (i > 2 or i == 1)", [0, 2]),
        ("(i == 1) | (i == 2) & (flag == True)", [1, 2]),
        ("text == None", [0, 4, 8]),
        ("text != None and i > 8", [9, 10, 11]),
        ("text != 'a'", [1, 2, 5, 7, 10, 11]),
        ("not text == 'a'", [1, 2, 5, 7, 10, 11]),
        ("maybe > 12", [9, 11]),
        ("real > 4", [9, 11]),
        ("real >= 0 and i < 4", [0, 1, 2]),
        ("not real < 4.5 and i > 8", [9, 11]),
        ("attr('i') == val(-(-4))", [4]),
        ("i == 1.5", []),
        ("i < 99999999999999", list(range(12))),
    ],
)
def test_python_spelling(frame, text, want):
    assert pick(frame, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("i > 8 && flag == TRUE", [10]), ("i %in% c(1, 2, 3)", [1, 2, 3]), ("!(i %nin% c(4L))", [4]), ("`text` == 'b' || i == 0", [0, 1, 7, 10]), ("text == NULL", [0, 4, 8])],
)
def test_r_spelling(frame, text, want):
    assert pick(frame, text, "r") == want


@pytest.mark.parametrize(
    "text",
    ["", "i >", "i is None", "a.b == 1", "i == maybe", "i + 1 == 2", "f(i) == 1", "i in []", "~(i == 1)", "unknown == 1", "i == 'x'", "text == 1", "text > None", "i", "3", "i in 3", "flag == 5", "attr(1) == 2", "val(1, 2) == i"],
)
def test_refused(frame, text):
    with pytest.raises(FilterError):
        compile_filter(text, frame.schema)


@pytest.mark.parametrize("text", ["i >> 1", "i %between% c(1, 2)", "i == c(1", "i"])
def test_r_refused(frame, text):
    with pytest.raises(FilterError):
        compile_filter(text, frame.schema, "r")


def test_columns_named_once():
    assert columns_of(parse("a > 1 and (b == 2 or a < 5)")) == ["a", "b"]
    assert columns_of(parse_r("`a b` > 1")) == ["a b"]


_leaf = st.one_of(
    st.tuples(st.just("i"), st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), st.integers(-2, 13)).map(lambda t: f"{t[0]} {t[1]} {t[2]}"),
    st.sampled_from(["text == 'a'", "text != 'b'", "text in ['a', 'c']"]),
)
_tree = st.recursive(_leaf, lambda x: st.one_of(st.tuples(x, x).map(lambda t: f"({t[0]}) and ({t[1]})"), st.tuples(x, x).map(lambda t: f"({t[0]}) or ({t[1]})")), max_leaves=5)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(text=_tree)
def test_agrees_with_pandas(frame, text):
    pdf = pd.DataFrame([r for r in ROWS if r[3] is not None], columns=NAMES)
    want = sorted(pdf.query(text).i.tolist())
    assert sorted(r.i for r in frame.where("text is not null").where(compile_filter(text, frame.schema)[0]).collect()) == want


def test_r_values_and_trees(spark):
    from matrella.functions.filter_lang import combine, compile_tree, in_or_not, triple

    df = spark.sql("select * from values (1, timestamp_ntz'2024-01-01 12:00:00'), (2, timestamp_ntz'2024-01-03 00:00:00') as t(n, at)")
    hit = lambda text: sorted(r.n for r in df.where(compile_filter(text, df.schema, "r")[0]).collect())
    assert hit("at > as.Date('2024-01-02')") == [2] and hit("at <= as.POSIXct('2024-01-01 12:00:00', 'UTC')") == [1]
    assert hit("n == bit64::as.integer64(2)") == [2] and hit("at == as.Date(19725)") == [2]
    for bad in ("at > as.Date('x')", "at > as.Date(n)"):
        with pytest.raises(FilterError):
            hit(bad)
    tree = combine(triple("n", 1, ">="), in_or_not("n", [2, 3], "%nin%"), "&&")
    assert [r.n for r in df.where(compile_tree(tree, df.schema)).collect()] == [1]
    assert [r.n for r in df.where(compile_tree(combine(tree, None, "!"), df.schema)).collect()] == [2]
    for bad in (lambda: triple("n", 1, "~"), lambda: combine(tree, None, "or"), lambda: in_or_not("n", [1], "=="), lambda: in_or_not("n", [])):
        with pytest.raises(FilterError):
            bad()
