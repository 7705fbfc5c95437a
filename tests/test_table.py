"""The table API: NULL rules, order, refusals."""

from __future__ import annotations

import pytest

from ambercol.table import NAMES, Table, app


@pytest.fixture(scope="module")
def c(spark):
    return app(spark).c


def table(spark, rows, schema, order_by=None):
    return Table(spark.createDataFrame(rows, schema), order_by)


def test_forty_four_names_are_there(spark):
    from ambercol import table as module
    from ambercol.expr import Expr
    from ambercol.sources import adapters

    assert sum(map(len, NAMES.values())) == 44
    for n in NAMES["expr"]:
        assert hasattr(Expr, n)
    for n in NAMES["chain"]:
        assert hasattr(module.Chain, n)
    for n in NAMES["app"]:
        assert hasattr(module.App, n)
    for n in NAMES["boundary"]:
        assert n == "app" or hasattr(adapters, n)
    assert app(spark).capabilities()["op_count"] == 33


def test_filter_keeps_true_rows_only_and_or_is_kleene(spark, c):
    t = table(spark, [(1, 10), (None, 20), (3, None)], "a int, b int")
    assert [tuple(r) for r in t.query().filter(c("a") != 1).compile().df.collect()] == [(3, None)]
    assert sorted(r.b or 0 for r in t.query().filter((c("a") == 1) | (c("b") == 20)).compile().df.collect()) == [10, 20]
    assert t.query().filter(~(c("a") == 1)).nrows() == 1
    assert t.query().filter(c("a").is_null()).nrows() == 1


def test_integer_sums_and_products_widen(spark, c):
    t = table(spark, [(2**31 - 1,)], "v int")
    assert t.query().derive("x", c("v") * c("v")).compile().df.first().x == (2**31 - 1) ** 2
    assert t.query().derive("x", c("v") * 0.5).compile().df.first().x == (2**31 - 1) * 0.5
    assert t.query().reduce("sum", "v") == 2**31 - 1


@pytest.mark.parametrize("a,b,floor,mod", [(-7, 3, -3, 2), (7, -3, -3, -2), (-7, -3, 2, -1), (7, 3, 2, 1), (6, -3, -2, 0)])
def test_floor_division_and_remainder_follow_python(spark, c, a, b, floor, mod):
    r = table(spark, [(a, b)], "a long, b long").query().derive("q", c("a") // c("b")).derive("m", c("a") % c("b")).compile().df.first()
    assert (r.q, r.m) == (floor, mod) == (a // b, a % b)


def test_nan_is_not_itself(spark, c):
    t = table(spark, [(float("nan"),), (1.0,)], "v double")
    assert t.query().filter(c("v") == c("v")).nrows() == 1
    assert t.query().filter(c("v") != c("v")).nrows() == 1
    assert t.query().filter(c("v") > 0.0).nrows() == 1


def test_division_by_zero_gives_infinities(spark, c):
    df = table(spark, [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0)], "a double, b double").query().derive("x", c("a") / c("b")).compile().df
    x = [r.x for r in df.collect()]
    assert x[:2] == [float("inf"), float("-inf")] and x[2] != x[2]


def test_sort_is_stable_with_nulls_last_both_ways(spark):
    t = table(spark, [(0, 2), (1, None), (2, 1), (3, 2), (4, None)], "p long, k int", "p")
    for desc, want in ((False, [2, 0, 3, 1, 4]), (True, [0, 3, 2, 1, 4])):
        assert [r.p for r in t.query().sort("k", desc=desc).compile().df.collect()] == want
    assert [r.p for r in t.query().sort("k").limit(2, offset=1).compile().df.collect()] == [0, 3]
    assert t.query().limit(3, offset=99).nrows() == 0


def test_null_keys_are_refused_kept_or_dropped(spark):
    t = table(spark, [("a", 1), (None, 2), ("b", None)], "k string, v int")
    with pytest.raises(ValueError, match="'k' holds 1 NULLs"):
        t.query().group("k", {"v": "sum"})
    assert t.query().group("k", {"v": ("sum", "count")}, null_keys="keep").nrows() == 3
    kept = {r.k: r["v.count"] for r in t.query().group("k", {"v": ("sum", "count")}, null_keys="drop").compile().df.collect()}
    assert kept == {"a": 1, "b": 0}
    assert t.query().group("k", {"v": "sum"}, "drop", drop_null_measures=True).nrows() == 1


def test_positions(spark, c):
    t = table(spark, [(i, v) for i, v in enumerate([1, None, 3, 4])], "p long, v int", "p")
    q = t.query().derive("s", c("v").cumsum()).derive("l", c("v").shift(1)).derive("x", c("v").cumsum().shift(2)).derive("r", c("v").rolling(2))
    rows = q.compile().df.orderBy("p").collect()
    assert [r.s for r in rows] == [1, None, 4, 8]
    assert [r.l for r in rows] == [None, 1, None, 3]
    assert [r.x for r in rows] == [None, None, 1, None]
    assert [r.r if r.r == r.r else None for r in rows] == [None, None, None, 7.0]
    assert t.query().filter(c("v") > c("v").shift(1)).nrows() == 1


@pytest.mark.parametrize(
    "step,match",
    [
        (lambda q, c: q.filter(c("v")), "compare it"), (lambda q, c: q.filter(c("s") < "b"), "no defined order"), (lambda q, c: q.derive("x", c("s") + 1), "string"), (lambda q, c: q.derive("v", c("v")), "there is a column"),
        (lambda q, c: q.filter(c("nope") > 1), "no column 'nope'"), (lambda q, c: q.derive("x", c("v").shift(-1)), "0 or more"), (lambda q, c: q.filter(c("s").isin([])), "non-empty"), (lambda q, c: q.limit(-1), "no count"),
        (lambda q, c: q.sort("v", desc=[True]), "True or False"), (lambda q, c: q.group("s", {"s": "sum"}), "text"), (lambda q, c: q.reduce("sum", "s"), "text"), (lambda q, c: q.derive("x", c("v").cumsum()), "no order"),
        (lambda q, c: q.filter(c("v").str_contains("a")), "text column"), (lambda q, c: bool(c("v") > 1), "truth value"), (lambda q, c: q.filter(c("s") == 3), "compared with"),
    ],
)
def test_refusals_name_the_fix(spark, c, step, match):
    with pytest.raises(ValueError, match=match) as e:
        step(table(spark, [(1, "a")], "v int, s string").query(), c)
    assert "Fix:" in str(e.value)


def test_jobs_and_explain_run_nothing(spark, c):
    q = table(spark, [(1, "a")], "v int, s string").query().filter(c("v") > 0).derive("x", c("v") + 1)
    assert [j["op"] for j in q.jobs()] == ["filter", "derive"]
    assert "Physical Plan" in q.explain()


def test_filters_and_columns_reach_the_scan(spark, c):
    q = Table(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).query().filter(c("l_orderkey") > 10).select("l_orderkey", "l_tax")
    plan = q.explain()
    assert "GreaterThan(l_orderkey,10)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan


def test_sort_flags_positions_and_permutation(spark):
    rows = [(0, 2, "b"), (1, None, "a"), (2, 1, "b"), (3, 2, "a"), (4, 1, None)]
    q = Table(spark.createDataFrame(rows, "p long, n int, s string"), "p").query()
    got = q.sort("n", "s", flags=[True, False], position="was").positions("at").compile().df.collect()
    assert [r.was for r in sorted(got, key=lambda r: r["at"])] == [3, 0, 2, 4, 1]
    first = q.sort("n", nulls_first=True).positions("at").compile().df.collect()
    assert [r.p for r in sorted(first, key=lambda r: r["at"])] == [1, 2, 4, 0, 3]
    with pytest.raises(ValueError, match="one for each"):
        q.sort("n", "s", flags=[True])
    with pytest.raises(ValueError, match="there is a column"):
        q.sort("n").positions("s")
