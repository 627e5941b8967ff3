import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskspark.operators import ordered
from riskspark.operators.ordered import dense_codes, exact_quantile_rows, exact_quantiles, first_rows, running_totals


import pytest


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals_match_cumsum(spark, parts):
    rng = np.random.default_rng(3)
    keys = rng.permutation(500)
    vals = rng.integers(0, 10, 500)
    grp = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(int(g), int(k), int(v)) for g, k, v in zip(grp, keys, vals)], "g int, k int, v int")
    got = {(r.g, r.k): r.v_cum for r in running_totals(df, ["k"], ["v"], group_cols=["g"], num_partitions=parts).collect()}
    for g in range(3):
        idx = np.where(grp == g)[0]
        order = idx[np.argsort(keys[idx])]
        cum = np.cumsum(vals[order])
        for i, c in zip(order, cum):
            assert got[(g, int(keys[i]))] == c


def test_running_totals_descending(spark):
    df = spark.createDataFrame([(k, 1) for k in range(10)], "k int, one int")
    got = {r.k: r.one_cum for r in running_totals(df, ["k"], ["one"], descending=True, num_partitions=3).collect()}
    assert got == {k: 10 - k for k in range(10)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 2))),
                min_size=1, max_size=40))
def test_exact_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])["v"]
    clean = np.array([x for x in xs if x is not None], dtype=float)
    for p in (0.25, 0.5, 0.75):
        if len(clean):
            assert got[p] == np.percentile(clean, p * 100) or abs(got[p] - np.percentile(clean, p * 100)) < 1e-6
        else:
            assert got[p] != got[p]


def test_dense_codes(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", None]], "v string")
    for parts in (1, 2):
        assert sorted((r.v, r.code) for r in dense_codes(df, "v", num_partitions=parts).collect()) == [
            ("a", 0), ("b", 1), ("c", 2)]


def test_running_totals_many_groups_and_a_hot_group(spark):
    # 60 small groups plus one group holding a third of the rows, over 9 range partitions:
    # only boundary-crossing groups carry offsets; every cumulative sum must still be exact
    rng = np.random.default_rng(11)
    g = np.r_[rng.integers(1, 61, 2000), np.zeros(1000, dtype=int)]
    k = rng.permutation(len(g))
    v = rng.integers(0, 5, len(g))
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(g, k, v)], "g int, k int, v int")
    got = {(r.g, r.k): r.v_cum for r in running_totals(df, ["k"], ["v"], group_cols=["g"], num_partitions=9).collect()}
    for grp in np.unique(g):
        idx = np.where(g == grp)[0]
        order = idx[np.argsort(k[idx])]
        for i, c in zip(order, np.cumsum(v[order])):
            assert got[(int(grp), int(k[i]))] == c


@pytest.mark.parametrize("inside", [2_000_000, 300])
def test_quantiles_by_bracketing(spark, monkeypatch, inside):
    """Several columns at once, ties that fill a bracket, NaN, infinities, an empty column; narrowed brackets give the same."""
    monkeypatch.setattr(ordered, "INSIDE", inside)
    rng = np.random.default_rng(5)
    n = 20_000
    cols = {"u": rng.normal(0, 1e6, n), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 100, n)), "few": rng.integers(0, 3, n).astype(float),
            "odd": np.where(rng.random(n) < 0.01, np.inf, rng.exponential(1, n))}
    rows = [(*[float(cols[c][i]) for c in cols], None, float("nan") if i % 3 else 1.5 * i) for i in range(n)]
    df = spark.createDataFrame(rows, "u double, hot double, few double, odd double, none double, nans double").repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {(c, p): (q, m) for c, p, q, m in exact_quantile_rows(df, ["u", "hot", "few", "odd", "none", "nans"], probs)}
    cols["nans"] = np.array([1.5 * i for i in range(n) if i % 3 == 0])
    assert not any(c == "none" for c, _ in got) and len(got) == 5 * len(probs)
    for (c, p), (q, m) in got.items():
        want = np.inf if (c, p) == ("odd", 1.0) else np.percentile(cols[c], p * 100)
        assert m == len(cols[c]) and (q == want or abs(q - want) <= 1e-9 * abs(want)), (c, p, q, want)


def test_quantiles_recover_from_a_wrong_bracket(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_brackets", lambda df, cols, probs: ({"v": 9}, {("v", 0.5): [4, 4, 100.0, 200.0]}))
    assert exact_quantile_rows(spark.range(9).selectExpr("double(id) v"), ["v"], [0.5]) == [("v", 0.5, 4.0, 9)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k == 50 else f"k{k}", int(o) if o % 7 else None, int(i), f"t{i}") for i, (k, o) in enumerate(zip(np.r_[rng.integers(0, 51, 2000), np.zeros(1000, int)], rng.permutation(3000)))]
    rows += [("tied", 5, 1, "a"), ("tied", 5, 2, "b"), ("tied", 9, 3, "c"), ("tied", 9, 4, "d"), ("unordered", None, 1, "x"), ("unordered", None, 2, "y")]
    df = spark.createDataFrame(rows, "k string, o long, i long, t string").repartition(6)
    for last in (False, True):
        out = first_rows(df, "k", "o", last=last, tiebreak="i")
        got = {r.k: tuple(r) for r in out.collect()}
        assert len(got) == out.count() == len({r[0] for r in rows})
        for k, r in got.items():
            own = [x for x in rows if x[0] == k]
            sign = -1 if last else 1
            assert r == min(own, key=lambda x: (x[1] is None, sign * (x[1] or 0), -x[2]))
        assert "SortAggregate" not in plan(out)
    text = first_rows(df, "k", "t")  # orders that are no numbers
    assert {r.k: r.t for r in text.collect()} == {k: min(x[3] for x in rows if x[0] == k) for k in got}
