"""Operators against pandas itself on small fixtures (the reference's semantics are pandas')."""

import random

import numpy as np
import pandas as pd
import pytest

from riskkit.functions import rowwise as R
from riskkit.operators import rank as W


def _formula(r, n, q=5):
    return max(0, (q * (r - 1) + n - 2) // (n - 1) - 1)


@pytest.mark.parametrize("n", list(range(2, 120)) + [399, 1001, 5001])
def test_quantile_bin_formula_equals_qcut_on_ranks(n):
    ranks = pd.Series(np.arange(1, n + 1, dtype=float))
    want = pd.qcut(ranks, q=5, labels=False, duplicates="drop").tolist()
    assert [_formula(r, n) for r in range(1, n + 1)] == want


def test_quantile_bins_spark_equals_pandas(spark):
    rng = random.Random(7)
    vals = [rng.choice([None, *range(30)]) for _ in range(257)]
    pdf = pd.DataFrame({"id": range(len(vals)), "v": pd.array(vals, dtype="Float64")})
    ranks = pdf["v"].rank(method="first")
    want = pd.qcut(ranks, q=5, labels=False, duplicates="drop")
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)], "id long, v double")
    got = {r.id: r.bin for r in W.quantile_bins(df, "v", ["id"]).collect()}
    for i, w in enumerate(want):
        assert (got[i] is None and pd.isna(w)) or got[i] == int(w)


def test_equal_width_bins_equal_pd_cut(spark):
    rng = random.Random(11)
    vals = [round(rng.uniform(-50, 80), 2) for _ in range(300)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = {r.id: r.bin for r in W.equal_width_bins(df, "v").collect()}
    want = pd.cut(pd.Series(vals, dtype=float), bins=5, labels=False)
    for i, w in enumerate(want):
        assert (got[i] is None and pd.isna(w)) or got[i] == int(w)


def test_row_mean_and_sum_equal_pandas(spark):
    rng = random.Random(5)
    rows = [tuple(rng.choice([None, float(rng.randint(0, 200))]) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(R.row_mean(["a", "b", "c", "d"]).alias("m"), R.row_sum(["a", "b", "c", "d"]).alias("s")).collect()
    pdf = pd.DataFrame(rows, columns=list("abcd"), dtype=float)
    for g, m, s in zip(got, pdf.mean(axis=1), pdf.sum(axis=1)):
        assert (g.m is None and pd.isna(m)) or abs(g.m - m) < 1e-9
        assert abs(g.s - s) < 1e-9


def test_right_closed_bins_equal_pd_cut(spark):
    ages = [0.0, 0.5, 18.0, 18.01, 29.99, 30.0, 45.0, 60.0, 74.9, 75.0, 119.0, 120.0, 121.0, None]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    got = [r[0] for r in df.select(R.bins_right_closed("a", *R.AGE_BINS_A)).collect()]
    want = pd.cut(pd.Series(ages, dtype=float), bins=R.AGE_BINS_A[0], labels=R.AGE_BINS_A[1])
    assert got == [None if pd.isna(w) else str(w) for w in want]


def test_interpolated_matches_numpy():
    from riskkit.operators.prep import interpolated
    xs = [0.0, 1.0, 2.0, 2.0, 2.0, 5.0, 9.0]
    ys = [i / 6 for i in range(7)]
    pts = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.5, 5.0, 8.0, 9.0, 12.0, None]
    got = interpolated(np.array([np.nan if p is None else p for p in pts]), np.array(xs), np.array(ys))
    for p, g in zip(pts, got):
        if p is None:
            assert np.isnan(g)
        elif p == 2.0:
            assert abs(g - (ys[2] + ys[4]) / 2) < 1e-12  # flat run: midpoint of its references
        else:
            assert abs(g - np.interp(p, xs, ys)) < 1e-12
