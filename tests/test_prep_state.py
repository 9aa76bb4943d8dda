"""Chained imputation against the row-wise loop; medians; bounded distinct counts; saved tables; one-hot of many levels."""

import math
import shutil

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskkit.operators import prep as P
from riskkit.operators import profile as A
from riskkit.operators.split import feature_routing


def _gappy(n=400, p=4, seed=0):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 2))
    x = np.stack([z[:, 0], z[:, 0] + 0.5 * z[:, 1], 3 * z[:, 1] + 10, r.normal(size=n) + z[:, 0]], axis=1)[:, :p]
    gone = r.random((n, p)) < [0.1, 0.3, 0.2, 0.0][:p]
    return np.where(gone, np.nan, x)


def _bayes_rows(a, b):
    """Bayesian ridge on rows, by the usual fixed point of its evidence."""
    ma, mb = a.mean(0), b.mean()
    a, b = a - ma, b - mb
    noise, weight, old = 1 / (b.var() + np.finfo(float).eps), 1.0, None
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    for _ in range(300):
        coef = vt.T @ (s / (s ** 2 + weight / noise) * (u.T @ b))
        if old is not None and np.abs(coef - old).sum() < 1e-3:
            break
        rest = ((b - a @ coef) ** 2).sum()
        known = (noise * s ** 2 / (weight + noise * s ** 2)).sum()
        weight, noise, old = (known + 2e-6) / ((coef ** 2).sum() + 2e-6), (len(b) - known + 2e-6) / (rest + 2e-6), coef
    return coef, mb - ma @ coef


def _rowwise(x, rounds, method):
    gone, p = np.isnan(x), x.shape[1]
    z = np.where(gone, np.nanmean(x, axis=0), x)
    order = sorted((c for c in range(p) if gone[:, c].any()), key=lambda c: (gone[:, c].sum(), c))
    for _ in range(rounds):
        for c in order:
            others, has = [k for k in range(p) if k != c], ~gone[:, c]
            a, b = z[has][:, others], z[has, c]
            if method == "bayes":
                coef, start = _bayes_rows(a, b)
            else:
                full = np.linalg.lstsq(np.column_stack([np.ones(len(a)), a]), b, rcond=None)[0]
                start, coef = full[0], full[1:]
            z[gone[:, c], c] = start + z[gone[:, c]][:, others] @ coef
    return z


def _numbers(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(3), names


@pytest.mark.parametrize("method", ["ols", "bayes"])
def test_chained_imputation_equals_the_row_wise_loop(spark, method):
    x = _gappy()
    df, names = _numbers(spark, x)
    model = P.ChainedImputer(inputCols=names, maxIter=4, tol=0.0, ridge=0.0, method=method).fit(df)
    got = np.array([[r[n] for n in names] for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got, _rowwise(x, 4, method), atol=1e-9) and np.array_equal(got[~np.isnan(x)], x[~np.isnan(x)])


def test_chained_imputation_scans_once_and_handles_edges(spark):
    x = _gappy(p=3)
    x[:5] = np.nan  # rows with nothing at all
    df, names = _numbers(spark, x)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chained", "fit")
    model = P.ChainedImputer(inputCols=names, maxIter=10).fit(df)
    ran = len(jobs.getJobIdsForGroup("chained"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ran <= 3  # one query, which adaptive execution may run as a few jobs
    out = model.transform(df).collect()
    assert all(r[n] is not None for r in out for n in names)
    new = spark.createDataFrame([(1, None, 2.0, None)], "id long, x0 double, x1 double, x2 double")
    assert None not in model.transform(new).first()
    blank = P.ChainedImputer(inputCols=names).fit(df.filter("false"))
    assert blank.transform(df).count() == 400
    whole = df.dropna()
    assert P.ChainedImputer(inputCols=names).fit(whole).transform(whole).exceptAll(whole).count() == 0


def test_saved_stages_carry_their_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("é", 1)], "c string, v int")
    model = Pipeline(stages=[P.OrdinalEncoder(inputCols=["v"]), *P.one_hot_table_stages(["c"])]).fit(df)
    new = spark.createDataFrame([("a", 3), ("zz", 9), (None, None), ("é", 1)], "c string, v int")
    before = {(r.c, r.v): r.c_ohe for r in model.transform(new).collect()}
    model.write().overwrite().save(str(tmp_path / "m"))
    for stage in model.stages:
        if isinstance(stage, P._HasTable):
            shutil.rmtree(stage.get_state()["table"])
    again = PipelineModel.load(str(tmp_path / "m"))
    rows = again.transform(new).collect()
    assert {(r.c, r.v): r.c_ohe for r in rows} == before
    assert sorted((r.c or "", r.v, r.c_ohe.indices.tolist()) for r in rows if r.v is not None) == [("a", 2, [0]), ("zz", -1, []), ("é", 0, [2])]
    assert [r.v for r in rows if r.c is None] == [None]


def test_one_hot_of_a_million_levels(spark):
    df = spark.range(1_000_000).select(F.concat(F.lit("level "), "id").alias("c"))
    model = Pipeline(stages=P.one_hot_table_stages(["c"])).fit(df)
    rows = model.transform(df.filter("c IN ('level 0', 'level 999999')").unionByName(spark.createDataFrame([("none",)], "c string"))).collect()
    assert {r.c: (r.c_ohe.size, r.c_ohe.indices.tolist()) for r in rows} == {
        "level 0": (1_000_000, [0]), "level 999999": (1_000_000, [999_999]), "none": (1_000_000, [])}


def test_approximate_medians_are_within_their_rank_error(spark):
    r = np.random.default_rng(3)
    x = np.sort(r.lognormal(size=60_000))
    df = spark.createDataFrame([(float(v),) for v in r.permutation(x)], "x double").repartition(6)
    got = P.approximate_medians(df, ["x"])["x"]
    assert got in x and abs(np.searchsorted(x, got) / len(x) - 0.5) < 0.01


def test_group_medians_with_a_hot_and_a_null_group(spark):
    r = np.random.default_rng(4)
    rows = [(["a", "a", "b", None][i % 4], None if i % 7 == 0 else float(np.round(r.normal(), 2)), float(i) if i % 4 != 2 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    got = {m.g: (m.x, m.y) for m in P.group_medians(df, ["x", "y"], ["g"]).collect()}
    for g in ("a", "b", None):
        x, y = ([v[k] for v in rows if v[0] == g and v[k] is not None] for k in (1, 2))
        assert np.isclose(got[g][0], np.median(x)) and (np.isclose(got[g][1], np.median(y)) if y else got[g][1] is None)


def test_bounded_distinct_counts_stop_in_one_scan(spark):
    df = spark.range(1000).select(F.col("id").alias("many"), (F.col("id") % 10).alias("ten"), (F.col("id") % 11).cast("string").alias("eleven"),
                                  F.lit(1).alias("one"), F.lit(None).cast("double").alias("none"),
                                  F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("zeros"))
    got = A.bounded_distinct(df.repartition(4), limit=10)
    assert {r.column_name: r.n_distinct for r in got.collect()} == {"many": 11, "ten": 10, "eleven": 11, "one": 1, "none": 0, "zeros": 1}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    exact, quick = ({r.column_name: r.role for r in feature_routing(df, exact=e).collect()} for e in (True, False))
    assert exact == quick
