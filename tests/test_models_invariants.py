"""Rows-only queries: invariants (probability range, persistence, stream = batch, additivity)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_logistic_scores_in_range_and_signal(spark, q):
    df = q["fit_logistic"](spark, SF)
    r = df.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= r.lo <= r.hi <= 1.0 and r.n > 0
    from riskkit.operators.metrics import roc_auc
    assert roc_auc(df, "label", "p").first()["auc"] > 0.5


def test_model_roundtrip_identical(spark, q):
    df = q["model_roundtrip"](spark, SF)
    assert df.filter(F.abs(F.col("p_before") - F.col("p_after")) > 1e-12).count() == 0


def test_stream_equals_batch(spark, q):
    a = q["score_batch"](spark, SF).select("id", "risk_probability", "risk_level")
    b = q["score_stream"](spark, SF).select("id", "risk_probability", "risk_level")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_scores_are_the_fitted_models(spark, q):
    """Raw request values reach the model once: per id the score is the fitted model's own probability."""
    fit = q["fit_logistic"](spark, SF).select(F.col("SEQN").cast("string").alias("id"), "p")
    both = q["score_batch"](spark, SF).join(fit, "id")
    r = both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("risk_probability") - F.col("p"))).alias("gap")).first()
    assert r.n == fit.count() and r.gap < 1e-4


def test_advice_reads_raw_values(spark, q):
    topics = q["score_batch"](spark, SF).select("id", F.col("advice.topic").alias("topic"))
    share = topics.agg(F.avg(F.array_contains("topic", "Weight Management").cast("int")).alias("w"),
                       F.avg(F.array_contains("topic", "Physical Activity").cast("int")).alias("a")).first()
    assert 0 < share.w < 1 and 0 < share.a < 1


# The published smoke request.
REQUEST = {"AGE": 55.0, "AGE_BIN": "50-59", "SEX": 1, "BMI": 29.5, "BMI_CLASS": "Obese", "WAIST_HT_RATIO": 0.58, "SBP_MEAN": 135.0,
           "DBP_MEAN": 88.0, "HYPERTENSION_FLAG": 1, "TCHOL": 210.0, "HDL": 45.0, "TRIG": None, "CHOL_HDL_RATIO": 4.6, "TG_TO_HDL": None,
           "ACR": 15.0, "SMOKER": 1, "PA_SCORE": 100.0}


def test_request_with_nulls_and_unseen_labels(spark):
    from riskkit.plans.models_q import scoring_model
    from riskkit.streaming import score as S
    rows = [("r1", *REQUEST.values()), ("r2", *[None] * len(REQUEST)), ("r3", *{**REQUEST, "AGE_BIN": "zzz", "BMI_CLASS": "zzz"}.values())]
    out = {r.id: r for r in S.score(spark.createDataFrame(rows, S.RISK_INPUT), scoring_model(spark, SF)).collect()}
    assert len(out) == 3 and all(0 <= r.risk_probability <= 1 for r in out.values())
    assert out["r1"].risk_probability == out["r3"].risk_probability  # the form's own labels are not read
    assert [a.topic for a in out["r1"].advice][1:] == ["Weight Management", "Blood Pressure", "Physical Activity", "Smoking"]


def test_sampled_shapley_additivity(spark, q):
    phi = q["shapley_sampled"](spark, SF)
    per_row = phi.groupBy("SEQN").agg(F.sum("phi").alias("s"), F.first("base").alias("base"))
    from riskkit.plans.models_q import context, scoring_model, RAW
    from riskkit.operators.models import positive_probability
    c = context(spark, SF)
    p = positive_probability(scoring_model(spark, SF).transform(c.raw.filter("split = 'test'").select("SEQN", *RAW))).select("SEQN", "p")
    bad = per_row.join(p, "SEQN").filter(F.abs(F.col("s") + F.col("base") - F.col("p")) > 1e-9).count()
    assert bad == 0


def test_calibrated_in_unit_interval(spark, q):
    r = q["calibrated"](spark, SF).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert 0.0 <= r.lo <= r.hi <= 1.0


def test_importances_are_shares_in_order(spark, q):
    rows = q["gbt_importance"](spark, SF).collect()
    shares = [r.importance for r in rows]
    assert len(rows) == 20 and shares == sorted(shares, reverse=True)
    assert min(shares) >= 0 and 0.9 < sum(shares) <= 1 + 1e-9
    assert not any("_ohe" in r.feature and r.importance > 0.2 for r in rows)  # the planted signal is in the numbers


def test_chained_imputer_fills_everything(spark, q):
    df = q["impute_chained"](spark, SF)
    assert df.filter(" OR ".join(f"{c} IS NULL" for c in df.columns if c != "SEQN")).count() == 0


def test_wide_features_do_not_run_as_one_interpreted_method(spark, q):
    from riskkit.plans import models_q as M
    M.release()
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        M.context(spark, SF)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "4000")  # a caller's lower limit stays
        M.stack_context(spark, SF)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "4000"
    finally:
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
        M.release()
