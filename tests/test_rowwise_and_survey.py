"""Edge cases of the column functions and survey derivations on tiny frames."""

from pyspark.sql import functions as F

from riskkit.functions import missing as M
from riskkit.functions import rowwise as R
from riskkit.functions import schema as S
from riskkit.operators import survey as D


def test_right_closed_age_bins_edges(spark):
    df = spark.createDataFrame([(0.0,), (18.0,), (30.0,), (120.0,), (121.0,), (None,), (18.5,)], "a double")
    got = [r[0] for r in df.select(R.bins_right_closed("a", *R.AGE_BINS_A)).collect()]
    assert got == [None, "child", "young", "elder", None, None, "young"]


def test_bmi_ladders_edges(spark):
    df = spark.createDataFrame([(18.5,), (25.0,), (30.0,), (None,), (10.0,)], "b double")
    b = [r[0] for r in df.select(R.ladder_left_closed("b", *R.BMI_LADDER_B)).collect()]
    assert b == ["normal", "overweight", "obese", None, "underweight"]
    a = [r[0] for r in df.select(R.bins_right_closed("b", *R.BMI_BINS_A)).collect()]
    assert a == ["under", "normal", "over", None, "under"]
    form = [r[0] for r in df.select(R.ladder_upper_inclusive("b", *R.BMI_LADDER_FORM)).collect()]
    assert form == ["Normal", "Overweight", "Obese", None, "Underweight"]


def test_row_mean_sum_all_missing(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 2.0)], "x double, y double")
    rows = df.select(R.row_mean(["x", "y"]).alias("m"), R.row_sum(["x", "y"]).alias("s")).collect()
    assert [(r.m, r.s) for r in rows] == [(None, 0.0), (1.0, 1.0), (1.5, 3.0)]


def test_flags_never_null_and_sbp_130(spark):
    df = spark.createDataFrame([(130.0, None), (None, None), (129.0, 80.0)], "s double, d double")
    got = [r[0] for r in df.select(R.any_at_least([("s", 130), ("d", 80)])).collect()]
    assert got == [1, 0, 1]


def test_ratio_zero_and_null_divisor(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(R.ratio("a", "b")).collect()] == [None, None, 1.5]


def test_lenient_cast_nan_text_and_padding(spark):
    df = spark.createDataFrame([("nan",), (" 1 ",), ("abc",), ("1.0",), (None,)], "t string")
    assert [r[0] for r in df.select(S.lenient_double("t")).collect()] == [None, 1.0, None, 1.0, None]


def test_text_flag_and_keyword(spark):
    df = spark.createDataFrame([(" 1 ",), ("1.0",), ("2",), (None,), ("nan",)], "t string")
    assert [r[0] for r in df.select(R.text_flag("t")).collect()] == [1, 1, 0, 0, 0]
    d = spark.createDataFrame([("METFORMIN HCL",), ("Insulin Glargine",), ("LISINOPRIL",), (None,)], "d string")
    assert [r[0] for r in d.select(R.keyword_flag("d")).collect()] == [1, 1, 0, 0]


def test_keyword_pattern_escapes_metacharacters():
    assert R.keyword_pattern(["a.b", "c+"]) == "a\\.b|c\\+"


def test_year_start_no_match_is_null(spark):
    df = spark.createDataFrame([("2011_2012",), ("cycle",), (None,)], "c string")
    assert [r[0] for r in df.select(R.year_start("c")).collect()] == [2011, None, None]


def test_skip_codes(spark):
    df = spark.createDataFrame([("7", 77.0, 7.0), ("", 5.0, 99.0), ("x", None, 1.0)], "s string, q double, k double")
    out = M.null_numeric_codes(M.null_text_codes(df), ["q"]).collect()
    assert [tuple(r) for r in out] == [(None, None, 7.0), (None, 5.0, 99.0), ("x", None, 1.0)]


def test_missing_ratio_is_to_non_nulls(spark):
    # 2 nulls, 5 non-nulls -> ratio 0.4, kept; 3 nulls / 4 -> dropped; all-null -> dropped
    rows = [(1.0 if i < 5 else None, 1.0 if i < 4 else None, None) for i in range(7)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    rep = {r.column_name: r.dropped for r in M.missing_report(df, threshold=0.4).collect()}
    assert rep == {"a": False, "b": True, "c": True}
    assert M.drop_high_missing(df).columns == ["a"]


def test_label_and_three_class(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5.0, 90.0, None), (2, 2.0, 6.5, None, None), (3, 2.0, 5.7, 99.0, None),
         (4, 2.0, None, 126.0, "metformin"), (5, None, None, None, "x")],
        "SEQN long, DIQ010 double, LBXGH double, LBXGLU double, RXDDRUG string")
    lab = {r.SEQN: r.DIABETES_BIN for r in D.label_four_source(df).collect()}
    assert lab == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    tc = df.select("SEQN", D.three_class_expr(F.lit(False), "LBXGH", "LBXGLU").alias("c")).collect()
    assert {r.SEQN: r.c for r in tc} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}


def test_risk_levels_edges(spark):
    df = spark.createDataFrame([(0.1999,), (0.2,), (0.4999,), (0.5,)], "p double")
    assert [r[0] for r in df.select(D.risk_level("p")).collect()] == ["Low", "Moderate", "Moderate", "High"]


def test_smoke_request_advice_topics(spark):
    # the fixture request: ratio missing, so no lipid advice
    df = spark.createDataFrame([(0.6, 29.5, 1, 135.0, 100.0, 1, None)],
                               "p double, BMI double, HYPERTENSION_FLAG int, SBP_MEAN double, "
                               "PA_SCORE double, SMOKER int, TG_TO_HDL double")
    items = df.select(D.advice("p").alias("a")).first()["a"]
    assert [i["topic"] for i in items] == ["Urgent", "Weight Management", "Blood Pressure",
                                           "Physical Activity", "Smoking"]
    assert "29.5" in items[1]["message"]


def test_advice_sbp_130_does_not_fire(spark):
    df = spark.createDataFrame([(0.1, 20.0, 0, 130.0, 200.0, 0, 1.0)],
                               "p double, BMI double, HYPERTENSION_FLAG int, SBP_MEAN double, "
                               "PA_SCORE double, SMOKER int, TG_TO_HDL double")
    items = df.select(D.advice("p").alias("a")).first()["a"]
    assert [i["topic"] for i in items] == ["General"]


def test_remap_unmatched_is_null(spark):
    df = spark.createDataFrame([(7,), (10,), (11,)], "c int")
    assert [r[0] for r in df.select(S.remap("c", D.CYCLE_CODES)).collect()] == ["2011_2012", "2017_2018", None]


def test_project_required_raises(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        S.project_required(df, ["a", "b"])
