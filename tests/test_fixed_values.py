"""Fixed values as literals, so that an oracle which shares a constant with the code cannot hide a wrong one."""

from riskkit.functions import missing as M
from riskkit.functions import rowwise as R
from riskkit.operators import survey as D
from riskkit.operators.split import LEAK_COLUMNS, LEAK_PREFIXES, TEMPORAL_SPLITS


def test_skip_codes():
    assert sorted(M.SKIP_TEXT_CODES) == sorted(["", " ", "NA", "N/A", "nan", "None", "999999", "99999", "9999", "999", "99", "9",
                                                "777777", "77777", "7777", "777", "77", "7"])
    assert sorted(M.SKIP_NUMERIC_CODES) == [7, 9, 77, 99, 777, 999, 7777, 9999, 77777, 99999, 777777, 999999]


def test_bins():
    assert list(R.AGE_BINS_A[0]) == [0, 18, 30, 45, 60, 75, 120]
    assert list(R.AGE_BINS_A[1]) == ["child", "young", "adult", "mid", "senior", "elder"]
    assert list(R.BMI_BINS_A[0]) == [0, 18.5, 25, 30, 35, 100]
    assert list(R.BMI_BINS_A[1]) == ["under", "normal", "over", "obese1", "obese2"]


def test_cycles_splits_and_leaks():
    assert D.CYCLE_CODES == {7: "2011_2012", 8: "2013_2014", 9: "2015_2016", 10: "2017_2018"}
    assert TEMPORAL_SPLITS == [("train", 2011, 2014), ("val", 2015, 2016), ("test", 2017, 2018)]
    assert LEAK_COLUMNS == ["A1C", "GLUCOSE", "INSULIN", "HOMA_IR", "DIQ_FLAG", "DIABETES_BIN", "DIABETES_3CLASS", "ON_RX"]
    assert LEAK_PREFIXES == ["DIQ", "RX"]


def test_advice_topics():
    assert [t for t, _ in (D.ADVICE_WEIGHT, D.ADVICE_PRESSURE, D.ADVICE_ACTIVITY, D.ADVICE_SMOKING, D.ADVICE_LIPIDS)] == [
        "Weight Management", "Blood Pressure", "Physical Activity", "Smoking", "Cholesterol & Fats"]
    assert {k: v[0] for k, v in D.ADVICE_LEVEL.items()} == {"Low": "General", "Moderate": "General", "High": "Urgent"}


def test_output_columns():
    assert D.FEATURES_A == ["SEQN", "CYCLE", "AGE", "AGE_BIN", "RIAGENDR", "RIDRETH1", "BMI", "BMI_CLASS", "WAIST_HT_RATIO", "SBP_MEAN",
                            "DBP_MEAN", "HYPERTENSION_FLAG", "GLUCOSE", "A1C", "INSULIN", "HOMA_IR", "TCHOL", "HDL", "TRIG", "CHOL_HDL_RATIO",
                            "TG_TO_HDL", "ACR", "SMOKER", "PA_SCORE", "DIQ_FLAG", "ON_RX", "DIABETES_BIN", "DIABETES_3CLASS"]
