"""Queries for domain derivations (D1-D10) and the flagship prevalence query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import survey_view, with_sr
from ..functions import missing as M
from ..functions import rowwise as R
from ..operators import survey as D
from . import sqlbits as Q
from .catalog import register


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engines sum and divide in different orders)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def clean_survey(df: DataFrame) -> DataFrame:
    """Text skip codes on string columns, numeric codes on questionnaire columns."""
    return M.null_numeric_codes(M.null_text_codes(df), ["DIQ010", "PAQ605", "PAQ620"])


# --- SQL mirrors of the feature sets -----------------------------------------

_D1 = (f"{Q.flag('DIQ010 = 1')} AS DIAG_FLAG, {Q.flag('LBXGH >= 6.5')} AS HIGH_A1C, "
       f"{Q.flag('LBXGLU >= 126')} AS HIGH_GLU, {Q.keyword('RXDDRUG')} AS MED_FLAG")
_D1_BIN = "CAST(greatest(DIAG_FLAG, HIGH_A1C, HIGH_GLU, MED_FLAG) AS INTEGER) AS DIABETES_BIN"

FA_CTE = (
    "FA0 AS (SELECT SEQN, CYCLE, RIDAGEYR AS AGE, RIAGENDR, RIDRETH1, BMXBMI AS BMI, "
    f"BMXWAIST / NULLIF(NULLIF(BMXHT, 0), 0) AS WAIST_HT_RATIO, "
    f"{Q.row_mean(['NULLIF(BPXSY1, 0)', 'NULLIF(BPXSY2, 0)'])} AS SBP_MEAN, "
    f"{Q.row_mean(['NULLIF(BPXDI1, 0)', 'NULLIF(BPXDI2, 0)'])} AS DBP_MEAN, "
    "LBXGLU AS GLUCOSE, LBXGH AS A1C, LBXIN AS INSULIN, LBXTC AS TCHOL, LBDHDD AS HDL, "
    "LBXTR AS TRIG, URXUMA AS ALB, URXUCR AS CRE, "
    f"{Q.text_flag('SMQ020')} AS SMOKER, {Q.row_sum(['PAQ605', 'PAQ620'])} AS PA_SCORE, "
    f"{Q.text_flag('DIQ010')} AS DIQ_FLAG, CAST(NULL AS INTEGER) AS ON_RX FROM SR), "
    "FA AS (SELECT SEQN, CYCLE, AGE, "
    f"{Q.bins_right_closed('AGE', *R.AGE_BINS_A)} AS AGE_BIN, RIAGENDR, RIDRETH1, BMI, "
    f"{Q.bins_right_closed('BMI', *R.BMI_BINS_A)} AS BMI_CLASS, WAIST_HT_RATIO, SBP_MEAN, DBP_MEAN, "
    "CAST(coalesce(SBP_MEAN >= 130, false) OR coalesce(DBP_MEAN >= 80, false) AS INTEGER) AS HYPERTENSION_FLAG, "
    "GLUCOSE, A1C, INSULIN, INSULIN * GLUCOSE / 405.0 AS HOMA_IR, TCHOL, HDL, TRIG, "
    f"{Q.ratio('TCHOL', 'HDL')} AS CHOL_HDL_RATIO, {Q.ratio('TRIG', 'HDL')} AS TG_TO_HDL, "
    f"{Q.ratio('ALB', 'CRE')} AS ACR, SMOKER, PA_SCORE, DIQ_FLAG, ON_RX, "
    "CAST(coalesce(DIQ_FLAG = 1, false) OR coalesce(A1C >= 6.5, false) OR coalesce(GLUCOSE >= 126, false) "
    "AS INTEGER) AS DIABETES_BIN, "
    "CASE WHEN coalesce(DIQ_FLAG = 1, false) OR coalesce(A1C >= 6.5, false) OR coalesce(GLUCOSE >= 126, false) "
    "THEN 2 WHEN coalesce(A1C >= 5.7 AND A1C < 6.5, false) OR coalesce(GLUCOSE >= 100 AND GLUCOSE < 126, false) "
    "THEN 1 ELSE 0 END AS DIABETES_3CLASS FROM FA0)"
)

_DBL_A = {"AGE", "RIAGENDR", "RIDRETH1", "BMI", "WAIST_HT_RATIO", "SBP_MEAN", "DBP_MEAN", "GLUCOSE",
          "A1C", "INSULIN", "HOMA_IR", "TCHOL", "HDL", "TRIG", "CHOL_HDL_RATIO", "TG_TO_HDL", "ACR",
          "PA_SCORE"}


def _select_rounded(cols, doubles) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


_NUM_CODES = ", ".join(str(v) for v in M.SKIP_NUMERIC_CODES)


def _code(c):
    return f"CASE WHEN {c} IN ({_NUM_CODES}) THEN NULL ELSE {c} END"


FB_CTE = (
    "CL AS (SELECT SEQN, " + Q.skip_text("CYCLE") + " AS CYCLE, RIDAGEYR, RIAGENDR, BMXBMI, BMXWAIST, "
    "BMXHT, BPXSY1, BPXSY2, BPXDI1, BPXDI2, LBXGLU, LBXGH, LBXIN, LBXTC, LBDHDD, LBXTR, URXUMA, URXUCR, "
    f"{Q.skip_text('SMQ020')} AS SMQ020, {_code('PAQ605')} AS PAQ605, {_code('PAQ620')} AS PAQ620 FROM SR), "
    "FB0 AS (SELECT SEQN, CYCLE AS cycle, RIDAGEYR AS AGE, RIAGENDR AS SEX, BMXBMI AS BMI, "
    f"{Q.ratio('BMXWAIST', 'BMXHT')} AS WAIST_HT_RATIO, {Q.row_mean(['BPXSY1', 'BPXSY2'])} AS SBP_MEAN, "
    f"{Q.row_mean(['BPXDI1', 'BPXDI2'])} AS DBP_MEAN, LBXGLU AS GLU_VAL, LBXGH AS A1C, LBXIN AS INSULIN, "
    f"LBXTC AS TCHOL, LBDHDD AS HDL, LBXTR AS TRIG, {Q.ratio('URXUMA', 'URXUCR')} AS ACR, "
    f"CAST({Q.text_flag('SMQ020')} AS DOUBLE) AS SMOKER, {Q.row_sum(['PAQ605', 'PAQ620'])} AS PA_SCORE "
    "FROM CL), "
    "FB AS (SELECT SEQN, cycle, AGE, " + Q.bins_right_closed("AGE", *R.AGE_BINS_B) + " AS AGE_BIN, SEX, BMI, "
    + Q.ladder("BMI", *R.BMI_LADDER_B) + " AS BMI_CLASS, WAIST_HT_RATIO, SBP_MEAN, DBP_MEAN, "
    "CAST(coalesce(SBP_MEAN >= 130, false) OR coalesce(DBP_MEAN >= 80, false) AS INTEGER) AS HYPERTENSION_FLAG, "
    "GLU_VAL, A1C, INSULIN, INSULIN * GLU_VAL / 405.0 AS HOMA_IR, TCHOL, HDL, TRIG, "
    f"{Q.ratio('TCHOL', 'HDL')} AS CHOL_HDL_RATIO, {Q.ratio('TRIG', 'HDL')} AS TG_TO_HDL, ACR, SMOKER, PA_SCORE, "
    "CAST(coalesce(GLU_VAL >= 126, false) OR coalesce(A1C >= 6.5, false) AS INTEGER) AS DIABETES_BIN FROM FB0)"
)
_DBL_B = {"AGE", "SEX", "BMI", "WAIST_HT_RATIO", "SBP_MEAN", "DBP_MEAN", "GLU_VAL", "A1C", "INSULIN",
          "HOMA_IR", "TCHOL", "HDL", "TRIG", "CHOL_HDL_RATIO", "TG_TO_HDL", "ACR", "SMOKER", "PA_SCORE"}


def features_a_frame(spark, sf):
    return D.features_a(survey_view(spark, sf))


def features_b_frame(spark, sf):
    return D.features_b(clean_survey(survey_view(spark, sf)))


# --- flagship -------------------------------------------------------------------

@register("prevalence_by_age", with_sr(
    "SELECT CYCLE, AGE_BIN, CAST(count(*) AS BIGINT) AS n, CAST(sum(DIABETES_BIN) AS BIGINT) AS n_diabetic, "
    "round(avg(DIABETES_BIN), 6) AS prevalence FROM (SELECT CYCLE, "
    f"{Q.bins_right_closed('RIDAGEYR', *R.AGE_BINS_A)} AS AGE_BIN, {_D1_BIN} FROM "
    f"(SELECT CYCLE, RIDAGEYR, {_D1} FROM SR) s) t GROUP BY CYCLE, AGE_BIN"))
def prevalence_by_age(spark, sf):
    """SR -> age bin -> four-source label -> (cycle, age bin): n, diabetic, prevalence."""
    sr = survey_view(spark, sf)
    lab = D.label_four_source(sr, keep=["CYCLE", "RIDAGEYR"])
    lab = lab.withColumn("AGE_BIN", R.bins_right_closed("RIDAGEYR", *R.AGE_BINS_A))
    return lab.groupBy("CYCLE", "AGE_BIN").agg(
        F.count(F.lit(1)).alias("n"), F.sum("DIABETES_BIN").cast("long").alias("n_diabetic"),
        F.round(F.avg("DIABETES_BIN"), 6).alias("prevalence"))


# --- D1-D4, D8 -------------------------------------------------------------------

@register("label_four_source", with_sr(
    f"SELECT SEQN, DIAG_FLAG, HIGH_A1C, HIGH_GLU, MED_FLAG, {_D1_BIN} FROM (SELECT SEQN, {_D1} FROM SR) t"))
def label_four_source(spark, sf):
    return D.label_four_source(survey_view(spark, sf))


@register("label_three_source", with_sr(
    "SELECT SEQN, DIQ_FLAG, A1C, GLUCOSE, DIABETES_BIN FROM FA", FA_CTE))
def label_three_source(spark, sf):
    fa = features_a_frame(spark, sf).drop("DIABETES_BIN")
    return D.label_three_source(fa).select("SEQN", "DIQ_FLAG", "A1C", "GLUCOSE", "DIABETES_BIN")


@register("label_labs", with_sr("SELECT SEQN, GLU_VAL, A1C, DIABETES_BIN FROM FB", FB_CTE))
def label_labs(spark, sf):
    fb = features_b_frame(spark, sf).drop("DIABETES_BIN")
    return D.label_labs(fb).select("SEQN", "GLU_VAL", "A1C", "DIABETES_BIN")


@register("label_three_class", with_sr("SELECT SEQN, DIABETES_3CLASS FROM FA", FA_CTE))
def label_three_class(spark, sf):
    return features_a_frame(spark, sf).select("SEQN", "DIABETES_3CLASS")


@register("label_extract", with_sr(
    f"SELECT SEQN AS RESPSEQ, {_D1_BIN} FROM (SELECT SEQN, {_D1} FROM SR) t"))
def label_extract(spark, sf):
    lab = D.label_four_source(survey_view(spark, sf)).withColumnRenamed("SEQN", "RESPSEQ")
    return D.label_extract(lab)


# --- D5-D7 --------------------------------------------------------------------------

@register("features_a", with_sr(
    f"SELECT {_select_rounded(D.FEATURES_A, _DBL_A)} FROM FA", FA_CTE))
def features_a(spark, sf):
    return round_doubles(features_a_frame(spark, sf))


@register("features_b", with_sr(
    f"SELECT {_select_rounded(D.FEATURES_B, _DBL_B)} FROM FB", FB_CTE))
def features_b(spark, sf):
    return round_doubles(features_b_frame(spark, sf))


def _clog(x):
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE ln(1 + greatest({x}, 0.0)) END"


_FI_COLS = ["AGE_x_BMI", "BMI_x_SBP", "SMOKER_NUM", "HDL_x_SMOKER", "AGE_sq", "ACR_log",
            "CHOL_HDL_RATIO_log", "TCHOL_log"]


@register("features_interaction", with_sr(
    "SELECT SEQN, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FI_COLS) + ", "
    "CAST(CASE WHEN WAIST_HT_RATIO IS NULL OR n <= 1 THEN NULL "
    "ELSE greatest(0, (5 * (r - 1) + n - 2) // (n - 1) - 1) END AS INTEGER) AS WHtR_bin FROM ("
    "SELECT SEQN, WAIST_HT_RATIO, AGE * BMI AS AGE_x_BMI, BMI * SBP_MEAN AS BMI_x_SBP, "
    f"coalesce({Q.lenient('SMOKER')}, 0.0) AS SMOKER_NUM, HDL * coalesce({Q.lenient('SMOKER')}, 0.0) AS HDL_x_SMOKER, "
    f"AGE * AGE AS AGE_sq, {_clog('ACR')} AS ACR_log, {_clog('CHOL_HDL_RATIO')} AS CHOL_HDL_RATIO_log, "
    f"{_clog('TCHOL')} AS TCHOL_log, row_number() OVER (ORDER BY WAIST_HT_RATIO NULLS LAST, SEQN) AS r, "
    "count(WAIST_HT_RATIO) OVER () AS n FROM FA) t", FA_CTE))
def features_interaction(spark, sf):
    fi = D.features_interaction(features_a_frame(spark, sf))
    return round_doubles(fi.select("SEQN", *_FI_COLS, "WHtR_bin"))


_EDGES = "[" + ", ".join(f"quantile_cont(WAIST_HT_RATIO, {p})" for p in (0.2, 0.4, 0.6, 0.8)) + "]"


@register("features_interaction_fitted", with_sr(
    "SELECT SEQN, CASE WHEN WAIST_HT_RATIO IS NULL THEN NULL ELSE CAST(len([e FOR e IN (SELECT "
    + _EDGES + " FROM FA WHERE CYCLE IN ('2011_2012', '2013_2014')) IF WAIST_HT_RATIO > e]) AS INTEGER) END AS WHtR_bin FROM FA", FA_CTE))
def features_interaction_fitted(spark, sf):
    """D7 with the bin edges of the training cycles, as models read it."""
    from ..operators.prep import QuantileBinner
    fa = features_a_frame(spark, sf)
    binner = QuantileBinner(inputCols=["WAIST_HT_RATIO"], q=5).fit(fa.filter("CYCLE IN ('2011_2012', '2013_2014')"))
    return D.features_interaction(fa, binner=binner).select("SEQN", "WHtR_bin")


# --- D9-D10 -------------------------------------------------------------------------

_P = "CAST(SEQN % 100 AS DOUBLE) / 100.0"
_LEVEL = "CASE WHEN p < 0.20 THEN 'Low' WHEN p < 0.50 THEN 'Moderate' ELSE 'High' END"


def synthetic_probability(df: DataFrame, key: str = "SEQN") -> DataFrame:
    """A fixed probability from the key (tests the level edges 0.2 and 0.5)."""
    return df.withColumn("p", (F.col(key) % 100).cast("double") / 100.0)


@register("risk_level", with_sr(f"SELECT SEQN, p, {_LEVEL} AS risk_level FROM (SELECT SEQN, {_P} AS p FROM SR) t"))
def risk_level(spark, sf):
    df = synthetic_probability(survey_view(spark, sf).select("SEQN"))
    return df.select("SEQN", "p", D.risk_level("p").alias("risk_level"))


def _advice_sql() -> str:
    lv = D.ADVICE_LEVEL
    head = (f"CASE level WHEN 'Low' THEN '{lv['Low'][0]}' WHEN 'Moderate' THEN '{lv['Moderate'][0]}' "
            f"ELSE '{lv['High'][0]}' END")
    headm = (f"CASE level WHEN 'Low' THEN '{lv['Low'][1]}' WHEN 'Moderate' THEN '{lv['Moderate'][1]}' "
             f"ELSE '{lv['High'][1]}' END")
    a = (f"A AS (SELECT SEQN, BMI, {_LEVEL} AS level, "
         "CAST(coalesce(BMI > 25, false) AS INTEGER) AS f1, "
         "CAST(coalesce(HYPERTENSION_FLAG = 1, false) OR coalesce(SBP_MEAN > 130, false) AS INTEGER) AS f2, "
         "CAST(coalesce(PA_SCORE < 150, false) AS INTEGER) AS f3, "
         "CAST(coalesce(SMOKER = 1, false) AS INTEGER) AS f4, "
         "CAST(coalesce(TG_TO_HDL > 3.0, false) AS INTEGER) AS f5 "
         f"FROM (SELECT *, {_P} AS p FROM FA) x)")
    w_msg = D.ADVICE_WEIGHT[1].replace("'", "''")
    body = " UNION ALL ".join([
        f"SELECT SEQN, 0 AS pos, {head} AS topic, {headm} AS message FROM A",
        f"SELECT SEQN, 1 AS pos, '{D.ADVICE_WEIGHT[0]}', printf('{w_msg}', BMI) FROM A WHERE f1 = 1",
        f"SELECT SEQN, 1 + f1, '{D.ADVICE_PRESSURE[0]}', '{D.ADVICE_PRESSURE[1]}' FROM A WHERE f2 = 1",
        f"SELECT SEQN, 1 + f1 + f2, '{D.ADVICE_ACTIVITY[0]}', '{D.ADVICE_ACTIVITY[1]}' FROM A WHERE f3 = 1",
        f"SELECT SEQN, 1 + f1 + f2 + f3, '{D.ADVICE_SMOKING[0]}', '{D.ADVICE_SMOKING[1]}' FROM A WHERE f4 = 1",
        f"SELECT SEQN, 1 + f1 + f2 + f3 + f4, '{D.ADVICE_LIPIDS[0]}', '{D.ADVICE_LIPIDS[1]}' "
        "FROM A WHERE f5 = 1",
    ])
    return with_sr(body, f"{FA_CTE}, {a}")


@register("advice_list", _advice_sql())
def advice_list(spark, sf):
    fa = synthetic_probability(features_a_frame(spark, sf))
    adv = fa.select("SEQN", D.advice("p").alias("advice"))
    return adv.select("SEQN", F.posexplode("advice").alias("pos", "item")).select(
        "SEQN", "pos", F.col("item.topic").alias("topic"), F.col("item.message").alias("message"))
