"""Queries for row-wise scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import survey_view, table, with_sr
from ..functions import rowwise as R
from ..functions.schema import unit_fallback
from . import sqlbits as Q
from .catalog import register


def _r6(c):
    return F.round(c, 6)


@register("row_mean", with_sr(
    f"SELECT SEQN, {Q.row_mean(['BPXSY1', 'BPXSY2'])} AS SBP_MEAN, "
    f"{Q.row_mean(['BPXDI1', 'BPXDI2'])} AS DBP_MEAN FROM SR"))
def row_mean(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", R.row_mean(["BPXSY1", "BPXSY2"]).alias("SBP_MEAN"),
                     R.row_mean(["BPXDI1", "BPXDI2"]).alias("DBP_MEAN"))


@register("row_sum", with_sr(f"SELECT SEQN, {Q.row_sum(['PAQ605', 'PAQ620'])} AS PA_SCORE FROM SR"))
def row_sum(spark, sf):
    return survey_view(spark, sf).select("SEQN", R.row_sum(["PAQ605", "PAQ620"]).alias("PA_SCORE"))


@register("bins_right_closed", with_sr(
    f"SELECT SEQN, {Q.bins_right_closed('RIDAGEYR', *R.AGE_BINS_A)} AS AGE_BIN, "
    f"{Q.bins_right_closed('BMXBMI', *R.BMI_BINS_A)} AS BMI_CLASS FROM SR"))
def bins_right_closed(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", R.bins_right_closed("RIDAGEYR", *R.AGE_BINS_A).alias("AGE_BIN"),
                     R.bins_right_closed("BMXBMI", *R.BMI_BINS_A).alias("BMI_CLASS"))


@register("bins_left_closed", with_sr(
    f"SELECT SEQN, {Q.bins_right_closed('RIDAGEYR', *R.AGE_BINS_B)} AS AGE_BIN, "
    f"{Q.ladder('BMXBMI', *R.BMI_LADDER_B)} AS BMI_CLASS FROM SR"))
def bins_left_closed(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", R.bins_right_closed("RIDAGEYR", *R.AGE_BINS_B).alias("AGE_BIN"),
                     R.ladder_left_closed("BMXBMI", *R.BMI_LADDER_B).alias("BMI_CLASS"))


@register("bins_form", with_sr(
    f"SELECT SEQN, {Q.ladder_incl('RIDAGEYR', *R.AGE_LADDER_FORM)} AS AGE_BIN, "
    f"{Q.ladder_incl('BMXBMI', *R.BMI_LADDER_FORM)} AS BMI_CLASS FROM SR"))
def bins_form(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", R.ladder_upper_inclusive("RIDAGEYR", *R.AGE_LADDER_FORM).alias("AGE_BIN"),
                     R.ladder_upper_inclusive("BMXBMI", *R.BMI_LADDER_FORM).alias("BMI_CLASS"))


@register("guarded_ratio", with_sr(
    f"SELECT SEQN, round({Q.ratio('BMXWAIST', 'BMXHT')}, 6) AS WAIST_HT_RATIO, "
    f"round({Q.ratio('LBXTC', 'LBDHDD')}, 6) AS CHOL_HDL_RATIO, "
    f"round({Q.ratio('LBXTR', 'LBDHDD')}, 6) AS TG_TO_HDL, "
    f"round({Q.ratio('URXUMA', 'URXUCR')}, 6) AS ACR FROM SR"))
def guarded_ratio(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", _r6(R.ratio("BMXWAIST", "BMXHT")).alias("WAIST_HT_RATIO"),
                     _r6(R.ratio("LBXTC", "LBDHDD")).alias("CHOL_HDL_RATIO"),
                     _r6(R.ratio("LBXTR", "LBDHDD")).alias("TG_TO_HDL"),
                     _r6(R.ratio("URXUMA", "URXUCR")).alias("ACR"))


@register("homa_ir", with_sr("SELECT SEQN, round(LBXIN * LBXGLU / 405.0, 6) AS HOMA_IR FROM SR"))
def homa_ir(spark, sf):
    return survey_view(spark, sf).select("SEQN", _r6(R.homa_ir("LBXIN", "LBXGLU")).alias("HOMA_IR"))


@register("unit_fallback", with_sr(
    "SELECT SEQN, round(round(LBXGLU / 18.0182, 3) * 18.0182, 6) AS GLU_VAL FROM SR"))
def unit_fallback_q(spark, sf):
    # An SI-only lab frame: the mg/dL column is absent, so the SI column is scaled.
    si = survey_view(spark, sf).select(
        "SEQN", F.round(F.col("LBXGLU") / 18.0182, 3).alias("LBDGLUSI"))
    return si.select("SEQN", _r6(unit_fallback(si, ["LBXGLU", "LBXSGL"],
                                               ["LBDGLUSI", "LBDSGLSI"], 18.0182)).alias("GLU_VAL"))


@register("threshold_flag", with_sr(
    f"SELECT SEQN, CAST(coalesce(BPXSY1 >= 130, false) OR coalesce(BPXDI2 >= 80, false) AS INTEGER) "
    "AS HYPERTENSION_FLAG FROM SR"))
def threshold_flag(spark, sf):
    return survey_view(spark, sf).select(
        "SEQN", R.any_at_least([("BPXSY1", 130), ("BPXDI2", 80)]).alias("HYPERTENSION_FLAG"))


@register("text_flag", with_sr(
    f"SELECT SEQN, {Q.text_flag('SMQ020')} AS SMOKER, {Q.text_flag('DIQ010')} AS DIQ_FLAG FROM SR"))
def text_flag(spark, sf):
    return survey_view(spark, sf).select("SEQN", R.text_flag("SMQ020").alias("SMOKER"),
                                         R.text_flag("DIQ010").alias("DIQ_FLAG"))


@register("code_flag", with_sr(f"SELECT SEQN, {Q.flag('DIQ010 = 1')} AS DIAG_FLAG FROM SR"))
def code_flag(spark, sf):
    return survey_view(spark, sf).select("SEQN", R.code_flag("DIQ010", 1).alias("DIAG_FLAG"))


@register("keyword_flag", with_sr(f"SELECT SEQN, {Q.keyword('RXDDRUG')} AS MED_FLAG FROM SR"))
def keyword_flag(spark, sf):
    return survey_view(spark, sf).select("SEQN", R.keyword_flag("RXDDRUG").alias("MED_FLAG"))


@register("keyword_flag_documents",
          f"SELECT doc_id, {Q.keyword('text')} AS MED_FLAG FROM documents")
def keyword_flag_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.keyword_flag("text").alias("MED_FLAG"))


@register("year_extract", with_sr(f"SELECT SEQN, {Q.year_start('CYCLE')} AS YEAR_START FROM SR"))
def year_extract(spark, sf):
    return survey_view(spark, sf).select("SEQN", R.year_start("CYCLE").alias("YEAR_START"))


@register("interactions", with_sr(
    "SELECT SEQN, round(RIDAGEYR * BMXBMI, 6) AS AGE_x_BMI, round(BMXBMI * BPXSY1, 6) AS BMI_x_SBP, "
    f"round(LBDHDD * coalesce({Q.lenient('SMQ020')}, 0.0), 6) AS HDL_x_SMOKER FROM SR"))
def interactions(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", _r6(R.product("RIDAGEYR", "BMXBMI")).alias("AGE_x_BMI"),
                     _r6(R.product("BMXBMI", "BPXSY1")).alias("BMI_x_SBP"),
                     _r6(F.col("LBDHDD") * R.coerce_fill("SMQ020")).alias("HDL_x_SMOKER"))


@register("square", with_sr("SELECT SEQN, RIDAGEYR * RIDAGEYR AS AGE_sq FROM SR"))
def square(spark, sf):
    return survey_view(spark, sf).select("SEQN", R.square("RIDAGEYR").alias("AGE_sq"))


def _clog_sql(x: str) -> str:
    return f"round(CASE WHEN ({x}) IS NULL THEN NULL ELSE ln(1 + greatest({x}, 0.0)) END, 6)"


@register("clipped_log", with_sr(
    f"SELECT SEQN, {_clog_sql(Q.ratio('URXUMA', 'URXUCR'))} AS ACR_log, {_clog_sql('LBXTC')} AS TCHOL_log, "
    f"{_clog_sql('BPXDI1 - 50')} AS DBP_SHIFT_log FROM SR"))
def clipped_log(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", _r6(R.clipped_log1p(R.ratio("URXUMA", "URXUCR"))).alias("ACR_log"),
                     _r6(R.clipped_log1p("LBXTC")).alias("TCHOL_log"),
                     _r6(R.clipped_log1p(F.col("BPXDI1") - 50)).alias("DBP_SHIFT_log"))


@register("coerce_fill", with_sr(
    f"SELECT SEQN, coalesce({Q.lenient('SMQ020')}, 0.0) AS SMOKER_NUM, "
    f"coalesce({Q.lenient('RXDDRUG')}, 0.0) AS RX_NUM FROM SR"))
def coerce_fill(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", R.coerce_fill("SMQ020").alias("SMOKER_NUM"),
                     R.coerce_fill("RXDDRUG").alias("RX_NUM"))


@register("fill_category", with_sr("SELECT SEQN, coalesce(RXDDRUG, 'None') AS RXDDRUG, "
                                   "coalesce(SMQ020, 'None') AS SMQ020 FROM SR"))
def fill_category(spark, sf):
    return survey_view(spark, sf).select("SEQN", "RXDDRUG", "SMQ020").fillna("None", ["RXDDRUG", "SMQ020"])


@register("round4", with_sr(f"SELECT SEQN, round({Q.ratio('LBXTC', 'LBDHDD')}, 4) AS CHOL_HDL_RATIO FROM SR"))
def round4(spark, sf):
    return survey_view(spark, sf).select("SEQN", R.round_to(R.ratio("LBXTC", "LBDHDD"), 4)
                                         .alias("CHOL_HDL_RATIO"))


@register("format_numbers", with_sr(
    "SELECT SEQN, CASE WHEN BMXBMI IS NULL THEN NULL ELSE format('{:,.3f}', BMXBMI * 100) END AS BMI_X100, "
    "CASE WHEN BMXBMI IS NULL THEN NULL ELSE printf('%.1f', BMXBMI) END AS BMI_TXT FROM SR"))
def format_numbers(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", R.thousands(F.col("BMXBMI") * 100, 3).alias("BMI_X100"),
                     F.when(F.col("BMXBMI").isNull(), None).otherwise(R.fixed("BMXBMI", 1)).alias("BMI_TXT"))
