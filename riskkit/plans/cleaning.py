"""Queries for filters and missing-value rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SR_NAMES, survey_view, with_sr
from ..functions import missing as M
from ..functions.rowwise import year_start
from ..functions.schema import remap
from ..operators.survey import CYCLE_CODES, VALID_CYCLES
from . import sqlbits as Q
from .catalog import register

_REMAP = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CYCLE_CODES.items())
_VALID = ", ".join(f"'{c}'" for c in VALID_CYCLES)


@register("filter_cycles", with_sr(
    "SELECT * FROM (SELECT SEQN, CASE CAST(RIDRETH1 + 6 AS INTEGER) "
    f"{_REMAP} END AS cycle FROM SR) t WHERE cycle IN ({_VALID})"))
def filter_cycles(spark, sf):
    df = survey_view(spark, sf).select(
        "SEQN", remap((F.col("RIDRETH1") + 6).cast("int"), CYCLE_CODES).alias("cycle"))
    return M.filter_in(df, "cycle", VALID_CYCLES)


@register("study_population", with_sr(
    "SELECT SEQN, LBXGLU, LBXGH FROM SR WHERE LBXGLU IS NOT NULL AND LBXGH IS NOT NULL"))
def study_population(spark, sf):
    return M.require_all(survey_view(spark, sf), ["LBXGLU", "LBXGH"]).select("SEQN", "LBXGLU", "LBXGH")


@register("drop_missing_critical", with_sr(
    "SELECT SEQN, RIDAGEYR, BMXBMI, BMXWAIST FROM SR "
    "WHERE RIDAGEYR IS NOT NULL AND BMXBMI IS NOT NULL AND BMXWAIST IS NOT NULL"))
def drop_missing_critical(spark, sf):
    df = M.drop_missing_present(survey_view(spark, sf),
                                ["SEQN", "RIDAGEYR", "BMXBMI", "BMXWAIST", "NOT_THERE"])
    return df.select("SEQN", "RIDAGEYR", "BMXBMI", "BMXWAIST")


_LAB_LABEL = ("CASE WHEN LBXGLU IS NULL AND LBXGH IS NULL THEN NULL ELSE "
              "CAST(coalesce(LBXGLU >= 126, false) OR coalesce(LBXGH >= 6.5, false) AS DOUBLE) END")


@register("labelled_only", with_sr(
    f"SELECT SEQN, CAST(LABEL AS INTEGER) AS LABEL FROM (SELECT SEQN, {_LAB_LABEL} AS LABEL FROM SR) t "
    "WHERE LABEL IS NOT NULL"))
def labelled_only(spark, sf):
    df = survey_view(spark, sf)
    lab = (F.when(F.col("LBXGLU").isNull() & F.col("LBXGH").isNull(), F.lit(None))
           .otherwise((F.coalesce(F.col("LBXGLU") >= 126, F.lit(False))
                       | F.coalesce(F.col("LBXGH") >= 6.5, F.lit(False))).cast("double")))
    return M.labelled_only(df.select("SEQN", lab.alias("LABEL")), "LABEL")


@register("between_years", with_sr(
    f"SELECT * FROM (SELECT SEQN, CYCLE, {Q.year_start('CYCLE')} AS YEAR_START FROM SR) t "
    "WHERE YEAR_START BETWEEN 2011 AND 2014"))
def between_years(spark, sf):
    df = survey_view(spark, sf).select("SEQN", "CYCLE", year_start("CYCLE").alias("YEAR_START"))
    return M.between(df, "YEAR_START", 2011, 2014)


@register("skip_codes_text", with_sr(
    f"SELECT SEQN, {Q.skip_text('CYCLE')} AS CYCLE, {Q.skip_text('SMQ020')} AS SMQ020, "
    f"{Q.skip_text('RXDDRUG')} AS RXDDRUG FROM SR"))
def skip_codes_text(spark, sf):
    df = survey_view(spark, sf).select("SEQN", "CYCLE", "SMQ020", "RXDDRUG")
    return M.null_text_codes(df)


_NUM_CODES = ", ".join(str(v) for v in M.SKIP_NUMERIC_CODES)
_NUMERIC_SR = [n for n in SR_NAMES if n not in ("SEQN", "CYCLE", "SMQ020", "RXDDRUG")]


@register("skip_codes_numeric", with_sr(
    "SELECT SEQN, CYCLE, SMQ020, RXDDRUG, " + ", ".join(
        f"CASE WHEN {c} IN ({_NUM_CODES}) THEN NULL ELSE {c} END AS {c}" for c in _NUMERIC_SR)
    + " FROM SR"))
def skip_codes_numeric(spark, sf):
    return M.null_numeric_codes(survey_view(spark, sf), "all", exclude=["SEQN"])


@register("skip_codes_questionnaire", with_sr(
    "SELECT SEQN, RIDAGEYR, " + ", ".join(
        f"CASE WHEN {c} IN ({_NUM_CODES}) THEN NULL ELSE {c} END AS {c}"
        for c in ["DIQ010", "PAQ605", "PAQ620"]) + " FROM SR"))
def skip_codes_questionnaire(spark, sf):
    df = survey_view(spark, sf).select("SEQN", "RIDAGEYR", "DIQ010", "PAQ605", "PAQ620")
    return M.null_numeric_codes(df, ["DIQ010", "PAQ605", "PAQ620"])


@register("zero_to_null", with_sr(
    "SELECT SEQN, NULLIF(BMXHT, 0) AS HEIGHT, NULLIF(BPXDI1, 0) AS DBP1 FROM SR"))
def zero_to_null(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", M.zero_to_null("BMXHT").alias("HEIGHT"),
                     M.zero_to_null("BPXDI1").alias("DBP1"))


def _missing_sql(threshold: float = 0.4) -> str:
    parts = []
    for c in SR_NAMES:
        nn = f"count({c})"
        nl = f"(count(*) - count({c}))"
        r = f"CASE WHEN {nn} = 0 THEN CAST('inf' AS DOUBLE) ELSE {nl} / {nn} END"
        parts.append(f"SELECT '{c}' AS column_name, CAST({nl} AS BIGINT) AS nulls, "
                     f"CAST({nn} AS BIGINT) AS non_nulls, round({r}, 6) AS missing_ratio, "
                     f"{r} > {threshold} AS dropped FROM SR")
    return with_sr(" UNION ALL ".join(parts))


@register("drop_high_missing", _missing_sql())
def drop_high_missing(spark, sf):
    return M.missing_report(survey_view(spark, sf), threshold=0.4)


# Columns of SR whose nulls exceed 0.4 of their values, by the view's own arithmetic.
_SPARSE = ("LBXGLU", "LBXIN", "LBXTR", "RXDDRUG")


@register("high_missing_dropped", with_sr("SELECT " + ", ".join(c for c in SR_NAMES if c not in _SPARSE) + " FROM SR"))
def high_missing_dropped(spark, sf):
    """the table without its high-missing columns."""
    return M.drop_high_missing(survey_view(spark, sf), threshold=0.4)
