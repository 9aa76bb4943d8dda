"""Queries for projection and schema operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SR_NAMES, survey_view, table, with_sr
from ..functions import schema as S
from ..operators.survey import CYCLE_CODES
from .catalog import register

_NUMERIC_SR = [n for n in SR_NAMES if n not in ("CYCLE", "SMQ020", "RXDDRUG")]
_AUDIT = ["seqn", "RIDAGEYR", "bmxbmi", "LBXGH", "LBXIN", "LBXSGL", "DIQ010", "RXDUSE",
          "PAQ605", "smq020", "BPXSY3"]
_DROP = ["RXDDRUG", "SMQ020", "NOT_THERE", "DIQ175X"]
_WANTED = ["SEQN", "CYCLE", "RIDAGEYR", "BMXBMI", "NOT_A_COLUMN", "LBXGH"]
_REQUIRED = ["SEQN", "BMXWAIST", "BMXHT"]


def _audit_sql() -> str:
    vals = ", ".join(f"('{w}')" for w in _AUDIT)
    return with_sr(
        "SELECT w.col AS column_name, EXISTS (SELECT 1 FROM (DESCRIBE SELECT * FROM SR) d "
        "WHERE upper(d.column_name) = upper(w.col)) AS present "
        f"FROM (VALUES {vals}) w(col)")


@register("column_audit", _audit_sql())
def column_audit(spark, sf):
    return S.column_audit(survey_view(spark, sf), _AUDIT)


@register("alias_resolve_default", with_sr(
    "SELECT SEQN, LBXGLU AS GLUCOSE, CAST(NULL AS DOUBLE) AS INSULIN_ALT, LBXGH AS A1C, "
    "CAST(0 AS INTEGER) AS DIQ_ALT FROM SR"))
def alias_resolve_default(spark, sf):
    df = survey_view(spark, sf)
    return df.select(
        "SEQN",
        S.column_or_default(df, ["LBXSGL_X", "LBXGLU", "LBXSGL"]).alias("GLUCOSE"),
        S.column_or_default(df, ["LBXINS", "LBXSIR"]).alias("INSULIN_ALT"),
        S.column_or_default(df, ["lbxgh", "lbxa1c"], ignore_case=True).alias("A1C"),
        S.column_or_default(df, ["DIQ050"], 0, "int").alias("DIQ_ALT"))


@register("prefix_select", with_sr(
    "SELECT SEQN, BPXSY1, BPXSY2, BPXDI1, BPXDI2, LBDHDD, PAQ605, PAQ620 FROM SR"))
def prefix_select(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", *S.columns_with_prefix(df, ["BPXSY", "BPXDI", "PAQ"], ["HDD"]))


@register("dtype_select", with_sr(f"SELECT {', '.join(_NUMERIC_SR)} FROM SR"))
def dtype_select(spark, sf):
    df = survey_view(spark, sf)
    return df.select(*S.columns_of_type(df))


@register("drop_ignore", with_sr(
    "SELECT " + ", ".join(n for n in SR_NAMES if n not in _DROP) + " FROM SR"))
def drop_ignore(spark, sf):
    return S.drop_ignore(survey_view(spark, sf), _DROP)


@register("project_existing", with_sr(
    "SELECT " + ", ".join(n for n in _WANTED if n in SR_NAMES) + " FROM SR"))
def project_existing(spark, sf):
    return S.project_existing(survey_view(spark, sf), _WANTED)


@register("project_required", with_sr("SELECT SEQN, BMXWAIST, BMXHT FROM SR"))
def project_required(spark, sf):
    return S.project_required(survey_view(spark, sf), _REQUIRED)


def _lenient_sql(c: str) -> str:
    v = f"TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)"
    return f"CASE WHEN isnan({v}) THEN NULL ELSE {v} END"


@register("lenient_cast", with_sr(
    f"SELECT SEQN, {_lenient_sql('SMQ020')} AS SMQ_NUM, {_lenient_sql('RXDDRUG')} AS RX_NUM, "
    f"{_lenient_sql('BMXBMI')} AS BMI_NUM FROM SR"))
def lenient_cast(spark, sf):
    df = survey_view(spark, sf)
    return df.select("SEQN", S.lenient_double("SMQ020").alias("SMQ_NUM"),
                     S.lenient_double("RXDDRUG").alias("RX_NUM"),
                     S.lenient_double("BMXBMI").alias("BMI_NUM"))


# Codes as text in the ways that casts differ on.
_ODD = ("CASE SEQN % 8 WHEN 0 THEN '1d' WHEN 1 THEN ' 7F' WHEN 2 THEN '1e3' WHEN 3 THEN 'NaN' WHEN 4 THEN '+.5 ' "
        "WHEN 5 THEN '' WHEN 6 THEN '1_0' ELSE '-2.' END")


@register("lenient_cast_text", with_sr(
    "SELECT SEQN, CASE SEQN % 8 WHEN 2 THEN 1000.0 WHEN 4 THEN 0.5 WHEN 7 THEN -2.0 END::DOUBLE AS CODE FROM SR"))
def lenient_cast_text(spark, sf):
    """P8 on text that a plain cast would take (``1d``, ``7F``, ``NaN``) or that only looks odd."""
    df = survey_view(spark, sf)
    return df.select("SEQN", S.lenient_double(F.expr(_ODD)).alias("CODE"))


@register("strict_cast", with_sr(
    "SELECT CAST(SEQN AS DOUBLE) AS SEQN_D, CAST(RIDRETH1 AS INTEGER) AS RACE_I, "
    "CAST(SMQ020 = '2' AS INTEGER) AS SMQ_IS_2 FROM SR"))
def strict_cast(spark, sf):
    df = survey_view(spark, sf)
    return df.select(S.strict_double("SEQN").alias("SEQN_D"),
                     F.col("RIDRETH1").cast("int").alias("RACE_I"),
                     (F.col("SMQ020") == "2").cast("int").alias("SMQ_IS_2"))


_REMAP_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in CYCLE_CODES.items())


@register("code_remap", with_sr(
    "SELECT SEQN, CAST(RIDRETH1 + 6 AS INTEGER) AS SDDSRVYR, "
    f"CASE CAST(RIDRETH1 + 6 AS INTEGER) {_REMAP_SQL} END AS cycle FROM SR"))
def code_remap(spark, sf):
    df = survey_view(spark, sf).select("SEQN", (F.col("RIDRETH1") + 6).cast("int").alias("SDDSRVYR"))
    return df.withColumn("cycle", S.remap("SDDSRVYR", CYCLE_CODES))


# --- P8-P10 on the text of a JSON column ------------------------------------------------------

_K_SQL = "regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)"
_K_NAMES = {0: "none", 1: "one", 2: "two", 50: "half", 99: "last"}


def _props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("K"))


@register("lenient_cast_props", f"SELECT event_id, CAST(nullif({_K_SQL}, '') AS DOUBLE) AS K FROM events")
def lenient_cast_props(spark, sf):
    """P8 on ``events.props``: a member of the JSON text as a number, null where it is none."""
    return _props(spark, sf).select("event_id", S.lenient_double("K").alias("K"))


@register("strict_cast_props", f"SELECT event_id, CAST({_K_SQL} AS DOUBLE) AS K FROM events WHERE {_K_SQL} <> ''")
def strict_cast_props(spark, sf):
    """P9 on ``events.props``, where it holds the member."""
    return _props(spark, sf).filter("K IS NOT NULL").select("event_id", S.strict_double("K").alias("K"))


@register("code_remap_props", f"SELECT event_id, CASE TRY_CAST(nullif({_K_SQL}, '') AS INTEGER) "
          + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _K_NAMES.items()) + " END AS K_NAME FROM events")
def code_remap_props(spark, sf):
    """P10 on ``events.props``: codes to names, others null."""
    return _props(spark, sf).select("event_id", S.remap(F.col("K").try_cast("int"), _K_NAMES).alias("K_NAME"))
