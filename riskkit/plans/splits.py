"""Queries for splits, leakage control and routing (M1-M5)."""

from __future__ import annotations


from ..fixtures import survey_view, table, with_sr
from ..functions import rowwise as R
from ..operators import split as M
from ..operators import survey as D
from . import sqlbits as Q
from .catalog import register
from .derivations import FA_CTE

_SPLIT = ("CASE WHEN y BETWEEN 2011 AND 2014 THEN 'train' WHEN y BETWEEN 2015 AND 2016 THEN 'val' "
          "WHEN y BETWEEN 2017 AND 2018 THEN 'test' END")


@register("temporal_split", with_sr(
    f"SELECT SEQN, y AS YEAR_START, {_SPLIT} AS split FROM (SELECT SEQN, {Q.year_start('CYCLE')} AS y FROM SR) t"))
def temporal_split(spark, sf):
    sr = survey_view(spark, sf).select("SEQN", R.year_start("CYCLE").alias("YEAR_START"))
    return M.temporal_split(sr)


_POS = ("row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos, "
        "count(*) OVER (PARTITION BY quality) AS n")


@register("stratified_split",
          "SELECT doc_id, quality, CASE WHEN pos <= floor(0.2 * n) THEN 'test' ELSE 'train' END AS split "
          f"FROM (SELECT doc_id, quality, {_POS} FROM labels) t")
def stratified_split(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return M.stratified_split(lab, "doc_id", ["quality"], test_frac=0.2, seed=42)


@register("stratified_split_3way",
          "SELECT doc_id, quality, CASE WHEN pos <= floor(0.2 * n) THEN 'test' WHEN pos <= floor(0.4 * n) "
          f"THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, quality, {_POS} FROM labels) t")
def stratified_split_3way(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return M.stratified_split_multi(lab, "doc_id", ["quality"], [("test", 0.2), ("val", 0.2)], seed=42)


@register("stratified_folds",
          f"SELECT doc_id, quality, CAST((pos - 1) % 5 AS INTEGER) AS fold FROM (SELECT doc_id, quality, {_POS} "
          "FROM labels) t")
def stratified_folds(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return M.stratified_folds(lab, "doc_id", ["quality"], k=5, seed=42)


_KEPT_A = [c for c in D.FEATURES_A if c not in M.LEAK_COLUMNS and not c.startswith(("DIQ", "RX"))]


@register("exclude_leaky", with_sr(
    "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c not in ("SEQN", "CYCLE", "AGE_BIN", "BMI_CLASS",
                                                            "HYPERTENSION_FLAG", "SMOKER") else c
                          for c in _KEPT_A) + " FROM FA", FA_CTE))
def exclude_leaky(spark, sf):
    from .derivations import features_a_frame, round_doubles
    return round_doubles(M.exclude_leaky(features_a_frame(spark, sf)))


_ROUTE_COLS = [c for c in _KEPT_A if c not in ("SEQN", "CYCLE")]
_NUMTYPE = {"AGE", "RIAGENDR", "RIDRETH1", "BMI", "WAIST_HT_RATIO", "SBP_MEAN", "DBP_MEAN", "HYPERTENSION_FLAG",
            "TCHOL", "HDL", "TRIG", "CHOL_HDL_RATIO", "TG_TO_HDL", "ACR", "SMOKER", "PA_SCORE"}


def _routing_sql() -> str:
    parts = []
    for c in _ROUTE_COLS:
        d = f"count(DISTINCT {c})"
        num = "true" if c in _NUMTYPE else "false"
        parts.append(f"SELECT '{c}' AS column_name, CAST({d} AS BIGINT) AS n_distinct, CASE WHEN {d} <= 1 "
                     f"THEN 'dropped' WHEN {num} AND {d} > 10 THEN 'numeric' ELSE 'categorical' END AS role FROM FA")
    return with_sr(" UNION ALL ".join(parts), FA_CTE)


@register("feature_routing", _routing_sql())
def feature_routing(spark, sf):
    from .derivations import features_a_frame
    fa = M.exclude_leaky(features_a_frame(spark, sf))
    return M.feature_routing(fa, exclude=["SEQN", "CYCLE"])


@register("feature_roles", with_sr(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(least(count(DISTINCT {c}), 11) AS BIGINT) AS n_distinct, CASE WHEN count(DISTINCT {c}) <= 1 "
                       f"THEN 'dropped' WHEN {'true' if c in _NUMTYPE else 'false'} AND count(DISTINCT {c}) > 10 THEN 'numeric' ELSE 'categorical' END AS role FROM FA"
                       for c in _ROUTE_COLS), FA_CTE))
def feature_roles(spark, sf):
    """M5 with counting that stops at 11 values: one scan for all columns."""
    from .derivations import features_a_frame
    fa = M.exclude_leaky(features_a_frame(spark, sf))
    return M.feature_routing(fa, exclude=["SEQN", "CYCLE"], exact=False)
