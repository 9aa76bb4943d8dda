"""Queries for column profiles and class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SR_NAMES, survey_view, table, with_sr
from ..functions import rowwise as R
from ..operators import profile as A
from ..operators.split import temporal_split
from . import sqlbits as Q
from .catalog import register

_NUM = [n for n in SR_NAMES if n not in ("CYCLE", "SMQ020", "RXDDRUG")]
_TXT = ["CYCLE", "SMQ020", "RXDDRUG"]


@register("null_profile", with_sr(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
    f"CAST(count({c}) AS BIGINT) AS non_nulls FROM SR" for c in SR_NAMES)))
def null_profile(spark, sf):
    return A.null_profile(survey_view(spark, sf))


@register("value_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "events"), "event_type")


@register("value_counts_codes", with_sr(
    "SELECT DIQ010, CAST(count(*) AS BIGINT) AS n FROM SR GROUP BY DIQ010"))
def value_counts_codes(spark, sf):
    return A.value_counts(survey_view(spark, sf), "DIQ010")


@register("class_share",
          "SELECT quality, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM (SELECT l.quality, "
          "CAST(count(*) AS BIGINT) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id "
          "GROUP BY l.quality) t")
def class_share(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return A.class_share(docs.join(lab, "doc_id"), "quality")


@register("class_ratio",
          "SELECT CAST(count_if(quality = 0) AS BIGINT) AS negatives, CAST(count_if(quality = 1) AS BIGINT) "
          "AS positives, round(count_if(quality = 0) / NULLIF(count_if(quality = 1), 0), 6) AS ratio FROM labels")
def class_ratio(spark, sf):
    return A.class_ratio(table(spark, sf, "labels"), "quality")


@register("distinct_profile", with_sr(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM SR"
    for c in SR_NAMES)))
def distinct_profile(spark, sf):
    return A.distinct_counts(survey_view(spark, sf))


@register("any_value", with_sr(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) > 0 AS has_value FROM SR" for c in SR_NAMES)))
def any_value(spark, sf):
    return A.any_value(survey_view(spark, sf))


def _describe_sql() -> str:
    parts = []
    for c in _NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, CAST(count({x}) AS BIGINT) AS count, CAST(NULL AS BIGINT) AS unique, "
            f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, "
            f"round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM SR")
    for c in _TXT:
        parts.append(
            f"SELECT '{c}', CAST(count({c}) AS BIGINT), (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM SR), "
            f"(SELECT {c} FROM SR WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), "
            f"(SELECT CAST(count(*) AS BIGINT) FROM SR WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM SR")
    return with_sr(" UNION ALL ".join(parts))


@register("describe_all", _describe_sql())
def describe_all(spark, sf):
    return A.describe_all(survey_view(spark, sf))


@register("run_summary", with_sr(
    "SELECT CAST(count(*) AS BIGINT) AS rows, 25 AS cols, 'LBXGLU' AS glucose_source, "
    "CAST(count(LBXGLU) AS BIGINT) AS glu_non_null, CAST(count(LBXGH) AS BIGINT) AS a1c_non_null FROM SR"))
def run_summary(spark, sf):
    from ..functions.schema import resolve
    sr = survey_view(spark, sf)
    src = resolve(sr, ["LBXGLU", "LBXSGL", "LBDGLUSI", "LBDSGLSI"])
    return sr.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(sr.columns)).alias("cols"),
                  F.lit(src).alias("glucose_source"), F.count(src).alias("glu_non_null"),
                  F.count("LBXGH").alias("a1c_non_null"))


_SPLIT = ("CASE WHEN y BETWEEN 2011 AND 2014 THEN 'train' WHEN y BETWEEN 2015 AND 2016 THEN 'val' "
          "WHEN y BETWEEN 2017 AND 2018 THEN 'test' END")


@register("split_counts", with_sr(
    f"SELECT split, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_SPLIT} AS split FROM "
    f"(SELECT {Q.year_start('CYCLE')} AS y FROM SR) a) b GROUP BY split"))
def split_counts(spark, sf):
    sr = survey_view(spark, sf).select("SEQN", R.year_start("CYCLE").alias("YEAR_START"))
    return A.split_counts(temporal_split(sr, "YEAR_START"))
