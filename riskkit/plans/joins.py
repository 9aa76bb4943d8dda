"""Queries for sources, component merge and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SR_NAMES, survey_view, table, with_sr
from ..operators import combine as J
from ..operators.survey import label_four_source
from ..session import checkpoint_root, scratch_path
from ..sources import io
from . import sqlbits as Q
from .catalog import register

# Component groups written from SR (RIAGENDR appears twice on purpose: J2 suffixing).
GROUPS = {
    "DEMO": ["RIDAGEYR", "RIAGENDR", "RIDRETH1"],
    "BMX": ["BMXBMI", "BMXWAIST", "BMXHT", "RIAGENDR"],
    "LAB": ["LBXGLU", "LBXGH", "LBXIN", "LBXTC", "LBDHDD", "LBXTR"],
    "QUEST": ["DIQ010", "SMQ020", "PAQ605", "PAQ620"],
}
LAB_FILTER = "LBXGLU IS NOT NULL OR LBXGH IS NOT NULL"


def component_root(spark, sf):
    from pyspark.storagelevel import StorageLevel
    root = scratch_path(spark, "components")
    # four component writes read the same rows: keep them for the duration
    sr = survey_view(spark, sf).withColumnRenamed("CYCLE", "cycle").persist(StorageLevel.MEMORY_AND_DISK)
    io.write_components(sr, root, GROUPS, "SEQN", filters={"LAB": LAB_FILTER})
    sr.unpersist()
    return root


def _lab(c):
    return f"CASE WHEN {LAB_FILTER} THEN {c} END AS {c}"


_MERGED_COLS = ("s.CYCLE AS cycle, s.RIDAGEYR, s.RIAGENDR AS RIAGENDR_DEMO, s.RIDRETH1, s.BMXBMI, "
                "s.BMXWAIST, s.BMXHT, s.RIAGENDR AS RIAGENDR_BMX, "
                + ", ".join(_lab(f"s.{c}").replace(f"AS s.{c}", f"AS {c}") for c in GROUPS["LAB"])
                + ", s.DIQ010, s.SMQ020, s.PAQ605, s.PAQ620")


@register("component_merge", with_sr(
    f"SELECT coalesce(s.SEQN, l.l_orderkey) AS SEQN, {_MERGED_COLS}, l.l_linenumber AS RX_LINE, "
    "l.l_quantity AS RX_QTY FROM SR s FULL OUTER JOIN lineitem l ON s.SEQN = l.l_orderkey"))
def component_merge(spark, sf):
    """Four one-row-per-respondent components (one shuffle) plus a fan-out component."""
    root = component_root(spark, sf)
    comps = io.load_components(spark, root, list(GROUPS))
    checkpoint_root(spark)
    # the merged table is read three times by the fan-out join: materialise it once
    merged = J.merge_unique_components(comps, "SEQN", carry=["cycle"]).checkpoint(eager=True)
    rx = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("SEQN"), F.col("l_linenumber").alias("RX_LINE"),
        F.col("l_quantity").alias("RX_QTY"))
    return J.join_fanout(merged, rx, "SEQN")


@register("component_merge_routed", with_sr(
    f"SELECT coalesce(s.SEQN, l.l_orderkey) AS SEQN, {_MERGED_COLS}, l.l_linenumber AS RX_LINE, "
    "l.l_quantity AS RX_QTY FROM SR s FULL OUTER JOIN lineitem l ON s.SEQN = l.l_orderkey"))
def component_merge_routed(spark, sf):
    """All five components at once: which hold a respondent more than once is found from their keys."""
    root = component_root(spark, sf)
    comps = io.load_components(spark, root, list(GROUPS))
    first = next(iter(comps))
    comps = {n: f if n == first else f.drop("cycle") for n, f in comps.items()}
    comps["RX"] = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("SEQN"), F.col("l_linenumber").alias("RX_LINE"),
                                                      F.col("l_quantity").alias("RX_QTY"))
    checkpoint_root(spark)
    return J.merge_components(comps, "SEQN")


@register("cycle_tag", with_sr("SELECT CYCLE AS cycle, CAST(count(*) AS BIGINT) AS n FROM SR GROUP BY CYCLE"))
def cycle_tag(spark, sf):
    root = component_root(spark, sf)
    demo = io.read_component(spark, root, "demo")
    return demo.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))


@register("csv_roundtrip", with_sr("SELECT * FROM SR"))
def csv_roundtrip(spark, sf):
    sr = survey_view(spark, sf)
    path = scratch_path(spark, "sr_csv")
    io.write_table(sr, path, "csv", partition_by=["CYCLE"])
    schema = sr.schema
    return io.read_csv(spark, path, schema).select(*SR_NAMES)


@register("projected_scan", with_sr("SELECT SEQN, LBXGH FROM SR WHERE CYCLE = '2017_2018'"))
def projected_scan(spark, sf):
    path = scratch_path(spark, "sr_parquet")
    io.write_table(survey_view(spark, sf), path, partition_by=["CYCLE"])
    df = io.read_table(spark, path)
    # cycle filter prunes folders; two columns are read
    return df.filter(F.col("CYCLE") == "2017_2018").select("SEQN", "LBXGH")


@register("append_sink", with_sr("SELECT SEQN, CYCLE, BMXBMI FROM SR"))
def append_sink(spark, sf):
    sr = survey_view(spark, sf).select("SEQN", "CYCLE", "BMXBMI")
    path = scratch_path(spark, "sr_append")
    io.write_table(sr.filter("CYCLE <= '2013_2014'"), path, mode="overwrite", partition_by=["CYCLE"])
    io.write_table(sr.filter("CYCLE > '2013_2014'"), path, mode="append", partition_by=["CYCLE"])
    return io.read_table(spark, path).select("SEQN", "CYCLE", "BMXBMI")


_D1 = (f"{Q.flag('DIQ010 = 1')} AS DIAG_FLAG, {Q.flag('LBXGH >= 6.5')} AS HIGH_A1C, "
       f"{Q.flag('LBXGLU >= 126')} AS HIGH_GLU, {Q.keyword('RXDDRUG')} AS MED_FLAG")


@register("label_left_join", with_sr(
    "SELECT s.SEQN, s.CYCLE, s.BMXBMI, t.DIABETES_BIN FROM SR s LEFT JOIN (SELECT SEQN, "
    "CAST(greatest(DIAG_FLAG, HIGH_A1C, HIGH_GLU, MED_FLAG) AS INTEGER) AS DIABETES_BIN FROM "
    f"(SELECT SEQN, {_D1} FROM SR WHERE LBXGH IS NOT NULL) x) t ON s.SEQN = t.SEQN"))
def label_left_join(spark, sf):
    sr = survey_view(spark, sf)
    labels = label_four_source(sr.filter("LBXGH IS NOT NULL")).select("SEQN", "DIABETES_BIN")
    return J.left_join_labels(sr.select("SEQN", "CYCLE", "BMXBMI"), labels, "SEQN")


@register("union_missing_cols", with_sr(
    "SELECT SEQN, CYCLE, LBXGLU, CAST(NULL AS DOUBLE) AS LBXGH FROM SR WHERE CYCLE = '2011_2012' "
    "UNION ALL SELECT SEQN, CYCLE, CAST(NULL AS DOUBLE), LBXGH FROM SR WHERE CYCLE <> '2011_2012'"))
def union_missing_cols(spark, sf):
    sr = survey_view(spark, sf)
    a = sr.filter("CYCLE = '2011_2012'").select("SEQN", "CYCLE", "LBXGLU")
    b = sr.filter("CYCLE <> '2011_2012'").select("SEQN", "CYCLE", "LBXGH")
    return J.union_by_name([a, b])


@register("column_bind",
          "SELECT o.o_orderkey, o.o_totalprice, l.n_lines, l.qty FROM orders o JOIN "
          "(SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_quantity), 6) AS qty "
          "FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey")
def column_bind(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    per_order = (table(spark, sf, "lineitem").groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 6).alias("qty"))
                 .withColumnRenamed("l_orderkey", "o_orderkey"))
    return J.bind_columns(orders, per_order, "o_orderkey")


@register("dedupe_keep_first",
          "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER "
          "(PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem) t "
          "WHERE rn = 1")
def dedupe_keep_first(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return J.dedupe_keep_first(li, ["l_orderkey"], ["l_linenumber"])
