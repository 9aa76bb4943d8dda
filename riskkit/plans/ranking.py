"""Queries for ranking, bins, sort and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import rank as W
from .catalog import register


@register("rank_first",
          "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER "
          "(ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS BIGINT) AS rank FROM lineitem")
def rank_first(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.rank_first(li, "l_extendedprice", ["l_orderkey", "l_linenumber"])


@register("quantile_bins",
          "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN n <= 1 THEN NULL ELSE "
          "greatest(0, (5 * (r - 1) + n - 2) // (n - 1) - 1) END AS INTEGER) AS bin FROM ("
          "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, "
          "l_linenumber) AS r, count(*) OVER () AS n FROM lineitem) t")
def quantile_bins(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.quantile_bins(li, "l_extendedprice", ["l_orderkey", "l_linenumber"]).drop("l_extendedprice")


@register("equal_width_bins",
          "SELECT event_id, CAST(CAST(value > lo + 1 * st AS INTEGER) + CAST(value > lo + 2 * st AS INTEGER) + "
          "CAST(value > lo + 3 * st AS INTEGER) + CAST(value > lo + 4 * st AS INTEGER) AS INTEGER) AS bin "
          "FROM events, (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS st FROM events) s")
def equal_width_bins(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return W.equal_width_bins(ev, "value").select("event_id", "bin")


@register("sorted_table",
          "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_value "
          "FROM events GROUP BY event_type ORDER BY mean_value DESC")
def sorted_table(spark, sf):
    ev = table(spark, sf, "events")
    return (ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                         F.round(F.avg("value"), 6).alias("mean_value"))
            .orderBy(F.col("mean_value").desc()))


@register("top_k", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_k(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return W.top_k(ev, [F.col("value").desc(), F.col("event_id")], 20)


@register("signed_top_k",
          "SELECT user_id, event_id, centered, sign, rn FROM (SELECT user_id, event_id, value - 25.0 AS centered, "
          "CASE WHEN value > 25.0 THEN 'positive' ELSE 'negative' END AS sign, row_number() OVER ("
          "PARTITION BY user_id, value > 25.0 ORDER BY abs(value - 25.0) DESC, event_id) AS rn "
          "FROM events WHERE value <> 25.0) t WHERE rn <= 5")
def signed_top_k(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") - 25.0).alias("centered"))
    out = W.signed_top_k(ev, ["user_id"], "centered", ["event_id"], k=5)
    return out.withColumn("rn", F.col("rn").cast("long")).select("user_id", "event_id", "centered", "sign", "rn")
