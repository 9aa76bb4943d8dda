"""Ranking, running totals, bins and top-k (W1-W6) without single-partition windows.

A window with ``ORDER BY`` but no ``PARTITION BY`` puts every row in one task,
and a window partitioned by a low-cardinality key (a class, a stratum, a column
name) puts a third of the data in one task when one key is hot.  The two
primitives here avoid both:

``ordered_positions``
    range-partition on ``(by..., order...)`` so even one hot group spreads over
    many partitions, sort inside each partition, number rows locally, then add
    per-(partition, group) offsets from a small table (<= partitions + groups
    rows) that is joined back.  The ranged frame is checkpointed to the shared
    checkpoint folder so ids are fixed and survive executor loss.

``running_totals``
    the same layout, with running sums that stream through each sorted partition
    (one exchange) plus offsets.

Both need ``order`` to be a total order (add a unique tie key) for stable,
repeatable results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root

ColLike = str | Column


def _parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _names(cols: Sequence[ColLike]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _ranged(df: DataFrame, order: Sequence[ColLike], by: Sequence[str],
            num_partitions: int | None) -> DataFrame:
    keys = [*_names(by), *_names(order)]
    return (
        df.repartitionByRange(_parts(df, num_partitions), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
    )


def _offsets(part: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums of ``cols`` over partition ids, per group."""
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    out = part
    for c in cols:
        out = out.withColumn(f"_before_{c}", F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out


#: Offsets tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _join_back(ranged: DataFrame, part: DataFrame, by: Sequence[str]) -> DataFrame:
    # The offsets table has at most partitions + groups rows.  It is counted before the join is
    # planned: its estimate is inherited from the large side, so the first plan would shuffle both.
    p = F.broadcast(part) if part.count() <= BROADCAST_ROWS else part
    for c in ["_pid", *by]:
        p = p.withColumnRenamed(c, f"_k_{c}")
    cond = ranged["_pid"] == p["_k__pid"]
    for b in by:
        cond = cond & ranged[b].eqNullSafe(p[f"_k_{b}"])
    out = ranged.join(p, cond, "inner")
    return out.drop(*[f"_k_{c}" for c in ["_pid", *by]])


def ordered_positions(df: DataFrame, order: Sequence[ColLike], by: Sequence[str] = (),
                      pos_col: str = "pos", count_col: str | None = None,
                      num_partitions: int | None = None, with_sizes: bool = False):
    """Add ``pos_col``: 1-based row number in ``order`` within groups ``by``.

    ``count_col`` (optional) receives the group size.  Equivalent to
    ``row_number() OVER (PARTITION BY by ORDER BY order)`` but never routes a
    whole group, or the whole table, through one task.
    """
    checkpoint_root(df.sparkSession)
    by = list(by)
    ranged = _ranged(df, order, by, num_partitions).withColumn(
        "_local",
        F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33),
    )
    ranged = ranged.checkpoint(eager=True)
    part = ranged.groupBy("_pid", *by).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_local").alias("_first"))
    part = _offsets(part, by, ["_cnt"])
    if count_col:
        part = part.withColumn(count_col, F.sum("_cnt").over(Window.partitionBy(*by)))
    part = part.checkpoint(eager=True)
    out = _join_back(ranged, part, by)
    out = out.withColumn(
        pos_col, (F.col("_local") - F.col("_first") + F.col("_before__cnt") + 1).cast("long"))
    out = out.drop("_pid", "_local", "_cnt", "_first", "_before__cnt")
    if with_sizes:
        # group sizes from the small per-partition table (<= partitions + groups rows)
        sizes = part.groupBy(*by).agg(F.sum("_cnt").cast("long").alias("_size"))
        return out, sizes
    return out


def _local_sums(ranged: DataFrame, sums: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Add ``_loc_<c>``: running sums within each sorted partition and group, as the rows stream by.

    A window over the partition number would shuffle the ranged rows again; here one
    exchange is all.  NULL counts as zero; integers add up as long, others as double.
    """
    whole = {c: isinstance(ranged.schema[c].dataType, T.IntegralType) for c in sums}
    group = F.xxhash64(*[F.col(c) for c in by]) if by else F.lit(0).cast("long")
    rows = ranged.withColumn("_g", group).withColumns(
        {f"_loc_{c}": F.coalesce(F.col(c).cast("long" if whole[c] else "double"), F.lit(0)) for c in sums})

    def run(batches):
        last, carry = None, {}
        for batch in batches:
            g = np.array(batch.column("_g"))
            if not len(g):
                yield batch
                continue
            new = np.concatenate(([last is None or g[0] != last], g[1:] != g[:-1]))
            head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            for c in sums:
                i = batch.schema.get_field_index(f"_loc_{c}")
                total = np.cumsum(np.array(batch.column(i)))
                before = np.concatenate((np.zeros(1, total.dtype), total))[head]
                local = total - before
                if not new[0]:  # the group goes on from the last batch
                    local = local + np.where(np.cumsum(new) == 0, carry[c], np.zeros(1, total.dtype))
                carry[c] = local[-1]
                batch = batch.set_column(i, f"_loc_{c}", pa.array(local))
            last = g[-1]
            yield batch

    return rows.mapInArrow(run, rows.schema).drop("_g")


def running_totals(df: DataFrame, order: Sequence[ColLike], sums: Sequence[str],
                   by: Sequence[str] = (), suffix: str = "_cum",
                   num_partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums ``<c><suffix>`` of ``sums`` along ``order``.

    Use on a frame already reduced to one row per distinct order key (e.g.
    per distinct score) with a total order.
    """
    checkpoint_root(df.sparkSession)
    by = list(by)
    ranged = _local_sums(_ranged(df, order, by, num_partitions), sums, by).checkpoint(eager=True)
    part = ranged.groupBy("_pid", *by).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sums])
    part = _offsets(part, by, [f"_tot_{c}" for c in sums]).checkpoint(eager=True)
    out = _join_back(ranged, part, by)
    for c in sums:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_loc_{c}") + F.col(f"_before__tot_{c}"))
    drop = ["_pid"] + [f"_loc_{c}" for c in sums] + [f"_tot_{c}" for c in sums] \
        + [f"_before__tot_{c}" for c in sums]
    return out.drop(*drop)


# --- W1 / W2 / W3 ---------------------------------------------------------

def rank_first(df: DataFrame, value: str, tie: Sequence[str], rank_col: str = "rank",
               count_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Global rank by ``value``, ties by ``tie`` (first appearance); nulls unranked."""
    present = df.filter(F.col(value).isNotNull())
    ranked = ordered_positions(present, [value, *tie], pos_col=rank_col,
                               count_col=count_col, num_partitions=num_partitions)
    missing = df.filter(F.col(value).isNull()).withColumn(rank_col, F.lit(None).cast("long"))
    if count_col:
        missing = missing.withColumn(count_col, F.lit(None).cast("long"))
    return ranked.unionByName(missing)


def quantile_bin_expr(rank: str, n: str, q: int = 5) -> Column:
    """Equal-frequency bin (0..q-1) of a 1-based rank among ``n`` ranked rows.

    Same as cutting the ranks at their q-quantiles with right-closed bins
    (``qcut`` on ranks): ``greatest(0, ceil(q*(r-1)/(n-1)) - 1)``, in exact
    integer arithmetic.  n <= 1 or a null rank gives NULL.
    """
    b = F.expr(f"greatest(0, ({q} * (`{rank}` - 1) + `{n}` - 2) div (`{n}` - 1) - 1)")
    return (F.when(F.col(rank).isNull() | (F.col(n) <= 1), F.lit(None))
            .otherwise(b).cast("int"))


def quantile_bins(df: DataFrame, value: str, tie: Sequence[str], q: int = 5,
                  bin_col: str = "bin", num_partitions: int | None = None) -> DataFrame:
    """Rank (first) then q equal-frequency bins; null stays null."""
    ranked = rank_first(df, value, tie, rank_col="_r", count_col="_n",
                        num_partitions=num_partitions)
    return ranked.withColumn(bin_col, quantile_bin_expr("_r", "_n", q)).drop("_r", "_n")


def equal_width_bins(df: DataFrame, value: str, bins: int = 5, bin_col: str = "bin") -> DataFrame:
    """``bins`` equal-width right-closed bins between min and max.

    The two statistics are one aggregate row brought to the driver; a
    constant column lands in the middle bin.
    """
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    x = F.col(value)
    if lo is None:
        return df.withColumn(bin_col, F.lit(None).cast("int"))
    if lo == hi:
        return df.withColumn(bin_col, F.when(x.isNull(), None).otherwise(F.lit(bins // 2)))
    step = (hi - lo) / bins
    edges = [lo + i * step for i in range(1, bins)]
    b = sum((x > F.lit(e)).cast("int") for e in edges)
    return df.withColumn(bin_col, F.when(x.isNull(), None).otherwise(b.cast("int")))


# --- W4 / W5 / W6 ---------------------------------------------------------

def top_k(df: DataFrame, order: Sequence[ColLike], k: int) -> DataFrame:
    """First ``k`` rows in ``order`` (TakeOrderedAndProject: per-task top-k)."""
    return df.orderBy(*_names(order)).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[ColLike], k: int,
                    rank_col: str = "rn", salt_buckets: int = 32,
                    salt_key: Sequence[str] | None = None) -> DataFrame:
    """Top ``k`` rows per group, skew-safe.

    ``row_number() <= k`` lets Spark place a partial ``WindowGroupLimit`` before
    each exchange (a map-side top-k per task), so no more than k rows per group
    leave any map task.  On top, phase 1 keeps the top k inside (group, salt)
    sub-groups, so a hot group's final sort is split over ``salt_buckets`` tasks;
    phase 2 ranks the <= k*salt survivors.  ``order`` must be a total order for a
    deterministic answer.
    """
    keys = salt_key or [c for c in df.columns if c not in by]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*by, "_salt").orderBy(*_names(order))
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*by).orderBy(*_names(order))
    return (pre.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
            .drop("_salt", "_r1"))


def signed_top_k(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], k: int = 5,
                 rank_col: str = "rn", sign_col: str = "sign") -> DataFrame:
    """Per group, the k largest positive and the k most negative values."""
    pos = df.filter(F.col(value) > 0).withColumn(sign_col, F.lit("positive"))
    neg = df.filter(F.col(value) < 0).withColumn(sign_col, F.lit("negative"))
    tp = top_k_per_group(pos, by, [F.col(value).desc(), *tie], k, rank_col, salt_key=list(tie))
    tn = top_k_per_group(neg, by, [F.col(value).asc(), *tie], k, rank_col, salt_key=list(tie))
    return tp.unionByName(tn)
