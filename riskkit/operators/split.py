"""Splits, leakage control and feature routing (M1-M5).

The stratified split is exact and repeatable: inside each stratum rows are
ordered by ``md5(seed:id)`` and the first ``floor(frac*n)`` go to the held-out
side.  Ordering a stratum normally means one window partition per stratum
(two tasks for a binary label); here positions come from range partitioning
(``ordered_positions``), so a stratum holding most rows still spreads out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..functions.schema import NUMERIC, columns_with_prefix
from .rank import ordered_positions

# Year ranges of the temporal split.
TEMPORAL_SPLITS = [("train", 2011, 2014), ("val", 2015, 2016), ("test", 2017, 2018)]


def temporal_split(df: DataFrame, year: str = "YEAR_START", out: str = "split",
                   ranges=TEMPORAL_SPLITS) -> DataFrame:
    """M1: split label from the year; other years -> NULL."""
    expr = None
    for name, lo, hi in ranges:
        cond = F.col(year).between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn(out, expr)


def hash_order(key: str, seed: int) -> F.Column:
    """Repeatable pseudo-random order key: md5 of ``'<seed>:<id>'``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_positions(df: DataFrame, key: str, strata: Sequence[str], seed: int = 42,
                         pos: str = "_pos", n: str = "_n") -> DataFrame:
    """1-based position of each row inside its stratum in hash order, plus stratum size."""
    h = df.withColumn("_h", hash_order(key, seed))
    return ordered_positions(h, ["_h", key], by=list(strata), pos_col=pos, count_col=n).drop("_h")


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], test_frac: float = 0.2,
                     seed: int = 42, out: str = "split", names=("train", "test")) -> DataFrame:
    """M2: exact stratified split; ``floor(test_frac * n)`` rows per stratum are held out."""
    p = stratified_positions(df, key, strata, seed)
    held = F.col("_pos") <= F.floor(F.lit(test_frac) * F.col("_n"))
    return p.withColumn(out, F.when(held, F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_pos", "_n")


def stratified_split_multi(df: DataFrame, key: str, strata: Sequence[str],
                           fractions: Sequence[tuple[str, float]] = (("test", 0.2), ("val", 0.2)),
                           rest: str = "train", seed: int = 42, out: str = "split") -> DataFrame:
    """M2, any number of parts: inside each stratum, in hash order, the first
    ``floor(f1*n)`` rows get the first name, the next ``floor((f1+f2)*n) - floor(f1*n)``
    the second, and so on; the remainder is ``rest`` (e.g. 60/20/20)."""
    p = stratified_positions(df, key, strata, seed)
    expr, cum = None, 0.0
    for name, frac in fractions:
        cum += frac
        cond = F.col("_pos") <= F.floor(F.lit(cum) * F.col("_n"))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return p.withColumn(out, expr.otherwise(F.lit(rest))).drop("_pos", "_n")


def stratified_folds(df: DataFrame, key: str, strata: Sequence[str], k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """M3: stratified k-fold ids 0..k-1 (position modulo k inside each stratum)."""
    p = stratified_positions(df, key, strata, seed)
    return p.withColumn(out, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos", "_n")


# Leakage columns of the feature tables.
LEAK_COLUMNS = ["A1C", "GLUCOSE", "INSULIN", "HOMA_IR", "DIQ_FLAG", "DIABETES_BIN",
                "DIABETES_3CLASS", "ON_RX"]
LEAK_PREFIXES = ["DIQ", "RX"]


def exclude_leaky(df: DataFrame, names: Sequence[str] = LEAK_COLUMNS,
                  prefixes: Sequence[str] = LEAK_PREFIXES, keep: Sequence[str] = ()) -> DataFrame:
    """M4: drop listed leakage columns and any column with a leaky prefix (``keep`` spared)."""
    gone = set(c for c in names if c in df.columns) | set(columns_with_prefix(df, prefixes))
    return df.drop(*[c for c in gone if c not in keep])


def feature_routing(df: DataFrame, exclude: Sequence[str] = (), threshold: int = 10, exact: bool = True) -> DataFrame:
    """M5: (column_name, n_distinct, role): numeric if numeric type and > threshold
    distinct values, categorical otherwise, dropped if constant (<= 1 distinct).
    Without ``exact`` counting stops at ``threshold + 1``: one scan for all columns, the same roles."""
    from .profile import bounded_distinct, distinct_counts
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if c not in exclude]
    dc = distinct_counts(df, cols) if exact else bounded_distinct(df, cols, threshold)
    numeric = [c for c in cols if isinstance(fields[c], NUMERIC)]
    is_num = F.col("column_name").isin(numeric) if numeric else F.lit(False)
    role = (F.when(F.col("n_distinct") <= 1, F.lit("dropped"))
            .when(is_num & (F.col("n_distinct") > threshold), F.lit("numeric"))
            .otherwise(F.lit("categorical")))
    return dc.withColumn("role", role)


def routed_columns(routing: DataFrame) -> tuple[list[str], list[str]]:
    """Driver-side lists (numeric, categorical) from a routing table (one row per column)."""
    rows = routing.collect()
    num = [r["column_name"] for r in rows if r["role"] == "numeric"]
    cat = [r["column_name"] for r in rows if r["role"] == "categorical"]
    return num, cat
