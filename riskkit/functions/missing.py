"""Missing-value rewrites and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import NUMERIC

# Survey skip codes that mean "missing".
SKIP_TEXT_CODES = ["", " ", "NA", "N/A", "nan", "None",
                   "999999", "99999", "9999", "999", "99", "9",
                   "777777", "77777", "7777", "777", "77", "7"]
SKIP_NUMERIC_CODES = [7, 9, 77, 99, 777, 999, 7777, 9999, 77777, 99999, 777777, 999999]


def filter_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """keep rows whose ``column`` is one of ``values``."""
    return df.filter(F.col(column).isin(list(values)))


def require_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """study population - all listed columns present (not null)."""
    return df.dropna(how="any", subset=list(columns))


def drop_missing_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """drop rows missing any of the listed columns that exist."""
    present = [c for c in columns if c in df.columns]
    return df.dropna(how="any", subset=present) if present else df


def labelled_only(df: DataFrame, label: str, as_int: bool = True) -> DataFrame:
    """drop rows with a null label; cast the label to int."""
    out = df.filter(F.col(label).isNotNull())
    return out.withColumn(label, F.col(label).cast("int")) if as_int else out


def between(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """closed range filter."""
    return df.filter(F.col(column).between(lo, hi))


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def null_text_codes(df: DataFrame, columns: Sequence[str] | None = None,
                    codes: Sequence[str] = SKIP_TEXT_CODES) -> DataFrame:
    """exact text skip codes -> NULL on string columns (all by default)."""
    cols = set(columns if columns is not None else _string_columns(df))
    return df.select(*[
        F.when(F.col(c).isin(list(codes)), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def null_numeric_codes(df: DataFrame, columns: Sequence[str] | str,
                       codes: Sequence[float] = SKIP_NUMERIC_CODES,
                       exclude: Sequence[str] = ()) -> DataFrame:
    """numeric skip codes -> NULL.

    ``columns`` names the questionnaire columns to clean; ``"all"`` cleans every
    numeric column except ``exclude`` (keys), which also nulls real measures
    equal to a code.
    """
    if columns == "all":
        cols = {f.name for f in df.schema.fields
                if isinstance(f.dataType, NUMERIC) and f.name not in exclude}
    else:
        cols = set(columns)
    return df.select(*[
        F.when(F.col(c).isin(list(codes)), F.lit(None)).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def zero_to_null(c: str | Column) -> Column:
    """F8: 0 -> NULL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(col, F.lit(0))


def missing_report(df: DataFrame, columns: Sequence[str] | None = None,
                   threshold: float = 0.4) -> DataFrame:
    """(column_name, nulls, non_nulls, missing_ratio, dropped).

    One aggregate pass over all columns (partial + final aggregation), then
    unpivoted.  The ratio is nulls / non-nulls; all-null columns get an
    infinite ratio and are dropped.
    """
    cols = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"nn_{i}")
                                                     for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', nn_{i}" for i, c in enumerate(cols))
    long = one.selectExpr("_rows", f"stack({len(cols)}, {stack}) AS (column_name, non_nulls)")
    long = long.withColumn("nulls", (F.col("_rows") - F.col("non_nulls")).cast("long"))
    ratio = F.when(F.col("non_nulls") == 0, F.lit(float("inf"))).otherwise(
        F.col("nulls") / F.col("non_nulls"))
    return long.select(
        "column_name", "nulls", F.col("non_nulls").cast("long").alias("non_nulls"),
        F.round(ratio, 6).alias("missing_ratio"), (ratio > threshold).alias("dropped"))


def drop_high_missing(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """drop columns whose nulls / non-nulls exceeds ``threshold``."""
    report = missing_report(df, threshold=threshold).filter("dropped").select("column_name")
    gone = [r[0] for r in report.collect()]  # one name per column: schema-sized
    return df.drop(*gone)
