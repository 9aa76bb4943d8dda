"""Projection and schema operators.

Presence questions are answered from ``df.columns`` on the driver before the
plan is built, so every result is one static Catalyst plan; nothing scans data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def resolve(df: DataFrame, aliases: Sequence[str], ignore_case: bool = False) -> str | None:
    """First alias present in the schema (not the first non-null value)."""
    cols = list(df.columns)
    if ignore_case:
        upper = {}
        for c in cols:
            upper.setdefault(c.upper(), c)
        for a in aliases:
            if a.upper() in upper:
                return upper[a.upper()]
        return None
    for a in aliases:
        if a in cols:
            return a
    return None


def column_or_default(df: DataFrame, aliases: Sequence[str], default=None,
                      dtype: str = "double", ignore_case: bool = False) -> Column:
    """P1+P2: the resolved column, else a literal default of ``dtype``."""
    name = resolve(df, aliases, ignore_case)
    if name is None:
        return F.lit(default).cast(dtype)
    return F.col(name)


def columns_with_prefix(df: DataFrame, prefixes: Iterable[str] = (),
                        contains: Iterable[str] = (), ignore_case: bool = True) -> list[str]:
    """Columns whose name starts with a prefix or contains a substring."""
    pre = [p.upper() if ignore_case else p for p in prefixes]
    sub = [s.upper() if ignore_case else s for s in contains]
    out = []
    for c in df.columns:
        n = c.upper() if ignore_case else c
        if any(n.startswith(p) for p in pre) or any(s in n for s in sub):
            out.append(c)
    return out


def columns_of_type(df: DataFrame, kinds: Sequence[type] = NUMERIC,
                    exclude: Sequence[type] = ()) -> list[str]:
    """Columns whose Spark type is one of ``kinds``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, tuple(kinds)) and not isinstance(f.dataType, tuple(exclude) or ())]


def drop_ignore(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """P5: drop columns; names that are absent are ignored."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present)


def project_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Ordered projection to ``wanted``, keeping those that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def project_required(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Ordered projection that fails when a wanted column is missing."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*wanted)


#: A decimal number: the cast alone would also take ``1d``, ``7F`` and ``NaN``.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def lenient_double(c: str | Column) -> Column:
    """Coerce to double; text that is no decimal number -> NULL (so never NaN)."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def numeric_of(df: DataFrame, name: str | None) -> Column:
    """P8 with the schema at hand: numeric columns are cast (NaN -> NULL) without a
    text round trip; text columns are parsed leniently; absent -> NULL."""
    if name is None or name not in df.columns:
        return F.lit(None).cast("double")
    if isinstance(df.schema[name].dataType, NUMERIC):
        v = F.col(name).cast("double")
        return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    return lenient_double(name)


def strict_double(c: str | Column) -> Column:
    """Cast to double; with ANSI on, bad text raises."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double")


def remap(c: str | Column, mapping: Mapping, value_type: str = "string") -> Column:
    """P10: dictionary remap of codes; unmatched -> NULL."""
    col = F.col(c) if isinstance(c, str) else c
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v).cast(value_type)]
    return F.try_element_at(F.create_map(*pairs), col)


def column_audit(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """S3: (column_name, present) for a wanted list, case-insensitive; no scan."""
    have = {c.upper() for c in df.columns}
    rows = [(w, w.upper() in have) for w in wanted]
    schema = "column_name string, present boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def unit_fallback(df: DataFrame, primary: Sequence[str], fallback: Sequence[str],
                  factor: float) -> Column:
    """First ``primary`` column present, else first ``fallback`` column x ``factor``."""
    p = resolve(df, primary)
    if p is not None:
        return numeric_of(df, p)
    f = resolve(df, fallback)
    if f is not None:
        return numeric_of(df, f) * F.lit(factor)
    return F.lit(None).cast("double")
