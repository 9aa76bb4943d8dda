"""Scans and sinks.

Tables move between stages as Parquet partitioned by the cycle column (so a
cycle filter prunes folders), or as CSV with an explicit schema (no inference
pass).  Component files live under ``<root>/cycle=<c>/<PREFIX>...``, one per
prefix and cycle; the folder names give ``cycle``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Overwrite or append a table; CSV gets a header, text kept verbatim."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)


def write_with_summary(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                       partition_by: Sequence[str] = (), counted: Sequence[str] = ()) -> dict:
    """S6 + A8: write a table, then summarise what was written (rows, columns,
    non-null counts of ``counted``) with one aggregate over the written columnar
    table (row counts come from file footers)."""
    write_table(df, path, fmt, mode, partition_by)
    written = read_table(df.sparkSession, path, fmt)
    row = written.agg(F.count(F.lit(1)).alias("rows"),
                      *[F.count(F.col(c)).alias(f"non_null_{c}") for c in counted]).first()
    out = row.asDict()
    out["cols"] = len(df.columns)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV scan with header and an explicit schema."""
    return (spark.read.schema(schema).option("header", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(path)


def write_components(df: DataFrame, root: str, groups: dict[str, Sequence[str]], key: str,
                     cycle: str = "cycle", filters: dict[str, str] | None = None) -> None:
    """Split a wide frame into component tables ``<root>/<PREFIX>/cycle=<c>/``.

    One partitioned write per component.  ``filters`` may give a SQL predicate
    per prefix so components cover different respondents, as real ones do.
    """
    for prefix, cols in groups.items():
        part = df.filter(filters[prefix]) if filters and prefix in filters else df
        part.select(key, *cols, cycle).write.mode("overwrite").partitionBy(cycle).parquet(f"{root}/{prefix}")


def _listed(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, path, is a folder) of a folder's entries by name; none if the folder does not exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted((s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(at))


def _component_file(entries: list[tuple[str, str, bool]], prefix: str) -> tuple[str, str] | None:
    """(path, format) of the one entry that holds the component: its name in any letter case is the prefix,
    or the prefix and ``_<release>``; the plain name first, then by name.  A folder is Parquet."""
    found = []
    for name, path, folder in entries:
        stem, dot, ext = (name, "", "parquet") if folder and "." not in name else name.rpartition(".")
        stem, ext = stem.upper(), ext.lower()
        if ext in ("parquet", "csv") and (stem == prefix or stem.startswith(f"{prefix}_")):
            found.append((stem != prefix, stem, path, ext))
    return min(found)[2:] if found else None


def _common_types(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Frames whose columns of one name have one type: numbers of different types become double, others string."""
    kinds: dict[str, set] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType)
    to = {c: "double" if all(isinstance(k, T.NumericType) for k in ks) else "string" for c, ks in kinds.items() if len(ks) > 1}
    return [f.withColumns({c: F.col(c).cast(to[c]) for c in f.columns if c in to}) for f in frames]


def read_component(spark: SparkSession, root: str, prefix: str) -> DataFrame | None:
    """All cycles of one component, ``cycle`` from the folder names; None if no cycle has it.

    Accepts the survey layout, one file ``<root>/cycle=<c>/<PREFIX>[_<release>].parquet`` or ``.csv``
    per cycle in any letter case (CSV columns are read as text), and the partitioned layout
    ``<root>/<PREFIX>/cycle=<c>/``.  Columns that only some cycles have are NULL in the others;
    a file that cannot be read raises.
    """
    p = prefix.upper()
    entries = _listed(spark, root)
    whole = [path for name, path, folder in entries if folder and name.upper() == p]
    if whole:
        return spark.read.option("mergeSchema", True).parquet(whole[0])
    frames = []
    for name, path, folder in entries:
        if not folder or not name.startswith("cycle="):
            continue
        found = _component_file(_listed(spark, path), p)
        if found:
            one = spark.read.option("header", True).csv(found[0]) if found[1] == "csv" else spark.read.parquet(found[0])
            frames.append(one.withColumn("cycle", F.lit(name[len("cycle="):])))
    if not frames:
        return None
    frames = _common_types(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def load_components(spark: SparkSession, root: str, prefixes: Sequence[str]) -> dict[str, DataFrame]:
    """Every present component with its ``cycle`` tag; error if none load."""
    out = {}
    for p in prefixes:
        df = read_component(spark, root, p)
        if df is not None:
            out[p] = df
    if not out:
        raise RuntimeError(f"no component found under {root}")
    return out
