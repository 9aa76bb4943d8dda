"""Column profiles and class statistics.

Wide statistics are computed in one aggregate over all columns (partial +
final hash aggregation), then unpivoted with ``stack``; distinct counts are
batched so the Expand for several DISTINCT aggregates stays bounded; exact
quantiles come from rank positions (no single task holds a column).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import NUMERIC
from .rank import running_totals


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A1: (column_name, nulls, non_nulls) for every column, one pass."""
    from ..functions.missing import missing_report
    return missing_report(df, columns).select("column_name", "nulls", "non_nulls")


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """A2: counts per value, NULL being its own value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def class_share(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """A3: counts per value and percent of the total (window over the grouped rows only)."""
    vc = value_counts(df, column)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return vc.withColumn("pct", F.round(F.col("n") * 100.0 / total, digits))


def class_ratio(df: DataFrame, label: str, neg=0, pos=1) -> DataFrame:
    """A4: negatives, positives and negatives / positives (NULL if no positives)."""
    return df.agg(F.count_if(F.col(label) == neg).alias("negatives"),
                  F.count_if(F.col(label) == pos).alias("positives")).withColumn(
        "ratio", F.round(F.try_divide(F.col("negatives").cast("double"),
                                      F.nullif(F.col("positives"), F.lit(0))), 6))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    batch: int = 10) -> DataFrame:
    """A5: (column_name, n_distinct) exact, NULL not counted, columns in batches."""
    cols = list(columns or df.columns)
    parts = []
    for i in range(0, len(cols), batch):
        chunk = cols[i:i + batch]
        one = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{j}") for j, c in enumerate(chunk)])
        stack = ", ".join(f"'{c}', d{j}" for j, c in enumerate(chunk))
        parts.append(one.selectExpr(f"stack({len(chunk)}, {stack}) AS (column_name, n_distinct)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n_distinct", F.col("n_distinct").cast("long"))


def bounded_distinct(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """A5, bounded: (column_name, n_distinct) where columns of more than ``limit`` different values (null not counted) give ``limit + 1``.

    One scan for all columns: every task keeps at most ``limit + 1`` values of a
    column, and only those meet.  What is equal under the column's type is one
    value; NaN is a value of its own.
    """
    cols = list(columns or df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set] = [set() for _ in cols]
        for batch in batches:
            for j, column in enumerate(batch.columns):
                if len(held[j]) <= limit:
                    held[j].update(column.unique().drop_null().slice(0, 2 * limit + 2).to_pylist())
        rows = [(c, v) for c, values in zip(cols, held, strict=True) for v in sorted(values)[:limit + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], names=["column_name", "value"])

    # values as hashes, equal where the values are: 0.0 and -0.0 are one
    hashed = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`") + 0 if k in ("double", "float") else F.col(f"`{c}`"))).alias(f"h{j}")
                         for j, (c, k) in enumerate((c, dict(df.dtypes)[c]) for c in cols)])
    seen = hashed.mapInArrow(run, "column_name string, value long").groupBy("column_name").agg(F.collect_set("value").alias("v"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return every.join(seen, "column_name", "left").select(
        "column_name", F.least(F.coalesce(F.size("v"), F.lit(0)), F.lit(limit + 1)).cast("long").alias("n_distinct"))


def any_value(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, has_value)."""
    cols = list(columns or df.columns)
    one = df.agg(*[(F.count(F.col(c)) > 0).alias(f"h{j}") for j, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', h{j}" for j, c in enumerate(cols))
    return one.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, has_value)")


def unpivot_values(df: DataFrame, columns: Sequence[str], cast: str = "double",
                   carry: Sequence[str] = ()) -> DataFrame:
    """(carry..., column_name, value) long form of the listed columns, nulls dropped."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS {cast})" for c in columns)
    return (df.selectExpr(*carry, f"stack({len(columns)}, {stack}) AS (column_name, value)")
            .filter(F.col("value").isNotNull()))


#: Stretches of ranks that a column is cut into, so that ranks and quantile places meet by equality.
RANK_CELLS = 1024


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per column: (column_name, <name>...).

    Rows are first counted by (column, value), so a repeated value is one row;
    running totals over the distinct values give the ranks that each value holds.
    A quantile lies between two ranks; these are looked up by the stretch of ranks
    (one of ``RANK_CELLS`` per column) that they fall into.  The table of wanted
    ranks has at most columns x probs x 2 rows and is broadcast.
    """
    return quantiles_of(unpivot_values(df, columns), probs, names or [f"q{int(p * 100)}" for p in probs])


def quantiles_of(values: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``exact_quantiles`` of the long form (column_name, value)."""
    names = list(names)
    counts = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_totals(counts, ["value"], ["n"], by=["column_name"])
    sizes = ranks.groupBy("column_name").agg(F.max("n_cum").alias("_size"))
    sizes = sizes.withColumn("_width", F.ceil(F.col("_size") / RANK_CELLS))  # one row per column (or column and group)
    grid = sizes.select("column_name", "_size", "_width", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
    h = (F.col("_size") - 1) * F.col("_p")
    grid = grid.select("column_name", "_width", "_i", (F.floor(h) + 1).alias("_lo"), (F.ceil(h) + 1).alias("_hi"), (h - F.floor(h)).alias("_fr"))
    need = grid.select("column_name", F.explode(F.array("_lo", "_hi")).alias("_pos"), "_width").distinct()
    need = need.select("column_name", "_pos", F.expr("(_pos - 1) div _width").alias("_cell"))
    held = (ranks.join(F.broadcast(sizes), "column_name").withColumn("_from", F.col("n_cum") - F.col("n") + 1)
            .withColumn("_cell", F.explode(F.sequence(F.expr("(_from - 1) div _width"), F.expr("(n_cum - 1) div _width")))))
    vals = (held.join(F.broadcast(need), ["column_name", "_cell"]).filter((F.col("_pos") >= F.col("_from")) & (F.col("_pos") <= F.col("n_cum")))
            .select("column_name", "_pos", "value"))
    lo = vals.withColumnRenamed("_pos", "_lo").withColumnRenamed("value", "_vlo")
    hi = vals.withColumnRenamed("_pos", "_hi").withColumnRenamed("value", "_vhi")
    q = (grid.join(lo, ["column_name", "_lo"]).join(hi, ["column_name", "_hi"])
         .select("column_name", "_i", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_fr")).alias("_q")))
    # one row per column and place: bounded by columns x probs
    packed = q.groupBy("column_name").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_q"))).alias("_qs"))
    return packed.select("column_name", *[F.try_element_at("_qs", F.lit(i)).alias(nm) for i, nm in enumerate(names)])


def describe_all(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Per column count, unique, top, freq (text) and mean, std, min, quartiles, max (numbers)."""
    cols = list(columns or df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c in cols if isinstance(fields[c], NUMERIC)]
    texts = [c for c in cols if isinstance(fields[c], T.StringType)]
    parts = []
    if nums:
        aggs = []
        for j, c in enumerate(nums):
            x = F.col(c).cast("double")
            aggs += [F.count(x).alias(f"c{j}"), F.avg(x).alias(f"m{j}"), F.stddev_samp(x).alias(f"s{j}"),
                     F.min(x).alias(f"lo{j}"), F.max(x).alias(f"hi{j}")]
        one = df.agg(*aggs)
        stack = ", ".join(f"'{c}', c{j}, m{j}, s{j}, lo{j}, hi{j}" for j, c in enumerate(nums))
        basic = one.selectExpr(
            f"stack({len(nums)}, {stack}) AS (column_name, count, mean, std, min, max)")
        qs = exact_quantiles(df, nums, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
        num = basic.join(qs, "column_name", "left").select(
            "column_name", F.col("count").cast("long").alias("count"),
            F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq"),
            *[F.round(F.col(c), digits).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])
        parts.append(num)
    if texts:
        stack = ", ".join(f"'{c}', `{c}`" for c in texts)
        long = df.selectExpr(f"stack({len(texts)}, {stack}) AS (column_name, value)")
        per_value = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
            F.count(F.lit(1)).alias("cnt"))
        top = per_value.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("value"))).alias("_t"))
        counts = long.groupBy("column_name").agg(F.count("value").alias("count"))
        txt = counts.join(top, "column_name", "left").select(
            "column_name", F.col("count").cast("long").alias("count"),
            F.col("unique").cast("long").alias("unique"), F.col("_t.value").alias("top"),
            (-F.col("_t.neg")).cast("long").alias("freq"),
            *[F.lit(None).cast("double").alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])
        parts.append(txt)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split."""
    return value_counts(df, split)
