"""Leak-safe preprocessing (M6-M14) as Spark ML stages.

Every stage is fitted on training rows only and applied everywhere.  Fitted
state is schema-sized (one value per column, a level list, a quantile grid or a
coefficient vector), is brought to the driver, stored as a JSON param (so the
stages persist with ``Pipeline.write``) and applied as plain column
expressions, which keeps scoring inside whole-stage codegen.
"""

from __future__ import annotations

import json

from collections.abc import Sequence

import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .profile import exact_quantiles, quantiles_of, unpivot_values
from .rank import ordered_positions


class _HasState(Params):
    state = Param(Params._dummy(), "state", "fitted state (JSON)", typeConverter=TypeConverters.toString)

    def get_state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class _Stage(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _cols(self) -> list[str]:
        return list(self.getOrDefault(self.inputCols))


# --- M6 / M7: exact imputers ---------------------------------------------------

def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values for even counts)."""
    if not cols:
        return {}
    rows = exact_quantiles(df, cols, [0.5], ["median"]).collect()
    got = {r["column_name"]: r["median"] for r in rows}
    return {c: got.get(c) for c in cols}


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column; ties -> smallest value.

    Unpivots to (column, value), counts with a partial aggregate, keeps one
    value per column.  Numeric and text columns are ranked in their own type.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for kind, cast in (("num", "double"), ("txt", "string")):
        group = [c for c in cols if (isinstance(fields[c], T.StringType)) == (kind == "txt")]
        if not group:
            continue
        stack = ", ".join(f"'{c}', CAST(`{c}` AS {cast})" for c in group)
        long = df.selectExpr(f"stack({len(group)}, {stack}) AS (column_name, value)").filter("value IS NOT NULL")
        counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
        best = counts.groupBy("column_name").agg(
            F.min(F.struct((-F.col("cnt")).alias("n"), F.col("value").alias("v"))).alias("b"))
        for r in best.collect():  # one row per column
            out[r["column_name"]] = r["b"]["v"]
    return {c: out.get(c) for c in cols}


def approximate_medians(df: DataFrame, cols: Sequence[str], k: int = 400) -> dict[str, float | None]:
    """Medians by mergeable rank sketches (KLL): one scan, and a few kilobytes a column and task.

    ``k`` sets the size of a sketch; at 400 the rank of the answer is within
    about 0.7 % of the middle with 99 % confidence.  An answer is a value of the column.
    """
    if not cols:
        return {}
    row = df.agg(*[F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), k), F.lit(0.5)).alias(f"m{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def group_medians(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Exact medians of every group: (by..., <col>...); null keys are a group.

    Ranks are made over (column and group, value), so a group that holds most rows is spread like any other.
    """
    key = F.to_json(F.struct(*[F.col(f"`{b}`") for b in by]))
    long = unpivot_values(df.withColumn("_group", key), cols, carry=["_group"])
    got = quantiles_of(long.select(F.to_json(F.struct(F.col("_group").alias("g"), F.col("column_name").alias("c"))).alias("column_name"), "value"), [0.5], ["median"])
    # back to one row a group: at most one value a column
    parts = got.select(F.get_json_object("column_name", "$.g").alias("_group"), F.get_json_object("column_name", "$.c").alias("c"), "median")
    wide = parts.groupBy("_group").agg(*[F.max(F.when(F.col("c") == c, F.col("median"))).alias(c) for c in cols])
    keys = df.select(*[F.col(f"`{b}`") for b in by], key.alias("_group")).distinct()
    return keys.join(wide, "_group", "left").drop("_group")


class ExactImputer(Estimator, _Stage):
    """Fill NULLs with the training median (default), mean, most frequent value, or approximate median."""

    strategy = Param(Params._dummy(), "strategy", "median | approx_median | mean | most_frequent",
                     typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, strategy="median"):
        super().__init__()
        self._setDefault(strategy="median")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ExactImputerModel":
        cols = self._cols()
        how = self.getOrDefault(self.strategy)
        if how == "median":
            values = column_medians(df, cols)
        elif how == "approx_median":
            values = approximate_medians(df, cols)
        elif how == "mean":
            row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
            values = {c: row[c] for c in cols}
        else:
            values = column_modes(df, cols)
        return ExactImputerModel(inputCols=cols, state=json.dumps(values))


class ExactImputerModel(Model, _Stage, _HasState):
    @keyword_only
    def __init__(self, *, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        values = self.get_state()
        return df.select(*[F.coalesce(F.col(c), F.lit(values[c]).cast(df.schema[c].dataType)).alias(c)
                           if c in values and values[c] is not None else F.col(c) for c in df.columns])


# --- M9: population-std scaler ------------------------------------------------------

class PopulationScaler(Estimator, _Stage):
    """(x - mean) / population std from training rows; zero std -> scale 1; NULL stays NULL."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self._cols()
        row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
        st = {c: [row[f"m_{i}"], row[f"s_{i}"] if row[f"s_{i}"] else 1.0] for i, c in enumerate(cols)}
        return PopulationScalerModel(inputCols=cols, state=json.dumps(st))


class PopulationScalerModel(Model, _Stage, _HasState):
    @keyword_only
    def __init__(self, *, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.get_state()
        return df.select(*[((F.col(c) - F.lit(st[c][0] or 0.0)) / F.lit(st[c][1])).alias(c)
                           if c in st else F.col(c) for c in df.columns])


# --- fitted tables (S9) --------------------------------------------------------------------

class _TableWriter(DefaultParamsWriter):
    """Saves a stage's table inside the stage's own folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table().write.parquet(f"{path.rstrip('/')}/table")


class _TableReader(DefaultParamsReader):
    """Loads a stage whose table lies in its folder."""

    def load(self, path: str):
        stage = super().load(path)
        stage._set(state=json.dumps({"table": f"{path.rstrip('/')}/table"}))
        return stage


class _HasTable(_HasState):
    """A fitted stage whose state is a table: in the shared folder once fitted, in the model's folder once loaded."""

    def table(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.get_state()["table"])

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)


def _level_table(df: DataFrame, cols: Sequence[str]) -> str:
    """Folder of (column_name, level, code): every column's sorted levels -> 0 .. n-1; any number of levels."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in cols}
    levels = None
    for kind in sorted(set(kinds.values())):  # levels sort in their own type
        group = [c for c in cols if kinds[c] == kind]
        stack = ", ".join(f"'{c}', `{c}`" for c in group)
        long = df.selectExpr(f"stack({len(group)}, {stack}) AS (column_name, level)").filter("level IS NOT NULL").distinct()
        placed = ordered_positions(long, ["level"], by=["column_name"], pos_col="code")
        part = placed.select("column_name", F.col("level").cast("string").alias("level"), (F.col("code") - 1).cast("int").alias("code"))
        levels = part if levels is None else levels.unionByName(part)
    path = scratch_path(df.sparkSession, "levels")
    levels.write.parquet(path)
    return path


def _coded(df: DataFrame, levels: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with every column's code (null where the level is unknown) joined on."""
    out = df
    for i, c in enumerate(cols):
        own = levels.filter(F.col("column_name") == c).select(F.col("level").alias(f"_l{i}"), F.col("code").alias(f"_c{i}"))
        out = out.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_l{i}"), "left")
    return out, [F.col(f"_c{i}") for i in range(len(cols))]


# --- M11: ordinal encoder --------------------------------------------------------------

class OrdinalEncoder(Estimator, _Stage):
    """Sorted training levels -> 0..n-1; unknown -> -1; NULL stays NULL (in place, int).

    The levels of all columns are one table (column, level, code), made by one
    job; applying it joins it to the rows, so any number of levels will do.  A
    saved model carries the table.
    """

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OrdinalEncoderModel":
        return OrdinalEncoderModel(inputCols=self._cols(), state=json.dumps({"table": _level_table(df, self._cols())}))


class OrdinalEncoderModel(_HasTable, Model, _Stage):
    @keyword_only
    def __init__(self, *, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out, codes = _coded(df, self.table(), self._cols())
        made = {c: F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(code, F.lit(-1))).cast("int").alias(c) for c, code in zip(self._cols(), codes, strict=True)}
        return out.select(*[made.get(c, F.col(f"`{c}`")) for c in df.columns])


# --- M10: one-hot ---------------------------------------------------------------------------

class LevelIndexer(Estimator, _Stage):
    """Adds ``<col>_idx``: the place of a level among the sorted training levels, the number of levels for unknown and NULL."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LevelIndexerModel":
        return LevelIndexerModel(inputCols=self._cols(), state=json.dumps({"table": _level_table(df, self._cols())}))


class LevelIndexerModel(_HasTable, Model, _Stage):
    @keyword_only
    def __init__(self, *, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        levels = self.table()
        sizes = {r["column_name"]: r["n"] for r in levels.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
        out, codes = _coded(df, levels, self._cols())
        # the encoder learns from the column's metadata how many places there are, the one for unknown included
        about = {c: {"ml_attr": {"type": "nominal", "name": f"{c}_idx", "num_vals": sizes.get(c, 0) + 1}} for c in self._cols()}
        made = [F.coalesce(code, F.lit(sizes.get(c, 0))).cast("double").alias(f"{c}_idx", metadata=about[c]) for c, code in zip(self._cols(), codes, strict=True)]
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *made)


def one_hot_table_stages(cols: Sequence[str], suffix: str = "_ohe"):
    """One-hot sparse vectors from a joined level table: no list of levels on the driver.

    Unknown and NULL encode as the all-zero vector (their place is the last one, which is dropped).
    """
    from pyspark.ml.feature import OneHotEncoder
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}{suffix}" for c in cols], dropLast=True)
    return [LevelIndexer(inputCols=list(cols)), ohe]


def one_hot_stages(cols: Sequence[str], suffix: str = "_ohe"):
    """StringIndexer (sorted levels, unknown/NULL kept as an extra index) + OneHotEncoder
    (last slot dropped), so unknown and NULL both encode as the all-zero vector.  Slots are
    named after their levels, which the driver holds; ``one_hot_table_stages`` is for many."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}{suffix}" for c in cols],
                        dropLast=True)
    return [idx, ohe]


def hot_index(vec_col: str) -> Column:
    """Index of the 1 in a one-hot vector, NULL for the all-zero vector."""
    from pyspark.ml.functions import vector_to_array
    pos = F.array_position(vector_to_array(F.col(vec_col)), F.lit(1.0))
    return F.when(pos == 0, F.lit(None)).otherwise(pos - 1).cast("int")


# --- D7 / V13: quantile bins fitted on training rows -------------------------------------

class QuantileBinner(Estimator, _Stage):
    """q equal-frequency bins whose edges are exact training quantiles (linear
    interpolation); applied as right-closed bins (``x <= edge_1`` -> 0, ...), so
    validation and test rows use the training edges.  NULL stays NULL."""

    q = Param(Params._dummy(), "q", "number of bins", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, q=5):
        super().__init__()
        self._setDefault(q=5)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "QuantileBinnerModel":
        k = self.getOrDefault(self.q)
        probs = [i / k for i in range(1, k)]
        names = [f"e{i}" for i in range(1, k)]
        rows = exact_quantiles(df, self._cols(), probs, names).collect()
        edges = {r["column_name"]: [r[n] for n in names] for r in rows}
        return QuantileBinnerModel(inputCols=self._cols(), state=json.dumps(edges))


class QuantileBinnerModel(Model, _Stage, _HasState):
    @keyword_only
    def __init__(self, *, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        edges = self.get_state()
        out = [F.col(c) for c in df.columns]
        for c, es in edges.items():
            b = sum(((F.col(c) > F.lit(e)).cast("int") for e in es), F.lit(0))
            out.append(F.when(F.col(c).isNull(), F.lit(None).cast("int")).otherwise(b).alias(f"{c}_bin"))
        return df.select(*out)


# --- M14: balanced class weights ----------------------------------------------------------

def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """weight = n / (k * n_class) with k classes present (counts are a small aggregate)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    n, k = sum(counts.values()), len(counts)
    pairs = []
    for cls, cnt in counts.items():
        if cls is not None:
            pairs += [F.lit(cls), F.lit(n / (k * cnt))]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(label)))


# --- M12: quantile transform to a normal ------------------------------------------------------

# Coefficients of a published rational approximation of the
# inverse standard normal CDF (Acklam), relative error about 1e-9.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549671035006309e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def inverse_normal(p):
    """Standard normal quantiles of an array of numbers in (0, 1)."""
    import numpy as np
    tail = np.minimum(p, 1 - p)
    q = np.sqrt(-2 * np.log(tail))
    outer = np.polyval(_C, q) / (np.polyval(_D, q) * q + 1)
    mid = p - 0.5
    r = mid * mid
    central = np.polyval(_A, r) * mid / (np.polyval(_B, r) * r + 1)
    return np.where(tail < 0.02425, np.where(p < 0.5, outer, -outer), central)


def interpolated(x, grid, ref):
    """Piecewise-linear ref(x) through the sorted ``grid``, clamped; NaN stays NaN.

    A value equal to a run of repeated grid points maps to the midpoint of their references.
    """
    import numpy as np
    below, upto = np.searchsorted(grid, x, "left"), np.searchsorted(grid, x, "right")
    k = len(grid)
    lo, hi = np.clip(below - 1, 0, k - 1), np.clip(below, 0, k - 1)
    gap = np.where(grid[hi] > grid[lo], grid[hi] - grid[lo], 1.0)
    y = ref[lo] + (x - grid[lo]) * (ref[hi] - ref[lo]) / gap
    y = np.where(upto > below, (ref[np.clip(below, 0, k - 1)] + ref[np.clip(upto - 1, 0, k - 1)]) / 2, y)
    y = np.where((upto <= below) & (below == 0), ref[0], np.where((upto <= below) & (below >= k), ref[-1], y))
    return np.where(np.isnan(x), np.nan, y)


class QuantileNormal(Estimator, _Stage):
    """Map each column through its training CDF (``nQuantiles`` exact grid points) to a
    standard normal; values are clipped to [1e-7, 1 - 1e-7] before the inverse CDF."""

    nQuantiles = Param(Params._dummy(), "nQuantiles", "grid size", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, nQuantiles=1000):
        super().__init__()
        self._setDefault(nQuantiles=1000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "QuantileNormalModel":
        k = self.getOrDefault(self.nQuantiles)
        refs = [i / (k - 1) for i in range(k)]
        names = [f"g{i}" for i in range(k)]
        rows = exact_quantiles(df, self._cols(), refs, names).collect()
        grid = {r["column_name"]: [r[n] for n in names] for r in rows}
        return QuantileNormalModel(inputCols=self._cols(), state=json.dumps({"refs": refs, "grid": grid}))


class QuantileNormalModel(Model, _Stage, _HasState):
    @keyword_only
    def __init__(self, *, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.get_state()
        cols = [c for c in df.columns if st["grid"].get(c) and st["grid"][c][0] is not None]
        blank = [c for c in df.columns if c in st["grid"] and c not in cols]  # nothing but nulls in training
        if cols:
            run = _normal_columns([st["grid"][c] for c in cols], st["refs"])
            made = F.arrow_udf(run, ", ".join(f"q{i} double" for i in range(len(cols))))(*[F.col(f"`{c}`").cast("double") for c in cols])
            df = df.withColumn("_normal", made)
        place = {c: i for i, c in enumerate(cols)}
        return df.select(*[F.col(f"_normal.q{place[c]}").alias(c) if c in place else F.lit(None).cast("double").alias(c) if c in blank
                           else F.col(f"`{c}`") for c in df.columns if c != "_normal"])


def _normal_columns(grids: list, refs: list):
    """All columns through their grids to a standard normal, in one pass over a batch."""
    def run(*columns: pa.Array) -> pa.Array:
        import numpy as np
        out = []
        for column, grid in zip(columns, grids, strict=True):
            x = np.array(column.fill_null(float("nan")), np.float64)
            y = inverse_normal(np.clip(interpolated(x, np.array(grid), np.array(refs)), 1e-7, 1 - 1e-7))
            out.append(pa.array(y, mask=np.isnan(x)))
        return pa.StructArray.from_arrays(out, names=[f"q{i}" for i in range(len(out))])

    return run


# --- M8: chained-equation imputation ---------------------------------------------------------
#
# Rows that lack the same columns (a pattern) are filled alike: every filled value is one affine
# function of the row's observed values.  A pattern is therefore known by the sums of products of
# its observed values, and all rounds run on those small matrices after one scan of the rows.

#: Patterns of missing values up to which their sums are brought to the driver (p x p numbers each).
MAX_PATTERNS = 1 << 14


def pattern_sums(df: DataFrame, cols: Sequence[str]):
    """One scan: {mask of observed columns: (p + 1) x (p + 1) sums of products of (1, x), missing as 0}."""
    import numpy as np
    p = len(cols)
    xs = [F.lit(1.0), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols]]
    mask = sum((F.when(F.col(f"`{c}`").isNotNull(), F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(cols)), F.lit(0).cast("long"))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    per = df.select(mask.alias("_mask"), *[x.alias(f"_x{i}") for i, x in enumerate(xs)]).groupBy("_mask").agg(
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    out = {}
    for r in per.limit(MAX_PATTERNS + 1).collect():
        m = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r["_mask"]] = m
    if len(out) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of missing values: impute fewer columns at a time")
    return out


def least_squares(n: float, mean_x, mean_y: float, xx, xy, yy: float, ridge: float):
    """Coefficients from centred sums, with an L2 penalty (the least-norm ones where they are not unique)."""
    import numpy as np
    return np.linalg.lstsq(xx + ridge * np.eye(len(xx)), xy, rcond=None)[0]


def bayesian_ridge(n: float, mean_x, mean_y: float, xx, xy, yy: float, ridge: float, rounds: int = 300, tol: float = 1e-3):
    """Coefficients of largest evidence: precisions of the noise and of the weights re-estimated in turn (flat gamma priors)."""
    import numpy as np
    small = 1e-6
    value, vector = np.linalg.eigh(xx)
    value = np.maximum(value, 0.0)
    along = vector.T @ xy
    noise, weight, old = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None
    for _ in range(rounds):
        coef = vector @ (along / (value + weight / noise))
        if old is not None and np.abs(coef - old).sum() < tol:
            break
        rest = max(yy - 2 * coef @ xy + coef @ xx @ coef, 0.0)
        known = (noise * value / (weight + noise * value)).sum()
        weight, noise, old = (known + 2 * small) / (coef @ coef + 2 * small), (n - known + 2 * small) / (rest + 2 * small), coef
    return coef


def _refill(maps, mask_bits, step, p: int) -> None:
    """Put the affine map of a step's target into every pattern that lacks it; ``maps``: patterns x (p + 1) x (p + 1)."""
    c = step["col"]
    lacks = ~mask_bits[:, c]
    beta = step["beta"]  # intercept, then one a column (0 for the target)
    maps[lacks, c + 1] = beta[0] * maps[lacks, 0] + (maps[lacks, 1:] * beta[1:, None]).sum(1)


def _start_maps(masks, means, p: int):
    """Observed values as they are, the others at their means."""
    import numpy as np
    bits = (np.array(masks, dtype=np.int64)[:, None] >> np.arange(p) & 1).astype(bool)
    maps = np.zeros((len(masks), p + 1, p + 1))
    maps[:, 0, 0] = 1.0
    at = np.arange(p)
    maps[:, at + 1, at + 1] = bits
    maps[:, at + 1, 0] = np.where(bits, 0.0, means)
    return maps, bits


def chained_rounds(sums: dict, p: int, max_iter: int, tol: float, ridge: float, method: str):
    """(means, steps): the regressions of all rounds, from the patterns' sums alone.

    Each step regresses a column with gaps (fewest first) on all others as they are filled now, over the rows that have it.
    """
    import numpy as np
    masks = sorted(sums)
    sums = np.stack([sums[m] for m in masks]) if masks else np.zeros((0, p + 1, p + 1))
    bits = (np.array(masks, dtype=np.int64)[:, None] >> np.arange(p) & 1).astype(bool)
    rows, held = sums[:, 0, 0], (sums[:, 0, 0][:, None] * bits).sum(0)
    means = np.divide(sums[:, 0, 1:].sum(0), held, out=np.zeros(p), where=held > 0)
    maps, bits = _start_maps(masks, means, p)
    gaps = rows.sum() - held
    order = [c for c in sorted(range(p), key=lambda c: (gaps[c], c)) if gaps[c] > 0]
    solve = bayesian_ridge if method == "bayes" else least_squares
    steps = []
    for _ in range(max_iter if order else 0):
        before = maps.copy()
        for c in order:
            beta, has = np.zeros(p + 1), bits[:, c]
            others = [f for f in range(p) if f != c]
            n = rows[has].sum()
            if n:
                # sums of products of the filled rows: map x sums x map', added over the patterns that have the target
                gram = np.einsum("kij,kjl,kml->im", maps[has], sums[has], maps[has])
                mean = gram[0, 1:] / n
                centred = gram[1:, 1:] - n * np.outer(mean, mean)
                at = np.array(others, dtype=int)
                coef = solve(n, mean[at], mean[c], centred[np.ix_(at, at)], centred[at, c], centred[c, c], ridge)
                beta[at + 1] = coef
                beta[0] = mean[c] - coef @ mean[at]
            step = {"col": c, "beta": beta}
            _refill(maps, bits, step, p)
            steps.append(step)
        # root mean square of the changes of the gaps, against that of the observed values
        moved = maps - before
        change = max(np.einsum("kij,kjl,kil->", moved[:, 1:], sums, moved[:, 1:]), 0.0) / max(gaps.sum(), 1)
        size = sums[:, np.arange(p) + 1, np.arange(p) + 1].sum() / max(held.sum(), 1)
        if change <= (tol ** 2) * size:
            break
    return means, steps


class ChainedImputer(Estimator, _Stage):
    """Iterative imputation: start from training means, then repeatedly regress each
    column with gaps on the others (fewest gaps first) and refill its gaps, for at
    most ``maxIter`` rounds or until the root mean square change of the gaps is
    within ``tol`` times that of the observed values.

    The rows are scanned once, for the sums of every pattern of missing values; all
    rounds run on those.  ``method`` is ``bayes`` (Bayesian ridge, precisions by
    evidence) or ``ols`` (least squares with the L2 penalty ``ridge``).  At most
    62 columns and ``MAX_PATTERNS`` patterns."""

    maxIter = Param(Params._dummy(), "maxIter", "rounds", typeConverter=TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "relative stop tolerance", typeConverter=TypeConverters.toFloat)
    ridge = Param(Params._dummy(), "ridge", "L2 penalty", typeConverter=TypeConverters.toFloat)
    method = Param(Params._dummy(), "method", "bayes | ols", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, maxIter=10, tol=1e-3, ridge=1e-6, method="bayes"):
        super().__init__()
        self._setDefault(maxIter=10, tol=1e-3, ridge=1e-6, method="bayes")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ChainedImputerModel":
        cols = self._cols()
        if len(cols) > 62:
            raise ValueError("at most 62 columns")
        means, steps = chained_rounds(pattern_sums(df, cols), len(cols), *[self.getOrDefault(k) for k in ("maxIter", "tol", "ridge", "method")])
        state = {"means": means.tolist(), "steps": [{"col": s["col"], "beta": s["beta"].tolist()} for s in steps]}
        return ChainedImputerModel(inputCols=cols, state=json.dumps(state))


class ChainedImputerModel(Model, _Stage, _HasState):
    """Fills rows by one matrix product a pattern; patterns that training did not have go through the same steps."""

    @keyword_only
    def __init__(self, *, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st, cols = self.get_state(), self._cols()
        run = _filled_columns(st["means"], st["steps"], len(cols))
        made = F.arrow_udf(run, ", ".join(f"f{i} double" for i in range(len(cols))))(*[F.col(f"`{c}`").cast("double") for c in cols])
        place = {c: i for i, c in enumerate(cols)}
        return df.withColumn("_filled", made).select(*[F.col(f"_filled.f{place[c]}").alias(c) if c in place else F.col(f"`{c}`") for c in df.columns])


def _filled_columns(means: list, steps: list, p: int):
    known: dict = {}

    def run(*columns: pa.Array) -> pa.Array:
        import numpy as np
        x = np.stack([np.array(c.fill_null(float("nan")), np.float64) for c in columns], axis=1)
        has = ~np.isnan(x)
        mask = (has * (1 << np.arange(p, dtype=np.int64))).sum(1)
        x = np.where(has, x, 0.0)
        out = np.empty_like(x)
        for m in np.unique(mask).tolist():
            if m not in known:
                maps, bits = _start_maps([m], np.array(means), p)
                for s in steps:
                    _refill(maps, bits, {"col": s["col"], "beta": np.array(s["beta"])}, p)
                known[m] = maps[0]
            rows = mask == m
            out[rows] = x[rows] @ known[m][1:, 1:].T + known[m][1:, 0]
        return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(p)], names=[f"f{i}" for i in range(p)])

    return run
