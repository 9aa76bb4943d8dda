"""Queries for preprocessing (M6-M14); imputers, scalers and encoders fit on the
training cycles (2011-2014) and are applied to every row."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..fixtures import survey_view, table, with_sr
from ..functions import rowwise as R
from ..operators import prep as P
from ..operators.split import exclude_leaky, temporal_split
from . import sqlbits as Q
from .catalog import register
from .derivations import FB_CTE, features_a_frame, features_b_frame

TRAIN = f"{Q.year_start('CYCLE')} BETWEEN 2011 AND 2014"


def train_rows(df, cycle="CYCLE"):
    return temporal_split(df.withColumn("_y", R.year_start(cycle)), "_y", "_split") \
        .filter("_split = 'train'").drop("_y", "_split")


_MED = ["BMXBMI", "BMXWAIST", "LBXTC", "LBDHDD"]


@register("impute_median", with_sr(
    "SELECT SEQN, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM T)), 6) AS {c}" for c in _MED)
    + " FROM SR", f"T AS (SELECT * FROM SR WHERE {TRAIN})"))
def impute_median(spark, sf):
    sr = survey_view(spark, sf)
    model = P.ExactImputer(inputCols=_MED, strategy="median").fit(train_rows(sr))
    out = model.transform(sr.select("SEQN", *_MED))
    return out.select("SEQN", *[F.round(c, 6).alias(c) for c in _MED])


_MODE = ["SMQ020", "DIQ010", "PAQ605"]


def _mode_sql(c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM T WHERE {c} IS NOT NULL GROUP BY {c}) m "
            "ORDER BY n DESC, v LIMIT 1)")


@register("impute_median_by", with_sr(
    "SELECT s.SEQN, s.CYCLE, " + ", ".join(f"round(coalesce(s.{c}, m.{c}), 6) AS {c}" for c in _MED)
    + " FROM SR s LEFT JOIN M m ON s.CYCLE = m.CYCLE",
    "M AS (SELECT CYCLE, " + ", ".join(f"median({c}) AS {c}" for c in _MED) + " FROM SR GROUP BY CYCLE)"))
def impute_median_by(spark, sf):
    """M6 within groups: every cycle's gaps from its own medians."""
    sr = survey_view(spark, sf).select("SEQN", "CYCLE", *_MED)
    medians = P.group_medians(sr, _MED, ["CYCLE"]).select(F.col("CYCLE").alias("_by"), *[F.col(c).alias(f"_m_{c}") for c in _MED])
    out = sr.join(medians, sr["CYCLE"].eqNullSafe(medians["_by"]), "left")
    return out.select("SEQN", "CYCLE", *[F.round(F.coalesce(c, f"_m_{c}"), 6).alias(c) for c in _MED])


@register("impute_median_approx")
def impute_median_approx(spark, sf):
    """M6 by rank sketches (their answers vary within the stated rank error)."""
    sr = survey_view(spark, sf)
    model = P.ExactImputer(inputCols=_MED, strategy="approx_median").fit(train_rows(sr))
    return model.transform(sr.select("SEQN", *_MED))


@register("impute_mode", with_sr(
    "SELECT SEQN, " + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in _MODE) + " FROM SR",
    f"T AS (SELECT * FROM SR WHERE {TRAIN})"))
def impute_mode(spark, sf):
    sr = survey_view(spark, sf)
    model = P.ExactImputer(inputCols=_MODE, strategy="most_frequent").fit(train_rows(sr))
    return model.transform(sr.select("SEQN", *_MODE))


_STD = ["RIDAGEYR", "BMXBMI", "LBXTC"]


def _std_sql(c):
    s = f"(SELECT CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END FROM T)"
    return f"round(({c} - (SELECT avg({c}) FROM T)) / {s}, 6) AS {c}"


@register("standardise", with_sr("SELECT SEQN, " + ", ".join(_std_sql(c) for c in _STD) + " FROM SR",
                                 f"T AS (SELECT * FROM SR WHERE {TRAIN})"))
def standardise(spark, sf):
    sr = survey_view(spark, sf)
    model = P.PopulationScaler(inputCols=_STD).fit(train_rows(sr))
    return model.transform(sr.select("SEQN", *_STD)).select("SEQN", *[F.round(c, 6).alias(c) for c in _STD])


@register("one_hot", with_sr(
    "SELECT f.SEQN, f.BMI_CLASS, CAST(l.idx AS INTEGER) AS onehot_index FROM FB f LEFT JOIN "
    "(SELECT BMI_CLASS, row_number() OVER (ORDER BY BMI_CLASS) - 1 AS idx FROM (SELECT DISTINCT BMI_CLASS "
    "FROM FB WHERE BMI_CLASS IS NOT NULL AND cycle IN ('2011_2012', '2013_2014'))) l ON f.BMI_CLASS = l.BMI_CLASS",
    FB_CTE))
def one_hot(spark, sf):
    fb = features_b_frame(spark, sf).select("SEQN", "cycle", "BMI_CLASS")
    pipe = Pipeline(stages=P.one_hot_table_stages(["BMI_CLASS"])).fit(train_rows(fb, "cycle"))
    return pipe.transform(fb).select("SEQN", "BMI_CLASS", P.hot_index("BMI_CLASS_ohe").alias("onehot_index"))


@register("ordinal_encode", with_sr(
    "SELECT f.SEQN, f.AGE_FORM, CASE WHEN f.AGE_FORM IS NULL THEN NULL ELSE CAST(coalesce(l.idx, -1) AS INTEGER) "
    "END AS AGE_CODE FROM (SELECT SEQN, " + Q.ladder_incl("AGE", *R.AGE_LADDER_FORM) + " AS AGE_FORM FROM FB) f "
    "LEFT JOIN (SELECT AGE_BIN, row_number() OVER (ORDER BY AGE_BIN) - 1 AS idx FROM (SELECT DISTINCT AGE_BIN "
    "FROM FB WHERE AGE_BIN IS NOT NULL AND cycle IN ('2011_2012', '2013_2014'))) l ON f.AGE_FORM = l.AGE_BIN",
    FB_CTE))
def ordinal_encode(spark, sf):
    """Encoder fitted on training bins, applied to the form's bins: unseen labels -> -1."""
    fb = features_b_frame(spark, sf)
    model = P.OrdinalEncoder(inputCols=["AGE_BIN"]).fit(train_rows(fb, "cycle"))
    form = fb.select("SEQN", R.ladder_upper_inclusive("AGE", *R.AGE_LADDER_FORM).alias("AGE_FORM"))
    coded = model.transform(form.withColumn("AGE_BIN", F.col("AGE_FORM")))
    return coded.select("SEQN", "AGE_FORM", F.col("AGE_BIN").alias("AGE_CODE"))


@register("class_weights",
          "SELECT doc_id, quality, round(n * 1.0 / (k * nc), 6) AS weight FROM (SELECT doc_id, quality, "
          "count(*) OVER () AS n, count(*) OVER (PARTITION BY quality) AS nc, "
          "(SELECT count(DISTINCT quality) FROM labels) AS k FROM labels) t")
def class_weights(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return P.class_weights(lab, "quality").withColumn("weight", F.round("weight", 6))


_CHAIN = ["BMXBMI", "BMXWAIST", "LBXGLU", "LBXGH", "LBXTC", "LBDHDD"]


@register("impute_chained")
def impute_chained(spark, sf):
    sr = survey_view(spark, sf)
    model = P.ChainedImputer(inputCols=_CHAIN).fit(train_rows(sr).select(*_CHAIN))
    return model.transform(sr.select("SEQN", *_CHAIN))


# one round on two columns, the one with fewer gaps first: LBXTC on BMXBMI, then BMXBMI on the filled LBXTC
_ROUND = ["LBXTC", "BMXBMI"]
_ROUND_SQL = f"""M AS (SELECT avg(LBXTC) AS ma, avg(BMXBMI) AS mb, count(LBXTC) >= count(BMXBMI) AS a_first FROM SR WHERE {TRAIN}),
S AS (SELECT SEQN, {TRAIN} AS tr, CASE WHEN a_first THEN LBXTC ELSE BMXBMI END AS a, CASE WHEN a_first THEN BMXBMI ELSE LBXTC END AS b,
  CASE WHEN a_first THEN ma ELSE mb END AS ma, CASE WHEN a_first THEN mb ELSE ma END AS mb, a_first FROM SR, M),
F1 AS (SELECT regr_slope(a, coalesce(b, mb)) AS s1, regr_intercept(a, coalesce(b, mb)) AS i1 FROM S WHERE tr AND a IS NOT NULL),
S1 AS (SELECT *, coalesce(a, i1 + s1 * coalesce(b, mb)) AS fa FROM S, F1),
F2 AS (SELECT regr_slope(b, fa) AS s2, regr_intercept(b, fa) AS i2 FROM S1 WHERE tr AND b IS NOT NULL),
S2 AS (SELECT *, coalesce(b, i2 + s2 * fa) AS fb FROM S1, F2)"""


@register("impute_chained_round", with_sr(
    "SELECT SEQN, round(CASE WHEN a_first THEN fa ELSE fb END, 6) AS LBXTC, round(CASE WHEN a_first THEN fb ELSE fa END, 6) AS BMXBMI FROM S2", _ROUND_SQL))
def impute_chained_round(spark, sf):
    """One round of least squares on two columns."""
    sr = survey_view(spark, sf)
    model = P.ChainedImputer(inputCols=_ROUND, maxIter=1, method="ols", ridge=0.0).fit(train_rows(sr).select(*_ROUND))
    return model.transform(sr.select("SEQN", *_ROUND)).select("SEQN", *[F.round(c, 6).alias(c) for c in _ROUND])


_NORMAL = ["BMXBMI", "LBXTC", "URXUMA"]
_POINTS = 1000


def _sql_poly(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _normal_sql(c: str) -> str:
    """The training CDF by linear interpolation between grid points, clipped, through the inverse normal."""
    k = _POINTS - 1
    below, upto = f"len(list_filter(g_{c}, lambda e: e < {c}))", f"len(list_filter(g_{c}, lambda e: e <= {c}))"
    cdf = (f"CASE WHEN up > lo THEN (lo / {k}.0 + (up - 1) / {k}.0) / 2 WHEN lo = 0 THEN 0.0 WHEN lo > {k} THEN 1.0 "
           f"ELSE (lo - 1) / {k}.0 + (v - g[lo]) * (lo / {k}.0 - (lo - 1) / {k}.0) / (g[lo + 1] - g[lo]) END")
    outer = f"({_sql_poly(P._C, 'q')} / ({_sql_poly(P._D, 'q')} * q + 1))"
    inner = f"({_sql_poly(P._A, 'r')} * m / ({_sql_poly(P._B, 'r')} * r + 1))"
    return f"""N_{c} AS (SELECT SEQN, round(CASE WHEN least(p, 1 - p) < 0.02425 THEN CASE WHEN p < 0.5 THEN {outer} ELSE -{outer} END ELSE {inner} END, 6) AS {c}
  FROM (SELECT SEQN, p, sqrt(-2 * ln(least(p, 1 - p))) AS q, p - 0.5 AS m, (p - 0.5) * (p - 0.5) AS r
  FROM (SELECT SEQN, least(greatest({cdf}, 1e-7), 1 - 1e-7) AS p
  FROM (SELECT SEQN, {c} AS v, g_{c} AS g, {below} AS lo, {upto} AS up FROM SR, G) a WHERE v IS NOT NULL) b) c)"""


_GRID = "[" + ", ".join(repr(i / (_POINTS - 1)) for i in range(_POINTS)) + "]"


@register("quantile_normal", with_sr(
    "SELECT SR.SEQN, " + ", ".join(f"N_{c}.{c}" for c in _NORMAL) + " FROM SR " + " ".join(f"LEFT JOIN N_{c} ON N_{c}.SEQN = SR.SEQN" for c in _NORMAL),
    "G AS (SELECT " + ", ".join(f"quantile_cont({c}, {_GRID}) AS g_{c}" for c in _NORMAL) + f" FROM SR WHERE {TRAIN}),\n" + ",\n".join(_normal_sql(c) for c in _NORMAL)))
def quantile_normal(spark, sf):
    sr = survey_view(spark, sf)
    model = P.QuantileNormal(inputCols=_NORMAL, nQuantiles=_POINTS).fit(train_rows(sr).select(*_NORMAL))
    return model.transform(sr.select("SEQN", *_NORMAL)).select("SEQN", *[F.round(c, 6).alias(c) for c in _NORMAL])


NUMERIC_FEATURES = ["AGE", "BMI", "WAIST_HT_RATIO", "SBP_MEAN", "DBP_MEAN", "TCHOL", "HDL", "TRIG",
                    "CHOL_HDL_RATIO", "TG_TO_HDL", "ACR", "PA_SCORE"]
CATEGORICAL_FEATURES = ["AGE_BIN", "BMI_CLASS"]
FLAG_FEATURES = ["RIAGENDR", "HYPERTENSION_FLAG", "SMOKER"]


def preprocessor(numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES, flags=FLAG_FEATURES,
                 quantile=False, out="features"):
    """Numeric median-impute (+ optional quantile-normal) + population scaling,
    categorical mode-impute + one-hot, flags passed through; assembled to a vector."""
    stages = [P.ExactImputer(inputCols=list(numeric) + list(flags), strategy="median")]
    if quantile:
        stages.append(P.QuantileNormal(inputCols=list(numeric)))
    stages.append(P.PopulationScaler(inputCols=list(numeric)))
    stages.append(P.ExactImputer(inputCols=list(categorical), strategy="most_frequent"))
    stages += P.one_hot_stages(categorical)
    stages.append(VectorAssembler(inputCols=list(numeric) + list(flags) + [f"{c}_ohe" for c in categorical],
                                  outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def model_frame(spark, sf):
    """Features A without leakage columns, with the label and the temporal split."""
    fa = features_a_frame(spark, sf).withColumn("label", F.col("DIABETES_BIN"))
    x = exclude_leaky(fa)
    return temporal_split(x.withColumn("YEAR_START", R.year_start("CYCLE")))


@register("preprocess_pipeline")
def preprocess_pipeline(spark, sf):
    from pyspark.storagelevel import StorageLevel
    df = model_frame(spark, sf)
    fit_rows = df.filter("split = 'train'").persist(StorageLevel.MEMORY_AND_DISK)  # one pass per stage
    fitted = preprocessor(quantile=True).fit(fit_rows)
    fit_rows.unpersist()
    return fitted.transform(df).select("SEQN", "split", vector_to_array("features").alias("features"))
