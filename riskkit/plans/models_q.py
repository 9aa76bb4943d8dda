"""Queries for models, tuning, stacking, calibration (L1-L10), explanation and
scoring (X1-X6) and model persistence (S9).  Model outputs depend on learner
internals, so these are rows-only queries checked by invariants in the tests.

Training data: feature set A of the survey view without leakage columns, the
three-source label, the temporal split (train 2011-14, val 2015-16, test
2017-18) and exact stratified folds on the training rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..fixtures import survey_view, table, with_sr
from ..operators import explain as X
from ..operators import models as L
from ..operators.prep import QuantileBinner
from ..operators.split import stratified_folds, stratified_split
from ..operators.survey import features_interaction
from ..session import compiled, scratch_path
from ..streaming import score as S
from .catalog import register
from .derivations import FA_CTE
from .prep_q import CATEGORICAL_FEATURES, FLAG_FEATURES, NUMERIC_FEATURES, model_frame, preprocessor

RAW = NUMERIC_FEATURES + FLAG_FEATURES + CATEGORICAL_FEATURES


@dataclass
class Ctx:
    pre: PipelineModel
    raw: DataFrame       # every row before preprocessing: SEQN, label, split, raw columns
    data: DataFrame      # every row: SEQN, label, split, features
    train: DataFrame     # training rows with fold and weight (persisted: iterative learners re-read it)
    test: DataFrame
    n_features: int
    memo: dict


_CTX: dict = {}


def _prepared(raw: DataFrame, pipeline, memo_key: tuple) -> Ctx:
    """Fit ``pipeline`` on the training rows of ``raw`` and lay out what the model queries read."""
    if memo_key in _CTX:
        return _CTX[memo_key]
    # every pipeline stage makes its own pass over the training rows: keep them
    fit_rows = raw.filter("split = 'train'").persist(StorageLevel.MEMORY_AND_DISK)
    with ThreadPoolExecutor(1) as pool:
        # folds hang on keys and labels alone: they are drawn while the pipeline is fitted
        drawn = pool.submit(inheritable_thread_target(raw.sparkSession)(stratified_folds), fit_rows.select("SEQN", "label"), "SEQN", ["label"], k=5)
        pre = pipeline.fit(fit_rows)
        folds = drawn.result().select("SEQN", "fold")
    fit_rows.unpersist()
    data = pre.transform(raw).select("SEQN", "label", "split", "features")
    tr = data.filter("split = 'train'")
    # iterative learners re-read this frame every iteration: persist it
    train = L.with_balanced_weights(tr.join(folds, "SEQN"), "label").persist(StorageLevel.MEMORY_AND_DISK)
    attrs = data.schema["features"].metadata["ml_attr"]["attrs"]
    ctx = Ctx(pre, raw, data, train, data.filter("split = 'test'"), sum(len(v) for v in attrs.values()), {})
    _CTX[memo_key] = ctx
    return ctx


def context(spark, sf) -> Ctx:
    compiled(spark)
    raw = model_frame(spark, sf).select("SEQN", "label", "split", *RAW)
    return _prepared(raw, preprocessor(), (spark.sparkContext.applicationId, sf, "base"))


def stack_context(spark, sf) -> Ctx:
    """The stacking features: interactions and train-fitted bins (D7), quantile-normal numbers."""
    key = (spark.sparkContext.applicationId, sf, "stack")
    if key in _CTX:
        return _CTX[key]
    compiled(spark)
    base = model_frame(spark, sf)
    binner = QuantileBinner(inputCols=["WAIST_HT_RATIO"], q=5).fit(base.filter("split = 'train'"))
    raw = features_interaction(base, binner=binner).withColumn("WHtR_bin", F.col("WHtR_bin").cast("string"))
    numeric = [*NUMERIC_FEATURES, "AGE_x_BMI", "BMI_x_SBP", "HDL_x_SMOKER", "AGE_sq", "ACR_log", "CHOL_HDL_RATIO_log", "TCHOL_log"]
    categorical = [*CATEGORICAL_FEATURES, "WHtR_bin"]
    raw = raw.select("SEQN", "label", "split", *numeric, *FLAG_FEATURES, *categorical)
    return _prepared(raw, preprocessor(numeric, categorical, FLAG_FEATURES, quantile=True), key)


def release() -> None:
    """Drop the persisted frames that the model queries share."""
    for c in _CTX.values():
        for frame in (c.train, *[f for f in c.memo.values() if isinstance(f, DataFrame)]):
            frame.unpersist()
    _CTX.clear()


def _memo(c: Ctx, name: str, make):
    if name not in c.memo:
        c.memo[name] = make()
    return c.memo[name]


def _boosted(c: Ctx):
    """Boosted trees at the reference settings, weighted for imbalance."""
    return _memo(c, "gbt", lambda: L.gbt(weight="weight").fit(c.train))


def _scores(model, test):
    s = L.positive_probability(model.transform(test))
    return s.select("SEQN", "label", F.round("p", 6).alias("p"), F.col("prediction").cast("int").alias("pred"))


@register("fit_logistic")
def fit_logistic(spark, sf):
    c = context(spark, sf)
    return _scores(_memo(c, "logistic", lambda: L.logistic(weight="weight").fit(c.train)), c.test)


@register("fit_gbt")
def fit_gbt(spark, sf):
    c = context(spark, sf)
    return _scores(_boosted(c), c.test)


@register("gbt_early_stop")
def gbt_early_stop(spark, sf):
    c = context(spark, sf)
    tv = L.with_balanced_weights(c.data.filter("split IN ('train', 'val')"), "label").withColumn("is_val", F.col("split") == "val")
    model = L.gbt(rounds=100, depth=3, step=0.01, subsample=0.9, min_gain=0.1, weight="weight", validation="is_val", patience=50).fit(tv)
    return _scores(model, c.test).withColumn("trees", F.lit(model.getNumTrees))


@register("fit_forest")
def fit_forest(spark, sf):
    c = context(spark, sf)
    return _scores(L.forest(weight="weight").fit(c.train), c.test)


@register("fit_mlp")
def fit_mlp(spark, sf):
    """The net at the reference's settings, stopped by the validation rows' AUC."""
    c = context(spark, sf)
    rows = c.data.filter("split IN ('train', 'val')").withColumn("is_val", F.col("split") == "val").persist(StorageLevel.MEMORY_AND_DISK)
    model = L.mlp(validation="is_val").fit(rows)
    rows.unpersist()
    return _scores(model, c.test)


def _classes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of ``embeddings`` (10 labels), an exact stratified fifth held out."""
    rows = stratified_split(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "vec_id", ["label"])
    rows = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).drop("embedding")
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


def _class_scores(model, test: DataFrame) -> DataFrame:
    out = model.transform(test)
    return out.select("vec_id", "label", F.col("prediction").cast("int").alias("pred"), F.round(F.array_max(vector_to_array("probability")), 6).alias("p"))


@register("fit_gbt_classes")
def fit_gbt_classes(spark, sf):
    """Softmax boosting: a tree a class and round."""
    train, test = _classes(spark, sf)
    return _class_scores(L.gbt(rounds=30, depth=3, step=0.2, key="vec_id", classes=10).fit(train), test)


@register("fit_logistic_classes")
def fit_logistic_classes(spark, sf):
    """Multinomial logistic regression."""
    train, test = _classes(spark, sf)
    return _class_scores(L.logistic().fit(train), test)


#: Candidates of the registered search, drawn from the reference's grid of 4^6 and fitted on three folds each.
SEARCH_CANDIDATES = 50


#: The six axes of the search: rounds, depth, step, row and column samples, least gain.
SEARCH_SPACE = {"rounds": [100, 250, 500, 750], "depth": [3, 5, 7, 10], "step": [0.01, 0.05, 0.1, 0.2],
                "subsample": [0.7, 0.8, 0.9, 1.0], "columns": [0.7, 0.8, 0.9, 1.0], "min_gain": [0.0, 0.1, 0.2, 0.5]}


@register("random_search")
def random_search(spark, sf):
    """Seeded draw from the grid of six parameters, three even stratified folds, positive-class recall."""
    c = context(spark, sf)
    rows = c.train.drop("fold")
    folds = stratified_folds(rows.select("SEQN", "label"), "SEQN", ["label"], k=3).select("SEQN", "fold")
    found = L.random_search(L.gbt(weight="weight"), SEARCH_SPACE, SEARCH_CANDIDATES, rows.join(folds, "SEQN"))
    rows = [(", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(r)) for p, r in found]
    return spark.createDataFrame(rows, "params string, recall double").orderBy(F.col("recall").desc(), "params")


@register("compare_models")
def compare_models(spark, sf):
    c = context(spark, sf)
    ests = {"logistic": L.logistic(weight="weight"), "gbt": L.gbt(weight="weight"), "forest": L.forest(weight="weight")}
    return L.compare_models(ests, c.train, c.test)


#: Boosting rounds of the stacking bases, which are fitted six times: the reference's; the operator's default is 100.
STACK_ROUNDS = 300


def _bases():
    return {"log": L.logistic(weight="weight"), "gbt": L.gbt(rounds=STACK_ROUNDS, columns=0.8, weight="weight")}


def _oof(c) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of the training rows, and scores of the test rows by bases fitted on all of them."""
    if "oof" not in c.memo:
        oof, whole = L.out_of_fold(_bases(), c.train, "SEQN")
        c.memo["oof"] = oof.persist(StorageLevel.MEMORY_AND_DISK)
        c.memo["test_bases"] = L.base_scores(whole, c.test, "SEQN").persist(StorageLevel.MEMORY_AND_DISK)
    return c.memo["oof"], c.memo["test_bases"]


@register("oof_scores")
def oof_scores(spark, sf):
    return _oof(stack_context(spark, sf))[0]


@register("stacked")
def stacked(spark, sf):
    c = stack_context(spark, sf)
    out, _ = L.stack(list(_bases()), *_oof(c), c.train, c.test, "SEQN")
    return out.select("SEQN", "label", F.round("p", 6).alias("p"))


@register("calibrated")
def calibrated(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    c = stack_context(spark, sf)
    names = list(_bases())
    oof, bases = _oof(c)
    oof = oof.join(c.train.select("SEQN", "label"), "SEQN")
    asm = VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="meta_x")
    test = c.test.select("SEQN", "label").join(bases, "SEQN")
    out = L.calibrate_isotonic(asm.transform(oof), asm.transform(test), "meta_x", "SEQN")
    return out.join(test.select("SEQN", "label"), "SEQN").select("SEQN", "label", F.round("p", 6).alias("p"))


@register("gbt_importance")
def gbt_importance(spark, sf):
    c = context(spark, sf)
    return L.importance_table(_boosted(c), c.data, top=20)


def scoring_model(spark, sf) -> PipelineModel:
    """Preprocessing + balanced logistic regression as one model over raw columns."""
    c = context(spark, sf)
    lr = _memo(c, "logistic", lambda: L.logistic(weight="weight").fit(c.train))
    return PipelineModel(stages=[*c.pre.stages, lr])


@register("shapley_sampled")
def shapley_sampled(spark, sf):
    c = context(spark, sf)
    model = scoring_model(spark, sf)
    rows, background = (c.raw.filter(F.col("split") == part).select("SEQN", *RAW) for part in ("test", "train"))
    return X.sampled_shapley(model, rows, "SEQN", RAW, background)


@register("shapley_trees")
def shapley_trees(spark, sf):
    """Exact attributions of the boosted trees against all training rows, in log-odds."""
    c = context(spark, sf)
    model = _boosted(c).ensemble
    out = X.tree_attributions(model, c.test, "SEQN", c.train, names=L.slot_names(c.data))
    return out.select("SEQN", "feature", F.round("phi", 6).alias("phi"), F.round("base", 6).alias("base"))


def _requests(spark, sf) -> DataFrame:
    """Request records with the test respondents' raw values, as a caller would send them."""
    t = context(spark, sf).raw.filter("split = 'test'")
    cols = [F.col("SEQN").cast("string").alias("id")]
    for spec in S.RISK_INPUT.split(", ")[1:]:
        name, dtype = spec.split()
        src = "RIAGENDR" if name == "SEX" else name
        cols.append(F.col(src).cast(dtype).alias(name))
    return t.select(*cols)


@register("score_batch")
def score_batch(spark, sf):
    return S.score(_requests(spark, sf), scoring_model(spark, sf))


@register("score_stream")
def score_stream(spark, sf):
    src, sink, ck = (scratch_path(spark, n) for n in ("requests", "scored", "stream_ckpt"))
    _requests(spark, sf).repartition(4).write.parquet(src)
    S.score_stream(spark, src, sink, ck, scoring_model(spark, sf), max_files_per_trigger=2)
    return spark.read.parquet(sink)


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    c = context(spark, sf)
    model = scoring_model(spark, sf)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    raw = c.raw.filter("split = 'test'").select("SEQN", *RAW)
    a = L.positive_probability(model.transform(raw)).select("SEQN", F.col("p").alias("p_before"))
    b = L.positive_probability(loaded.transform(raw)).select("SEQN", F.col("p").alias("p_after"))
    return a.join(b, "SEQN")


@register("model_roundtrip_equal", with_sr("SELECT SEQN, true AS equal FROM FA WHERE DIABETES_BIN IS NOT NULL AND CAST(left(CYCLE, 4) AS INTEGER) >= 2017", FA_CTE))
def model_roundtrip_equal(spark, sf):
    """Every test row scores alike before and after the model was saved and loaded."""
    both = model_roundtrip(spark, sf)
    return both.select("SEQN", (F.abs(F.col("p_before") - F.col("p_after")) <= 1e-12).alias("equal"))


@register("oof_in_range", with_sr("SELECT SEQN, true AS in_range FROM FA WHERE DIABETES_BIN IS NOT NULL AND CAST(left(CYCLE, 4) AS INTEGER) BETWEEN 2011 AND 2014", FA_CTE))
def oof_in_range(spark, sf):
    """Every training row has one out-of-fold score of each base, a probability."""
    rows = oof_scores(spark, sf)
    return rows.select("SEQN", F.coalesce(F.col("p_log").between(0, 1) & F.col("p_gbt").between(0, 1), F.lit(False)).alias("in_range"))


# --- attributions with fixed linear weights (exact, SQL-checkable) -------------------

# Fixed weights of an illustrative linear score over survey columns.
LINEAR_WEIGHTS = {"RIDAGEYR": 0.03, "BMXBMI": 0.08, "BMXWAIST": 0.02, "BPXSY1": 0.01,
                  "LBXTC": 0.004, "LBDHDD": -0.02}


def _phi_sql() -> str:
    parts = [f"SELECT SEQN, '{c}' AS feature, round({w} * (coalesce({c}, (SELECT avg({c}) FROM SR)) - "
             f"(SELECT avg({c}) FROM SR)), 6) AS phi FROM SR" for c, w in LINEAR_WEIGHTS.items()]
    return "PHI AS (" + " UNION ALL ".join(parts) + ")"


@register("shapley_linear", with_sr("SELECT SEQN, feature, phi FROM PHI", _phi_sql()))
def shapley_linear(spark, sf):
    return X.linear_attributions(survey_view(spark, sf), "SEQN", LINEAR_WEIGHTS)


@register("attribution_ranking", with_sr(
    "SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM PHI GROUP BY feature", _phi_sql()))
def attribution_ranking(spark, sf):
    return X.attribution_ranking(X.linear_attributions(survey_view(spark, sf), "SEQN", LINEAR_WEIGHTS))


@register("row_factors", with_sr(
    "SELECT SEQN, feature, phi, sign, rn FROM (SELECT SEQN, feature, phi, CASE WHEN phi > 0 THEN 'positive' "
    "ELSE 'negative' END AS sign, row_number() OVER (PARTITION BY SEQN, phi > 0 ORDER BY abs(phi) DESC, feature) "
    "AS rn FROM PHI WHERE phi <> 0) t WHERE rn <= 3", _phi_sql()))
def row_factors(spark, sf):
    attr = X.linear_attributions(survey_view(spark, sf), "SEQN", LINEAR_WEIGHTS)
    return X.row_factors(attr, "SEQN", k=3).select("SEQN", "feature", "phi", "sign", "rn")
