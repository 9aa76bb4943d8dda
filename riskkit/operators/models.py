"""Models, tuning, stacking and calibration.

Boosted trees, their search and their folds run on the shared-scan learner of
``boosting``; the other learners are Spark ML's.  Every trainer takes a frame with an assembled ``features`` vector and a label;
scores come back as a ``p`` column (positive-class probability), next to the
row's own columns: several models score a frame by one chain of transforms.  Folds come from the exact stratified fold column (M3).
"""

from __future__ import annotations

import random
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import product

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import boosting as B
from . import metrics as E
from .isotonic import applied, isotonic_steps
from .net import Net


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "p") -> DataFrame:
    """Positive-class probability from a probability vector."""
    return df.withColumn(out, vector_to_array(prob_col).getItem(1))


def with_balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """M14 as a weight column (n / (k * n_class))."""
    from .prep import class_weights
    return class_weights(df, label, out)


class PenalisedLogistic(LogisticRegression):
    """Logistic regression with the C parametrisation, whatever rows it is fitted on.

    Minimising ``C * sum(w * loss) + |beta|^2 / 2`` equals Spark's
    ``sum(w * loss) / sum(w) + regParam * |beta|^2 / 2`` with
    ``regParam = 1 / (C * sum(w))``; the sum is taken over the rows of each fit.
    """

    strength = 1.0

    def _fit(self, dataset):
        w = self.getOrDefault(self.weightCol) if self.isSet(self.weightCol) else None
        total = dataset.agg(F.sum(F.col(w)) if w else F.count(F.lit(1))).first()[0] or 1
        return LogisticRegression._fit(self.copy({self.regParam: 1.0 / (self.strength * float(total))}), dataset)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.strength = self.strength
        return that


def logistic(label: str = "label", features: str = "features", C: float = 1.0,
             max_iter: int = 1000, weight: str | None = None) -> Estimator:
    """L1: L2 logistic regression; standardisation is off (inputs are scaled)."""
    est = PenalisedLogistic(featuresCol=features, labelCol=label, maxIter=max_iter, elasticNetParam=0.0, standardization=False)
    est.strength = C
    if weight:
        est.setWeightCol(weight)
    return est


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted boosted trees: adds ``probability`` and ``prediction`` to rows with a features vector."""

    state = Param(Params._dummy(), "state", "the trees (JSON)", typeConverter=TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features vector", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None, featuresCol="features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def ensemble(self) -> B.Ensemble:
        return B.Ensemble.from_json(self.getOrDefault(self.state))

    @property
    def getNumTrees(self) -> int:
        return len(self.ensemble.trees[0])

    @property
    def featureImportances(self):
        return Vectors.dense(self.ensemble.importances())

    def _transform(self, dataset):
        return B.with_probability(dataset, self.ensemble, self.getOrDefault(self.featuresCol))


class BoostedTrees(Estimator):
    """L2/L3: second-order boosted trees; see ``boosting``.

    ``validation`` names a boolean column of rows that only judge: the rounds
    stop when their log-loss has not fallen for ``patience`` rounds.
    ``classes`` > 2 fits a softmax over labels 0 .. classes - 1.
    """

    def __init__(self, spec: B.Boosting, label: str = "label", features: str = "features", weight: str | None = None, key: str = "SEQN",
                 validation: str | None = None, patience: int = 50, classes: int = 0):
        super().__init__()
        self.spec, self.label, self.features, self.weight, self.key = spec, label, features, weight, key
        self.validation, self.patience, self.classes = validation, patience, classes if classes > 2 else 0

    def fit_specs(self, train: DataFrame, specs: Sequence[B.Boosting], fold: str | None = None) -> list[BoostedTreesModel]:
        """One model a spec, all grown in the same passes over ``train``."""
        models, _ = B.fit_all(train, specs, self.label, self.weight, self.key, fold, self.features, self.classes)
        return [BoostedTreesModel(state=m.to_json(), featuresCol=self.features) for m in models]

    def _fit(self, dataset):
        if not self.validation:
            return self.fit_specs(dataset, [self.spec])[0]
        judged = dataset.withColumn("_part", F.coalesce(F.col(self.validation), F.lit(False)).cast("int"))
        models, _ = B.fit_all(judged, [self.spec], self.label, self.weight, self.key, "_part", self.features, 0, self.patience, 1)
        return BoostedTreesModel(state=models[0].to_json(), featuresCol=self.features)


def gbt(label: str = "label", features: str = "features", rounds: int = 100, depth: int = 4, step: float = 0.05, subsample: float = 0.8,
        columns: float = 1.0, min_gain: float = 0.0, weight: str | None = None, validation: str | None = None, patience: int = 50,
        seed: int = 42, key: str = "SEQN", classes: int = 0) -> BoostedTrees:
    """L2/L3: gradient-boosted trees; ``validation`` names a boolean column for early stopping."""
    spec = B.Boosting(rounds, depth, step, subsample, columns, min_gain, seed=seed)
    return BoostedTrees(spec, label, features, weight, key, validation, patience, classes)


def forest(label: str = "label", features: str = "features", trees: int = 100, weight: str | None = None,
           seed: int = 42) -> Estimator:
    """L4: random forest."""
    est = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed)
    if weight:
        est.setWeightCol(weight)
    return est


def mlp(label: str = "label", features: str = "features", hidden: Sequence[int] = (256, 128), weight: str | None = None,
        validation: str | None = None, seed: int = 42, **options) -> Net:
    """Feed-forward net n-256-128-1 with batch normalisation and dropout; see ``net``."""
    return Net(label, features, hidden, weight=weight, validation=validation, seed=seed, **options)


def random_search(est: BoostedTrees, space: Mapping[str, Sequence], n_candidates: int, train: DataFrame, fold_col: str = "fold",
                  folds: int = 3, seed: int = 42, **options) -> list[tuple[dict, float]]:
    """(settings, mean positive-class recall over the folds) of a seeded sample of ``n_candidates`` points of the grid ``space``.

    All candidates and folds are grown together (``boosting.fit_all``); each
    fold's rows are judged by the margins that the model fitted without them
    gives them, so nothing is scored twice.
    """
    names = sorted(space)
    grid = [dict(zip(names, values, strict=True)) for values in product(*[space[n] for n in names])]
    picked = random.Random(seed).sample(grid, min(n_candidates, len(grid)))
    specs = B.held_out_specs([replace(est.spec, **p) for p in picked], folds)
    _, rows = B.fit_all(train, specs, est.label, est.weight, est.key, fold_col, est.features, scorer=B.recall_by_fold,
                        scores="lane int, positives long, found long", **options)
    recall = {r["lane"]: r["found"] / r["positives"] if r["positives"] else 0.0 for r in rows}
    return [(p, sum(recall.get(i * folds + f, 0.0) for f in range(folds)) / folds) for i, p in enumerate(picked)]


def evaluate(scored: DataFrame, label: str = "label", p: str = "p", threshold: float = 0.5) -> dict:
    """AUC, AP, accuracy, positive recall/precision of a scored frame (exact aggregates).

    The frame is reduced to counts per (score, label) once; all five come from those.
    """
    s = scored.select(label, p).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        s2 = s.withColumn("_pred", E.threshold_predict(p, threshold))
        auc = E.roc_auc(s2, label, p).first()["auc"]
        ap = E.average_precision(s2, label, p).first()["ap"]
        acc = E.accuracy(s2, label, "_pred").first()["accuracy"]
        rp = E.positive_recall_precision(s2, label, "_pred").first()
    finally:
        s.unpersist()
    return {"auc": auc, "ap": ap, "accuracy": acc, "recall": rp["recall"], "precision": rp["precision"]}


def compare_models(estimators: dict, train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Fit each estimator, time it, evaluate on ``test``; one row per model sorted by AUC."""
    spark = train.sparkSession
    rows = []
    for name, est in estimators.items():
        t0 = time.time()
        model = est.fit(train)
        secs = time.time() - t0
        m = evaluate(positive_probability(model.transform(test)), label)
        rows.append((name, m["auc"], m["ap"], m["accuracy"], m["recall"], m["precision"], round(secs, 3)))
    schema = ("model string, auc double, ap double, accuracy double, recall double, precision double, "
              "train_seconds double")
    return spark.createDataFrame(rows, schema).orderBy(F.col("auc").desc())


def scored_by(models: dict, rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``p_<name>`` for every fitted model, by one chain of transforms: no join."""
    for name, model in models.items():
        keep = rows.columns
        rows = positive_probability(model.transform(rows), out=f"p_{name}").select(*keep, f"p_{name}")
    return rows


#: Spark ML fits that run side by side: each is many short jobs, which leave the cluster idle in between.
SIDE_BY_SIDE = 3


def fit_each(est, frames: Sequence[DataFrame]) -> list:
    """``est`` fitted on each of ``frames``, in their order."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        # a target of its own a call: it copies this thread's local properties, and no two threads may share those
        jobs = [pool.submit(inheritable_thread_target(frame.sparkSession)(est.copy().fit), frame) for frame in frames]
        return [job.result() for job in jobs]


def _fold_models(est, train: DataFrame, fold_col: str, folds: int) -> list:
    """Models fitted without each fold, and last the one fitted on all rows; boosted trees in shared passes."""
    if isinstance(est, BoostedTrees):
        return est.fit_specs(train, [*B.held_out_specs([est.spec], folds), est.spec], fold_col)
    return fit_each(est, [*[train.filter(F.col(fold_col) != i) for i in range(folds)], train])


def out_of_fold(estimators: dict, train: DataFrame, key: str, fold_col: str = "fold",
                k: int | None = None) -> tuple[DataFrame, dict]:
    """(key, fold, p_<name>...) - each row scored by models fit without its fold - and the models fit on all rows."""
    folds = k or (train.agg(F.max(fold_col)).first()[0] or 0) + 1
    fitted = {n: _fold_models(est, train, fold_col, folds) for n, est in estimators.items()}
    out = None
    for i in range(folds):
        held = scored_by({n: models[i] for n, models in fitted.items()}, train.filter(F.col(fold_col) == i))
        part = held.select(key, fold_col, *[f"p_{n}" for n in estimators])
        out = part if out is None else out.unionByName(part)
    return out, {n: models[-1] for n, models in fitted.items()}


def base_scores(models: dict, rows: DataFrame, key: str) -> DataFrame:
    """(key, p_<name>...) for ``rows`` from fitted bases."""
    return scored_by(models, rows).select(key, *[f"p_{n}" for n in models])


def meta_fit(oof: DataFrame, names, label: str = "label"):
    """Meta logistic regression on base probabilities (C = 1)."""
    asm = VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="meta_x")
    return asm, logistic(label, "meta_x").fit(asm.transform(oof))


def stack(names: Sequence[str], oof: DataFrame, test_bases: DataFrame, train: DataFrame, test: DataFrame, key: str,
          label: str = "label") -> tuple[DataFrame, object]:
    """Meta logistic regression on out-of-fold base probabilities (``oof``); test rows are
    scored by bases fit on all training rows (``test_bases``).  Returns (test scores, meta model)."""
    asm, meta = meta_fit(oof.join(train.select(key, label), key), names, label)
    scored = test.select(key, label).join(test_bases, key)
    out = positive_probability(meta.transform(asm.transform(scored)))
    return out.drop("probability", "rawPrediction", "prediction"), meta


def calibrate_isotonic(meta_input: DataFrame, test_input: DataFrame, x_col: str, key: str,
                       label: str = "label", fold_col: str = "fold") -> DataFrame:
    """Per fold, refit the meta model without the fold, fit an isotonic map from its
    held-out scores to labels, apply the pair to test rows; average over folds."""
    folds = (meta_input.agg(F.max(fold_col)).first()[0] or 0) + 1
    held, asked = None, None
    metas = fit_each(logistic(label, x_col), [meta_input.filter(F.col(fold_col) != i) for i in range(folds)])
    for i, meta in enumerate(metas):
        mine = positive_probability(meta.transform(meta_input.filter(F.col(fold_col) == i))).select(
            F.lit(i).alias("g"), "p", F.col(label).cast("double").alias("y"))
        test = positive_probability(meta.transform(test_input)).select(F.col(key), F.lit(i).alias("g"), "p")
        held, asked = (mine, test) if held is None else (held.unionByName(mine), asked.unionByName(test))
    steps = isotonic_steps(held, "g", "p", "y")
    return applied(asked, steps, "g", "p", "c").groupBy(key).agg(F.avg("c").alias("p"))


def slot_names(assembled: DataFrame, features: str = "features") -> list[str]:
    """Names of the slots of an assembled vector, from its metadata."""
    groups = assembled.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).values()
    return [a["name"] for a in sorted((a for g in groups for a in g), key=lambda a: a["idx"])]


def importance_table(model, assembler_out: DataFrame, features: str = "features", top: int = 20) -> DataFrame:
    """(feature, importance) with expanded vector slot names, top ``top`` by importance."""
    names = dict(enumerate(slot_names(assembler_out, features)))
    imp = model.featureImportances.toArray().tolist()
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    spark = assembler_out.sparkSession
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc(), F.col("feature")).limit(top)
