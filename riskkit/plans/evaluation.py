"""Queries for evaluation metrics (E1-E9), thresholding (L11) and the metric sink.

Input: ``labels`` with a synthetic probability ``(doc_id % 37) / 36`` (ties on
purpose) against the ``quality`` label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import metrics as E
from ..session import scratch_path
from ..sources import io
from .catalog import register

SC = ("WITH SC AS (SELECT doc_id, quality AS label, CAST(doc_id % 37 AS DOUBLE) / 36.0 AS score, "
      "CAST(CAST(doc_id % 37 AS DOUBLE) / 36.0 >= 0.5 AS INTEGER) AS pred FROM labels)")
G = ("G AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, "
     "sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM SC GROUP BY score)")
CUM_DESC = ("C AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, "
            "sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp, "
            "sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM G)")
AUC_SQL = (f"{SC}, {G}, C AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS nc "
           "FROM G) SELECT round(sum(pos * (nc - neg + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM C")
AP_SQL = f"{SC}, {G}, {CUM_DESC} SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM C"


def scored(spark, sf):
    lab = table(spark, sf, "labels")
    s = (F.col("doc_id") % 37).cast("double") / 36.0
    return lab.select("doc_id", F.col("quality").alias("label"), s.alias("score"),
                      E.threshold_predict(s, 0.5).alias("pred"))


@register("threshold_predict", f"{SC} SELECT doc_id, score, pred FROM SC")
def threshold_predict(spark, sf):
    return scored(spark, sf).select("doc_id", "score", "pred")


@register("threshold_predict_strict",
          f"{SC} SELECT doc_id, CAST(score > 0.5 AS INTEGER) AS pred FROM SC")
def threshold_predict_strict(spark, sf):
    return scored(spark, sf).select("doc_id", E.threshold_predict("score", 0.5, inclusive=False).alias("pred"))


@register("roc_auc", AUC_SQL)
def roc_auc(spark, sf):
    return E.roc_auc(scored(spark, sf))


@register("average_precision", AP_SQL)
def average_precision(spark, sf):
    return E.average_precision(scored(spark, sf))


@register("roc_curve", f"{SC}, {G}, {CUM_DESC} SELECT score AS threshold, round(fp / N, 6) AS fpr, "
          "round(tp / P, 6) AS tpr FROM C")
def roc_curve(spark, sf):
    return E.roc_curve(scored(spark, sf))


@register("pr_curve", f"{SC}, {G}, {CUM_DESC} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, "
          "round(tp / P, 6) AS recall FROM C")
def pr_curve(spark, sf):
    return E.pr_curve(scored(spark, sf))


@register("confusion", f"{SC}, A AS (SELECT 0 AS a UNION ALL SELECT 1), B AS (SELECT 0 AS b UNION ALL SELECT 1) "
          "SELECT a AS actual, b AS predicted, CAST((SELECT count(*) FROM SC WHERE label = a AND pred = b) AS BIGINT) "
          "AS n FROM A, B")
def confusion(spark, sf):
    return E.confusion(scored(spark, sf))


def _d(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0.0)"


REPORT_SQL = (
    f"{SC}, K AS (SELECT count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp, "
    "count_if(label = 1 AND pred = 0) AS fn, count_if(label = 0 AND pred = 0) AS tn FROM SC), "
    f"M AS (SELECT *, {_d('tn', 'tn + fn')} AS p0, {_d('tn', 'tn + fp')} AS r0, {_d('tp', 'tp + fp')} AS p1, "
    f"{_d('tp', 'tp + fn')} AS r1, tn + fp AS s0, tp + fn AS s1 FROM K), "
    f"M2 AS (SELECT *, {_d('2 * p0 * r0', 'p0 + r0')} AS f0, {_d('2 * p1 * r1', 'p1 + r1')} AS f1, "
    f"{_d('tp + tn', 'tp + tn + fp + fn')} AS acc, s0 + s1 AS s FROM M) "
    "SELECT '0' AS row_label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, "
    "CAST(s0 AS BIGINT) AS support FROM M2 "
    "UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM M2 "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), CAST(s AS BIGINT) FROM M2 "
    "UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), "
    "CAST(s AS BIGINT) FROM M2 "
    f"UNION ALL SELECT 'weighted avg', round({_d('p0 * s0 + p1 * s1', 's')}, 6), "
    f"round({_d('r0 * s0 + r1 * s1', 's')}, 6), round({_d('f0 * s0 + f1 * s1', 's')}, 6), CAST(s AS BIGINT) FROM M2")


_CLASSES_SQL = """WITH x AS (SELECT label::VARCHAR AS y, (vec_id % 7)::VARCHAR AS p FROM embeddings WHERE label IS NOT NULL),
c AS (SELECT y AS c FROM x UNION SELECT p FROM x),
k AS (SELECT c, (SELECT count(*) FROM x WHERE y = c AND p = c) AS hit, (SELECT count(*) FROM x WHERE y = c) AS held,
  (SELECT count(*) FROM x WHERE p = c) AS said FROM c),
m AS (SELECT *, coalesce(hit / nullif(said, 0), 0.0) AS pr, coalesce(hit / nullif(held, 0), 0.0) AS re FROM k),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0.0) AS f1 FROM m),
r AS (SELECT c AS row_label, pr AS precision, re AS recall, f1, held AS support FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(held), sum(held) FROM f
  UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), sum(held) FROM f
  UNION ALL SELECT 'weighted avg', sum(pr * held) / sum(held), sum(re * held) / sum(held), sum(f1 * held) / sum(held), sum(held) FROM f)
SELECT row_label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM r"""


@register("classes_report", _CLASSES_SQL)
def classes_report(spark, sf):
    """The ten labels of ``embeddings`` against a rule's seven predictions."""
    rows = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 7).alias("pred"))
    return E.classes_report(rows)


@register("classification_report", REPORT_SQL)
def classification_report(spark, sf):
    return E.classification_report(scored(spark, sf))


@register("accuracy", f"{SC} SELECT round(avg(CAST(pred = label AS DOUBLE)), 6) AS accuracy FROM SC")
def accuracy(spark, sf):
    return E.accuracy(scored(spark, sf))


@register("positive_recall_precision",
          f"{SC}, K AS (SELECT count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp, "
          f"count_if(label = 1 AND pred = 0) AS fn FROM SC) SELECT round({_d('tp', 'tp + fn')}, 6) AS recall, "
          f"round({_d('tp', 'tp + fp')}, 6) AS precision FROM K")
def positive_recall_precision(spark, sf):
    return E.positive_recall_precision(scored(spark, sf))


@register("log_loss",
          f"{SC}, Q AS (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS q FROM SC) "
          "SELECT round(-avg(label * ln(q) + (1 - label) * ln(1 - q)), 6) AS log_loss FROM Q")
def log_loss(spark, sf):
    return E.log_loss(scored(spark, sf), p="score")


_AUC_CUM = "CA AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS nc FROM G)"
_AUC_VAL = "round(sum(pos * (nc - neg + neg / 2.0)) / (sum(pos) * sum(neg)), 6)"
_AP_VAL = "round(sum(pos * tp / (tp + fp)) / sum(pos), 6)"


@register("json_metrics_sink",
          f"{SC}, {G}, {_AUC_CUM}, {CUM_DESC} "
          f"SELECT 'synthetic' AS model, 'auc' AS metric, {_AUC_VAL} AS value FROM CA "
          f"UNION ALL SELECT 'synthetic', 'ap', {_AP_VAL} FROM C")
def json_metrics_sink(spark, sf):
    s = scored(spark, sf)
    rec = E.metric_records("synthetic", E.roc_auc(s), E.average_precision(s))
    path = scratch_path(spark, "metrics_json")
    io.write_table(rec.coalesce(1), path, "json")
    return io.read_table(spark, path, "json", schema="model string, metric string, value double")
