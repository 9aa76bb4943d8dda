"""Scoring with risk level and advice (X5) and the same transform on a stream.

One code path: ``score`` is a ``DataFrame -> DataFrame`` function, used on a
batch frame and, unchanged, on a streaming frame (stateless: no watermark or
state store is needed).  Input rows follow ``RISK_INPUT`` plus a required id.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rowwise as R
from ..operators.survey import advice, risk_level

# Fields of a request record.
RISK_INPUT = (
    "id string, AGE double, AGE_BIN string, SEX int, BMI double, BMI_CLASS string, WAIST_HT_RATIO double, "
    "SBP_MEAN double, DBP_MEAN double, HYPERTENSION_FLAG int, TCHOL double, HDL double, TRIG double, "
    "CHOL_HDL_RATIO double, TG_TO_HDL double, ACR double, SMOKER int, PA_SCORE double")

RISK_FIELDS = [f.split()[0] for f in RISK_INPUT.split(", ") if not f.startswith("id ")]
SUCCESS_MESSAGE = "Prediction successful"


def to_model_input(df: DataFrame) -> DataFrame:
    """Map request fields to training features; bins are derived from AGE/BMI with the
    training bin set (the form's own labels are never seen in training)."""
    return df.select(
        "*", F.col("SEX").cast("double").alias("RIAGENDR"),
        R.bins_right_closed("AGE", *R.AGE_BINS_A).alias("_AGE_BIN_T"),
        R.bins_right_closed("BMI", *R.BMI_BINS_A).alias("_BMI_CLASS_T"),
    ).drop("AGE_BIN", "BMI_CLASS").withColumnRenamed("_AGE_BIN_T", "AGE_BIN") \
        .withColumnRenamed("_BMI_CLASS_T", "BMI_CLASS")


def score(df: DataFrame, model, key: str = "id") -> DataFrame:
    """(id, risk_probability, risk_level, advice, message) for every input row.

    Advice reads the raw request values (before imputation or scaling).
    """
    raw = df.select(key, *[F.col(c).alias(f"_raw_{c}") for c in
                           ["BMI", "HYPERTENSION_FLAG", "SBP_MEAN", "PA_SCORE", "SMOKER", "TG_TO_HDL"]],
                    *[c for c in RISK_FIELDS])
    scored = model.transform(to_model_input(raw))
    p = vector_to_array("probability").getItem(1)
    return scored.select(
        key, F.round(p, 4).alias("risk_probability"), risk_level(p).alias("risk_level"),
        advice(p, bmi="_raw_BMI", hypertension="_raw_HYPERTENSION_FLAG", sbp="_raw_SBP_MEAN",
               activity="_raw_PA_SCORE", smoker="_raw_SMOKER", tg_hdl="_raw_TG_TO_HDL").alias("advice"),
        F.lit(SUCCESS_MESSAGE).alias("message"))


def score_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, model,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None):
    """Read request files as a stream, score each micro-batch, append to ``sink_dir``.

    Runs with an ``availableNow`` trigger (process what is there, then stop);
    the checkpoint makes the sink exactly-once across restarts.
    """
    reader = spark.readStream.schema(RISK_INPUT).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = score(reader.load(source_dir), model)
    q = (stream.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
