"""Learned scorers on ``pyspark.ml`` and training tables (a recurrent network has no Spark counterpart; the
multilayer perceptron over burst vectors takes its place)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra import constants as K
from kinetra.functions import columns as C

LOCO_FEATURES = ["periodicity", "zcr", "rot_ratio", "dom_hz", "jerk_std"]


def _balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows by classes and class count (one row per class is joined)."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    w = n.crossJoin(F.broadcast(totals)).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))  # one row
    return rows.join(F.broadcast(w), label)  # one row per class


def loco_features(w: DataFrame) -> DataFrame:
    """The five locomotion features of windows."""
    f = lambda c: F.coalesce(F.when(~F.isnan(F.col(c)), F.col(c)), F.lit(0.0))
    return w.select("*", C.rotation_ratio(f("gyro_rms"), f("sma")).alias("rot_ratio"), f("dominant_freq_hz").alias("dom_hz"))


def fit_loco(rows: DataFrame, label: str = "label") -> PipelineModel | None:
    """Balanced logistic regression of bicycling against walking; none below ten rows."""
    own = rows.where(F.col(label).isin("walking", "bicycling")).withColumn("y", (F.col(label) == "bicycling").cast("double"))
    if own.limit(10).count() < 10:
        return None
    stages = [VectorAssembler(inputCols=LOCO_FEATURES, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=0.01)]
    return Pipeline(stages=stages).fit(_balanced(own, "y"))


def predict_loco(model: PipelineModel, rows: DataFrame) -> DataFrame:
    p = F.element_at(vector_to_array("probability"), 2)
    return model.transform(rows).withColumn("loco", F.when(p >= 0.5, "bicycling").otherwise("walking")).drop("raw", "x", "rawPrediction", "probability", "prediction")


def fit_baseline(rows: DataFrame, features: list[str], label: str, c: float = 1.0) -> PipelineModel:
    """Balanced multinomial logistic regression on imputed, standardised features."""
    own = _balanced(rows.where(F.col(label).isNotNull()), label)
    n = own.count()
    imputed = [f"{f}__i" for f in features]
    stages = [StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"), Imputer(strategy="median", inputCols=features, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=1.0 / (c * max(1, n)), standardization=False)]
    return Pipeline(stages=stages).fit(own)


def fit_perceptron(rows: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (32,), seed: int = 0) -> PipelineModel:
    """M13/M14 stand-in: perceptron over burst vectors."""
    classes = rows.select(label).distinct().count()  # the class domain
    net = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[len(features), *hidden, classes], seed=seed, maxIter=60)
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), net]).fit(rows)


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """M7: ``probs`` in class order for a fitted pipeline; classes it has not seen get 0."""
    names = model.stages[0].labels
    v = vector_to_array("probability")
    p = F.array(*[F.element_at(v, names.index(c) + 1) if c in names else F.lit(0.0) for c in K.CLASSES])
    return model.transform(rows).withColumn("probs", p).drop("raw", "x", "y", "rawPrediction", "probability", "prediction")


def placement_onehot(c: Column) -> list[Column]:
    """M26."""
    return [F.when(c == p, 1.0).otherwise(0.0).alias(f"phone_{p}") for p in ("pocket", "hand", "bag", "table")]


def burst_sequences(bursts: DataFrame, steps: int = 400, least: int = 25) -> DataFrame:
    """``(uuid, timestamp, seq, valid)`` with six channels (body and rotation axes) padded or cut to
    ``steps``; bursts with fewer than ``least`` valid steps are left out."""
    from kinetra.plans.recognition import arrow_batch, arrow_schema, decoded

    ddl = "uuid string, timestamp long, seq array<array<float>>, valid array<boolean>"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u, ts, s in decoded(batch):
                n = min(steps, len(s["t"]))
                spin = s["gyro"] if s["gyro"] is not None else np.zeros((len(s["t"]), 3))
                x = np.zeros((steps, 6), dtype=np.float32)
                x[:n] = np.column_stack((s["body"], spin))[:n]
                ok = np.zeros(steps, dtype=bool)
                ok[:n] = np.isfinite(s["body"][:n]).all(axis=1)
                if ok.sum() >= least:
                    out.append({"uuid": u, "timestamp": ts, "seq": np.nan_to_num(x).tolist(), "valid": ok.tolist()})
            yield arrow_batch(out, schema)

    return bursts.select("uuid", "timestamp", "acc", "gyro").mapInArrow(run, ddl)


def burst_vectors(w: DataFrame) -> DataFrame:
    """Means of the window features of each burst."""
    names = ["sma", "vertical_std", "cadence_hz", "dominant_freq_hz", "periodicity", "jerk_mean", "jerk_std", "zcr", "tilt_deg", "gyro_rms", "acc_gyro_phase"]
    return w.groupBy("uuid", "timestamp").agg(*[F.coalesce(F.avg(F.when(~F.isnan(F.col(c)), F.col(c))), F.lit(0.0)).alias(c) for c in names])
