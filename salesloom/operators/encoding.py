"""Preparation of model input: one list of stages for training and for scoring."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.scalars import finite_or_zero
from salesloom.operators.cleaning import keep_existing, text_categories

# The columns the models learn from.
NUMERIC = [
    "qty", "amount", "month", "is_weekend", "price_per_unit",
    "has_promotion", "is_high_value", "revenue_7d_ma",
]
CATEGORICAL = ["fulfilment", "ship_service_level", "b2b"]

VECTOR = "features"


def model_rows(features: DataFrame, label: str | None = "cancelled", keys: list[str] | None = None):
    """Numbers as doubles without gaps, categories as text, rows with a label only.

    Input columns that do not exist are left out.
    """
    numbers = keep_existing(features, NUMERIC)
    texts = keep_existing(features, CATEGORICAL)
    rows = text_categories(features, texts) if texts else features
    if label is not None:
        rows = rows.where(F.col(label).isNotNull())
    return rows.select(
        *keep_existing(features, keys or []),
        *[finite_or_zero(F.col(c).cast("double")).alias(c) for c in numbers],
        *texts,
        *([F.col(label).cast("double").alias("label")] if label is not None else []),
    )


def one_hot_stages(categorical: list[str]) -> list:
    """Index and encode. Each known value gets its own slot in alphabetical order.

    The indexer keeps unknown values in one extra last slot and the encoder drops
    the last slot, so a value not seen in training is all zeros.
    """
    if not categorical:
        return []
    indexer = StringIndexer(
        inputCols=categorical,
        outputCols=[f"{c}_index" for c in categorical],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    encoder = OneHotEncoder(
        inputCols=indexer.getOutputCols(),
        outputCols=[f"{c}_flags" for c in categorical],
        dropLast=True,
    )
    return [indexer, encoder]


def feature_names(prepared: PipelineModel, numeric: list[str], categorical: list[str]) -> list[str]:
    names = list(numeric)
    if categorical:
        for column, values in zip(categorical, prepared.stages[0].labelsArray):
            names += [f"{column}_{v}" for v in values]
    return names


def fit_preparation(rows: DataFrame) -> PipelineModel:
    """Encode, assemble and standardise with the population deviation.

    The built-in scaler divides by the sample deviation; the last stage turns
    that into the population deviation.
    """
    numeric = keep_existing(rows, NUMERIC)
    categorical = keep_existing(rows, CATEGORICAL)
    assembler = VectorAssembler(
        inputCols=numeric + [f"{c}_flags" for c in categorical], outputCol="assembled"
    )
    scaler = StandardScaler(
        inputCol="assembled", outputCol="sample_scaled", withMean=True, withStd=True
    )
    first = Pipeline(stages=[*one_hot_stages(categorical), assembler, scaler]).fit(rows)
    n = max(rows.count(), 2)
    width = len(first.stages[-1].mean)
    factor = math.sqrt(n / (n - 1))
    correct = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * width), inputCol="sample_scaled", outputCol=VECTOR
    )
    return PipelineModel(stages=[*first.stages, correct])


def scaled_columns(prepared: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The model input as plain named columns."""
    names = feature_names(prepared, keep_existing(rows, NUMERIC), keep_existing(rows, CATEGORICAL))
    vectors = prepared.transform(rows).withColumn("_v", vector_to_array(VECTOR))
    return vectors.select(*keep, *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])


def one_hot_columns(rows: DataFrame, categorical: list[str], keep: list[str]) -> DataFrame:
    """The 0/1 columns of the categories."""
    fitted = Pipeline(stages=one_hot_stages(categorical)).fit(rows)
    out = fitted.transform(rows)
    flags = []
    for column, values in zip(categorical, fitted.stages[0].labelsArray):
        for i, v in enumerate(values):
            flags.append(vector_to_array(f"{column}_flags")[i].cast("int").alias(f"{column}_{v}"))
    return out.select(*keep, *flags)
