"""Quality of predictions as aggregates over (label, prediction, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.ordered import total_before

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio0(precision * recall * 2, precision + recall)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, exact also with ties.

    Equal scores are combined to (positives, negatives) first. Each positive then
    beats all negatives with a lower score and half of those with the same.
    """
    counts = scored.groupBy(F.col(score).alias("s")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
    )
    placed = total_before(counts.withColumn("_all", F.lit(0)), ["_all"], "s", {"neg": "lower"})
    won = F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.agg(F.try_divide(won, pairs).alias("roc_auc"))


def binary_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction"):
    y, p = F.col(label), F.col(prediction)
    return scored.agg(
        F.count("*").alias("n"),
        F.count(F.when(y == p, 1)).alias("right"),
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
    )


def f1_score(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    precision = _ratio0(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio0(F.col("tp"), F.col("tp") + F.col("fn"))
    return binary_counts(scored, label, prediction).select(_f1(precision, recall).alias("f1"))


def classification_metrics(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "score",
) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC of class 1 in one row."""
    auc = roc_auc(scored, label, score).scalar()
    precision = _ratio0(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio0(F.col("tp"), F.col("tp") + F.col("fn"))
    return binary_counts(scored, label, prediction).select(
        _ratio0(F.col("right"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        auc.alias("roc_auc"),
    )


def confusion_matrix(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per class with its predictions counted, zeros included."""
    y, p = F.col(label), F.col(prediction)
    wide = scored.agg(
        *[
            F.count(F.when((y == a) & (p == b), 1)).alias(f"c{a}{b}")
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    rows = [
        F.struct(
            F.lit(a).alias("actual"),
            F.col(f"c{a}0").alias("predicted_0"),
            F.col(f"c{a}1").alias("predicted_1"),
        )
        for a in (0, 1)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def class_report(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    names: tuple[str, str] = ("Not Cancelled", "Cancelled"),
) -> DataFrame:
    """Precision, recall, F1 and support per class, with both kinds of average."""
    y, p = F.col(label), F.col(prediction)
    wide = scored.agg(
        *[F.count(F.when((y == c) & (p == c), 1)).alias(f"hit{c}") for c in (0, 1)],
        *[F.count(F.when(p == c, 1)).alias(f"said{c}") for c in (0, 1)],
        *[F.count(F.when(y == c, 1)).alias(f"is{c}") for c in (0, 1)],
    )
    parts = {}
    for c in (0, 1):
        precision = _ratio0(F.col(f"hit{c}"), F.col(f"said{c}"))
        recall = _ratio0(F.col(f"hit{c}"), F.col(f"is{c}"))
        parts[c] = {
            "precision": precision, "recall": recall, "f1": _f1(precision, recall),
        }
    total = F.col("is0") + F.col("is1")
    lines = [
        F.struct(
            F.lit(names[c]).alias("class"),
            *[v.alias(k) for k, v in parts[c].items()],
            F.col(f"is{c}").alias("support"),
        )
        for c in (0, 1)
    ]
    for name in ("macro avg", "weighted avg"):
        def mean(k: str) -> Column:
            a, b = parts[0][k], parts[1][k]
            if name == "macro avg":
                return (a + b) / 2
            return _ratio0(a * F.col("is0") + b * F.col("is1"), total)

        lines.append(
            F.struct(
                F.lit(name).alias("class"),
                *[mean(k).alias(k) for k in ("precision", "recall", "f1")],
                total.alias("support"),
            )
        )
    return wide.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def metrics_long(metrics: DataFrame, id_column: str = "model") -> DataFrame:
    """One row per model and metric."""
    return metrics.unpivot(id_column, METRICS, "metric", "value")
