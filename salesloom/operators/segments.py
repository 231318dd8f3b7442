"""k-means segments on scaled RFM values, with readable labels."""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.workspace import stage

MEASURES = ["recency", "frequency", "monetary"]
SCALED = [f"z_{m}" for m in MEASURES]

# Each run of k-means keeps its own copy of the rows in the executors while it lasts.
RUNS_AT_ONCE = 2

# Rules on a segment's centre, first match wins. Each entry is a
# label and its conditions as (measure, comparison, bound).
LABEL_RULES = [
    ("Champions", [("frequency", ">", 3), ("monetary", ">", 5000)]),
    ("Loyal Customers", [("recency", "<", 30), ("frequency", ">", 1)]),
    ("Potential Loyalists", [("recency", "<", 60), ("monetary", ">", 2000)]),
    ("Big Spenders", [("monetary", ">", 3000), ("frequency", "<", 2)]),
    ("At Risk", [("recency", ">", 180)]),
    ("Needs Attention", [("recency", ">", 90)]),
    ("Frequent Buyers", [("frequency", ">", 5)]),
]


def log_stats(rfm: DataFrame) -> DataFrame:
    """One row with mean and population deviation of log1p of each measure."""
    return rfm.agg(
        *[F.avg(F.log1p(m)).alias(f"mean_{m}") for m in MEASURES],
        *[F.stddev_pop(F.log1p(m)).alias(f"std_{m}") for m in MEASURES],
    )


def scale_rfm(rfm: DataFrame) -> DataFrame:
    """Adds the standardised log1p of each measure; a constant measure becomes 0."""
    stats = log_stats(rfm)
    row = stats.select(F.struct(*stats.columns)).scalar()
    marked = rfm.withColumn("_s", row)
    for m, z in zip(MEASURES, SCALED):
        spread = F.col(f"_s.std_{m}")
        centred = F.log1p(m) - F.col(f"_s.mean_{m}")
        marked = marked.withColumn(z, F.when(spread == 0, centred).otherwise(centred / spread))
    return marked.drop("_s")


def assign_to_centres(scaled: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Adds the number (as text) of the nearest of a few given centres."""
    distances = [
        sum(
            ((F.col(z) - F.lit(float(v))) * (F.col(z) - F.lit(float(v))) for z, v in zip(SCALED, c)),
            F.lit(0.0),
        )
        for c in centres
    ]
    nearest = F.array_position(F.array(*distances), F.array_min(F.array(*distances))) - 1
    return scaled.withColumn("segment", nearest.cast("string"))


def label_of(segment: Column, recency: Column, frequency: Column, monetary: Column) -> Column:
    """The label rules as one CASE over a segment's centre."""
    at = {"recency": recency, "frequency": frequency, "monetary": monetary}
    out = None
    for label, conditions in LABEL_RULES:
        test = None
        for measure, sign, bound in conditions:
            one = at[measure] > bound if sign == ">" else at[measure] < bound
            test = one if test is None else test & one
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.concat(F.lit("Segment "), segment))


def label_centres(
    rfm: DataFrame, centres: list[list[float]], space: str = "original"
) -> DataFrame:
    """(segment, segment_label, centre) for scaled centres.

    ``space="original"`` compares days, counts and money with the rules;
    ``space="log"`` compares the logarithms.
    """
    if space not in ("original", "log"):
        raise ValueError("space is 'original' or 'log'")
    stats = log_stats(rfm)
    rows = stats.select(
        "*", F.posexplode(F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres]))
    )
    centre = {
        m: F.col("col")[i] * F.col(f"std_{m}") + F.col(f"mean_{m}") for i, m in enumerate(MEASURES)
    }
    if space == "original":
        centre = {m: F.expm1(v) for m, v in centre.items()}
    named = rows.select(
        F.col("pos").cast("string").alias("segment"),
        *[v.alias(f"centre_{m}") for m, v in centre.items()],
    )
    return named.withColumn(
        "segment_label",
        label_of(F.col("segment"), *[F.col(f"centre_{m}") for m in MEASURES]),
    )


def with_labels(segmented: DataFrame, labels: DataFrame) -> DataFrame:
    """Join the labels on; they have one row per cluster."""
    return segmented.join(
        F.broadcast(labels.select("segment", "segment_label")), "segment", "left"
    )


@dataclass
class Segmentation:
    rows: DataFrame
    model: KMeansModel
    labels: DataFrame


def segment_customers(
    rfm: DataFrame,
    k: int = 4,
    seed: int = 42,
    restarts: int = 10,
    space: str = "original",
    max_iter: int = 300,
) -> Segmentation:
    """The best of several k-means runs on the scaled measures.

    The rows and their scaled form are written once and every run reads them, a few at
    the same time: an iteration is one short job. Only centres travel to the driver.
    """
    rfm = stage(rfm, "rfm")
    assembled = VectorAssembler(inputCols=SCALED, outputCol="_features").transform(
        stage(scale_rfm(rfm), "scaled-rfm")
    )

    def fitted(run: int) -> KMeansModel:
        return KMeans(
            k=k, seed=seed + run, maxIter=max_iter, tol=math.sqrt(1e-4 / k),
            featuresCol="_features", predictionCol="_segment",
        ).fit(assembled)

    with ThreadPool(max(1, min(RUNS_AT_ONCE, restarts))) as pool:
        models = pool.map(inheritable_thread_target(rfm.sparkSession)(fitted), range(restarts), chunksize=1)
    best = min(models, key=lambda model: model.summary.trainingCost)
    centres = [[float(v) for v in c] for c in best.clusterCenters()]
    labels = label_centres(rfm, centres, space)
    rows = best.transform(assembled).withColumn("segment", F.col("_segment").cast("string"))
    return Segmentation(with_labels(rows.drop("_features", "_segment"), labels), best, labels)
