"""Splits, class weights, classifiers, grid search and model comparison.

Rows are written once and every fit reads them from there; only class counts, metrics,
importances and fitted models reach the driver. A comparison searches and fits on all
training rows and measures on all test rows. Its search is one written table with a
score for every setting and fold, from which the best settings follow.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesloom.functions.scalars import hash_fraction, lookup
from salesloom.operators import encoding, metrics
from salesloom.operators.cleaning import keep_existing
from salesloom.workspace import shared_dir, stage

SEED = 42
FOLDS = 3

# Fits that run side by side: a single fit of small data keeps few cores busy. Each holds
# its rows in memory or on disk, so that of ``SINGLE_ROWS`` rows and more one runs at a time.
PARALLELISM, SINGLE_ROWS = 8, 2_000_000
# Rows of a fit in one partition at least: most of a small fit is the start of tasks.
PARTITION_ROWS = 10_000
# Rows of a ``bounded_sample``, which no fit of this module is made on.
SAMPLE_ROWS = 10_000
# What a fit raises for settings or rows that it cannot work with.
FIT_ERRORS = (PySparkException, Py4JError, ValueError)

# The searched settings. A depth of None means "not limited"; the
# deepest tree Spark grows has 30 levels. Such trees grow with the data and are
# kept on the driver, so on large data give the forest a depth.
GRIDS = {
    "Logistic Regression": {"c": [0.1, 1.0]},
    "Random Forest": {"max_depth": [10, None], "min_samples_split": [2, 5]},
    "Gradient Boosting": {"learning_rate": [0.05, 0.1], "max_depth": [3, 5]},
}
MODEL_NAMES = list(GRIDS)
DEEPEST = 30
MOST_CLASSES = 2


def random_rows(df: DataFrame, keys: list[str], n: int, seed: int = SEED) -> DataFrame:
    """At most n rows, picked by a hash of row key and seed; a top-n, not a full sort."""
    return df.orderBy(hash_fraction(keys, seed), *keys).limit(n)


def train_test_split(
    df: DataFrame,
    keys: list[str],
    label: str | None = None,
    test_share: float = 0.2,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the row key, within each label where one is given.

    A row's side depends on nothing but the row, so the split needs no shuffle
    and comes out the same in every run. Each label gives its share up to chance.
    """
    where = hash_fraction([label, *keys] if label else keys, seed)
    return df.where(where >= test_share), df.where(where < test_share)


def bounded_sample(
    rows: DataFrame, keys: list[str], label: str = "label", most: int = SAMPLE_ROWS, seed: int = SEED
) -> DataFrame:
    """The rows with the smallest hashes of each label, all labels in proportion.

    All rows where there are at most ``most``, else one row per label more at most. The
    choice depends on keys and seed only.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    quota = F.least(F.col("_n"), F.ceil(F.col("_n") * most / total))
    counts = counts.select(label, quota.alias("_quota"))
    order = Window.partitionBy(label).orderBy(hash_fraction(keys, seed + 2), *keys)
    # The fixed bound keeps all but ``most`` rows of a label out of the shuffle.
    ranked = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    chosen = ranked.join(counts, label).where(F.col("_place") <= F.col("_quota"))
    return chosen.select(rows.columns)


def with_fold(df: DataFrame, keys: list[str], folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    fold = F.floor(hash_fraction(keys, seed + 1) * folds).cast("int")
    return df.withColumn("fold", fold)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "n", (F.col("_t.rows") / (F.col("_t.k") * F.col("n"))).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    found = class_weights(df, label).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    weights = {r[label]: r["weight"] for r in found}
    return df.withColumn("weight", lookup(F.col(label), weights, 1.0))


def classifier(name: str, rows: int, c: float = 1.0, max_depth: int | None = None,
               min_samples_split: int = 2, learning_rate: float = 0.1, max_iter: int = 2000,
               trees: int = 100):
    """An unfitted classifier; ``rows`` turns the inverse strength C into Spark's."""
    common = {"featuresCol": encoding.VECTOR, "labelCol": "label"}
    if name == "Logistic Regression":
        return LogisticRegression(
            **common, weightCol="weight", maxIter=max_iter, tol=1e-6, standardization=False,
            elasticNetParam=0.0, regParam=1.0 / (c * max(rows, 1)),
        )
    if name == "Random Forest":
        return RandomForestClassifier(
            **common, weightCol="weight", numTrees=trees, seed=SEED, maxMemoryInMB=512,
            # The same trees; rows keep their nodes, so no task gets the trees grown so far.
            cacheNodeIds=True,
            maxDepth=DEEPEST if max_depth is None else max_depth,
            minInstancesPerNode=max(1, min_samples_split // 2),
        )
    if name == "Gradient Boosting":
        return GBTClassifier(
            **common, maxIter=trees, stepSize=learning_rate, seed=SEED,
            maxDepth=3 if max_depth is None else max_depth,
        )
    raise ValueError(f"unknown classifier {name}")


def param_grid(name: str) -> list[dict]:
    grid = GRIDS[name]
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def with_score(predicted: DataFrame) -> DataFrame:
    """Probability of class 1; a model that saw one class only has none, so 0."""
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return predicted.withColumn("score", F.coalesce(chance, F.lit(0.0)))


@dataclass
class Trained:
    name: str
    model: PipelineModel
    feature_names: list[str]
    best_params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    candidates: list[dict] = field(default_factory=list)


@dataclass
class Prepared:
    """Training vectors with the stages that made them."""

    stages: PipelineModel
    rows: DataFrame
    count: int
    names: list[str]


def prepare(train: DataFrame, written: bool = False) -> Prepared:
    """Fit the preparation, write the vectors once, with class weights.

    Of rows that are ``written`` already the vectors are made as they are read.
    """
    shared_dir(train.sparkSession)
    fitted = encoding.fit_preparation(train)
    vectors = fitted.transform(train)
    rows = with_class_weight(vectors.select("label", encoding.VECTOR))
    rows = rows if written else stage(rows, "vectors")
    numeric = keep_existing(train, encoding.NUMERIC)
    categorical = keep_existing(train, encoding.CATEGORICAL)
    names = encoding.feature_names(fitted, numeric, categorical)
    return Prepared(fitted, rows, rows.count(), names)


SEARCH = "model string, setting int, params string, fold int, f1 double, failure string"


def _side_by_side(spark: SparkSession, work: Callable, jobs: list, parallelism: int) -> list:
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), jobs, chunksize=1)


def _start(name: str, params: dict) -> tuple:
    """Place of a fit among those that run side by side: the longest fits start first.

    Boosting fits its trees one after the other, the deepest longest; trees without a
    depth limit follow.
    """
    depth = params.get("max_depth", 0)
    return name != "Gradient Boosting", -(DEEPEST if depth is None else depth)


def search_scores(
    names: list[str], train: DataFrame, keys: list[str], folds: int = FOLDS,
    parallelism: int = PARALLELISM, grids: dict[str, list[dict]] | None = None,
    settings: dict[str, dict] | None = None,
) -> DataFrame:
    """A written table with the F1 of every model, setting and fold.

    Preparation is fitted on the training part of each fold and shared by all models
    and settings of that fold. A fit that fails has no score but the reason.
    """
    parts = fold_parts(folded(train, keys, folds), folds, parallelism)
    return scores_on(parts, names, train.sparkSession, parallelism, grids, settings)


def _inputs(rows: DataFrame) -> DataFrame:
    """What fits and metrics read of the rows: neither keys nor other columns."""
    return rows.select(keep_existing(rows, [*encoding.NUMERIC, *encoding.CATEGORICAL, "label", "fold"]))


def folded(train: DataFrame, keys: list[str], folds: int = FOLDS) -> DataFrame:
    """The rows with the number of their fold, written once."""
    rows = stage(_inputs(with_fold(train, keys, folds)), "folds")
    return rows.coalesce(max(1, math.ceil(rows.count() / PARTITION_ROWS)))


def fold_parts(rows: DataFrame, folds: int = FOLDS, parallelism: int = PARALLELISM) -> list:
    """Per fold its ``Prepared`` training rows, its rows to score, and why it has none.

    ``rows`` are written, with a fold; nothing is written a second time.
    """

    def parts(k: int):
        try:
            part = prepare(rows.where(F.col("fold") != k).drop("fold"), written=True)
            held = part.stages.transform(rows.where(F.col("fold") == k))
            return part, held.select("label", encoding.VECTOR), None
        except FIT_ERRORS as e:
            return None, None, str(e)

    return _side_by_side(rows.sparkSession, parts, list(range(folds)), parallelism)


def _fits_at_once(rows: int, parallelism: int) -> int:
    """How many fits of so many rows run side by side; their results do not depend on it."""
    return max(1, min(parallelism, SINGLE_ROWS // max(rows, 1)))


def scores_on(
    parts: list, names: list[str], spark: SparkSession, parallelism: int = PARALLELISM,
    grids: dict[str, list[dict]] | None = None, settings: dict[str, dict] | None = None,
) -> DataFrame:
    """``search_scores`` on the ``fold_parts`` that were made before."""

    def score(job: tuple) -> tuple:
        name, i, params, k = job
        part, held, failure = parts[k]
        f1 = None
        if part is not None:
            try:
                chosen = classifier(name, part.count, **{**(settings or {}).get(name, {}), **params})
                f1 = metrics.f1_score(chosen.fit(part.rows).transform(held)).first()["f1"]
            except FIT_ERRORS as e:
                failure = str(e)
        return name, i, json.dumps(params), k, f1, failure

    jobs = [
        (name, i, params, k)
        for name in reversed(names)
        for i, params in enumerate((grids or {}).get(name) or param_grid(name))
        for k in range(len(parts))
    ]
    jobs.sort(key=lambda job: _start(job[0], job[2]))
    most = max((part.count for part, _, _ in parts if part is not None), default=0)
    found = _side_by_side(spark, score, jobs, _fits_at_once(most, parallelism))
    return stage(spark.createDataFrame(found, SEARCH), "search")


def ranked_settings(scores: DataFrame) -> DataFrame:
    """model, setting, params, mean_f1 and place, best first within a model.

    A setting that failed in a fold is left out. Of equals the earlier setting wins.
    """
    means = scores.groupBy("model", "setting", "params").agg(
        F.avg("f1").alias("mean_f1"), F.count(F.when(F.col("f1").isNull(), 1)).alias("failed")
    )
    order = Window.partitionBy("model").orderBy(F.desc("mean_f1"), "setting")
    kept = means.where("failed = 0").drop("failed")
    return kept.withColumn("place", F.row_number().over(order))


def _candidates(scores: DataFrame, name: str) -> list[dict]:
    found = ranked_settings(scores.where(F.col("model") == name)).orderBy("place").collect()
    return [{"params": json.loads(r.params), "mean_f1": r.mean_f1} for r in found]


def search(
    name: str, train: DataFrame, keys: list[str], folds: int = FOLDS, parallelism: int = PARALLELISM,
    grid: list[dict] | None = None, **settings,
) -> list[dict]:
    """Mean F1 of each setting over the folds, best first; settings that fail are left out."""
    grids = {name: grid} if grid else None
    scores = search_scores([name], train, keys, folds, parallelism, grids, {name: settings})
    return _candidates(scores, name)


def _searchable(prepared: Prepared) -> bool:
    """Whether there are two classes, and a class with a row for every fold."""
    classes = prepared.rows.groupBy("label").count().agg(F.count("*"), F.max("count")).first()
    return classes[0] > 1 and classes[1] >= FOLDS


def _fitted(name: str, prepared: Prepared, test: DataFrame, candidates: list[dict], settings: dict) -> Trained:
    best = candidates[0]["params"] if candidates else {}
    fitted = classifier(name, prepared.count, **{**settings, **best}).fit(prepared.rows)
    model = PipelineModel(stages=[*prepared.stages.stages, fitted])
    scored = stage(
        with_score(model.transform(test)).select("label", "prediction", "score"), "scored"
    )
    quality = metrics.classification_metrics(scored).first().asDict()
    return Trained(name, model, prepared.names, best, quality, candidates)


def train_and_evaluate(
    name: str,
    train: DataFrame,
    test: DataFrame,
    keys: list[str],
    grid: bool = True,
    prepared: Prepared | None = None,
    **settings,
) -> Trained:
    """Search the grid if wanted, fit on all training rows, measure on the test rows.

    The search is skipped where there is a single class, or where no class has a
    row for every fold. Where no setting can be fitted, the plain one is.
    """
    prepared = prepared or prepare(train)
    wanted = grid and _searchable(prepared)
    candidates = search(name, train, keys, **settings) if wanted else []
    return _fitted(name, prepared, test, candidates, settings)


@dataclass
class ComparisonRows:
    """The rows that a comparison is made on: training rows with their fold and test rows,
    both written, and the vectors of the training rows."""

    train: DataFrame
    prepared: Prepared
    test: DataFrame


def comparison_rows(train: DataFrame, test: DataFrame, keys: list[str]) -> ComparisonRows:
    """All training rows and all test rows, each written once."""
    rows = folded(train, keys)
    return ComparisonRows(rows, prepare(rows.drop("fold"), written=True), stage(_inputs(test), "test"))


@dataclass
class Comparison:
    """Models, best area under the curve first, the scores of the search, if any, and the
    rows that all were fitted on."""

    results: list[Trained]
    scores: DataFrame | None
    prepared: Prepared


def tuned_comparison(
    train: DataFrame, test: DataFrame, keys: list[str], grid: bool = True,
    settings: dict[str, dict] | None = None, names: list[str] | None = None,
    parallelism: int = PARALLELISM, grids: dict[str, list[dict]] | None = None,
) -> Comparison:
    """Search, refit and measure the classifiers on the same rows.

    Search and fits use all training rows, the metrics all test rows. ``settings`` holds
    per model what differs from its defaults.
    """
    return comparison_on(comparison_rows(train, test, keys), grid, settings, names, parallelism, grids)


def comparison_on(
    rows: ComparisonRows, grid: bool = True,
    settings: dict[str, dict] | None = None, names: list[str] | None = None,
    parallelism: int = PARALLELISM, grids: dict[str, list[dict]] | None = None,
) -> Comparison:
    """``tuned_comparison`` on rows written before. A model comes out the same whichever
    others are compared with it.

    The models of small data are searched at the same time, each with up to ``parallelism``
    fits, and none waits for the search of another before its refit: boosting starts many
    short jobs one after the other, which leave cores to the forests. Large data is fitted
    by one model after the other.
    """
    spark = rows.train.sparkSession
    names, prepared = names or MODEL_NAMES, rows.prepared
    parts = fold_parts(rows.train, parallelism=parallelism) if grid and _searchable(prepared) else None

    def make(name: str) -> tuple[Trained, DataFrame | None]:
        scores, candidates = None, []
        if parts is not None:
            scores = scores_on(parts, [name], spark, parallelism, grids, settings)
            candidates = _candidates(scores, name)
        return _fitted(name, prepared, rows.test, candidates, (settings or {}).get(name, {})), scores

    made = _side_by_side(spark, make, names, _fits_at_once(prepared.count, len(names)))
    scores = None if parts is None else reduce(DataFrame.unionByName, [s for _, s in made])
    return Comparison(best_first([r for r, _ in made]), scores, prepared)


def best_first(results: list[Trained]) -> list[Trained]:
    return sorted(results, key=lambda r: -(r.metrics["roc_auc"] or 0.0))


def compare_models(
    train: DataFrame, test: DataFrame, keys: list[str], grid: bool = True,
    settings: dict[str, dict] | None = None, names: list[str] | None = None, **options,
) -> list[Trained]:
    """The classifiers of ``tuned_comparison``, best area under the curve first."""
    return tuned_comparison(train, test, keys, grid, settings, names, **options).results


def comparison_table(spark: SparkSession, results: list[Trained]) -> DataFrame:
    """One row per model with its metrics and best settings."""
    rows = [
        (r.name, *[float(r.metrics[m] or 0.0) for m in metrics.METRICS], str(r.best_params))
        for r in results
    ]
    schema = "model string, " + ", ".join(f"{m} double" for m in metrics.METRICS)
    return spark.createDataFrame(rows, schema + ", best_params string").orderBy(
        F.col("roc_auc").desc(), "model"
    )


def feature_importance(spark: SparkSession, trained: Trained) -> DataFrame:
    """Coefficients or impurity importances, largest signed value first."""
    last = trained.model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [
        (n, float(v), abs(float(v))) for n, v in zip(trained.feature_names, values.toArray())
    ]
    return spark.createDataFrame(
        rows, "feature string, importance double, abs_importance double"
    ).orderBy(F.col("importance").desc(), "feature")


def score_equations(trained: Trained, prepared: Prepared) -> DataFrame:
    """(feature, slope): slope of the loss of a logistic regression at its solution.

    The loss is the weighted mean of the log loss and the penalty, so each slope is 0 up to
    the tolerance of the fit. The intercept has no penalty.
    """
    model = trained.model.stages[-1]
    rows = with_score(model.transform(prepared.rows)).withColumn("_x", vector_to_array(encoding.VECTOR))
    miss = F.col("weight") * (F.col("score") - F.col("label"))
    names = [*prepared.names, "intercept"]
    sides = [miss * F.col("_x")[j] for j in range(len(prepared.names))] + [miss]
    pulls = [model.getRegParam() * float(b) for b in model.coefficients] + [0.0]
    wide = rows.agg(F.sum("weight").alias("w"), *[F.sum(s).alias(f"s{j}") for j, s in enumerate(sides)])
    listed = [
        F.struct(F.lit(n).alias("feature"), (F.col(f"s{j}") / F.col("w") + F.lit(pull)).alias("slope"))
        for j, (n, pull) in enumerate(zip(names, pulls, strict=True))
    ]
    return wide.select(F.inline(F.array(*listed)))


BASELINE = [
    "qty", "amount", "month", "is_weekend", "b2b", "fulfilment", "service_level", "category",
]


def baseline_model(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients of a balanced logistic regression on the plain baseline features.

    ``rows`` is the output of ``baseline_features``; the model sees it unscaled.
    """
    spark = rows.sparkSession
    train, _test = train_test_split(rows, keys, "is_cancelled")
    labelled = train.withColumn("label", F.col("is_cancelled").cast("double"))
    vectors = VectorAssembler(inputCols=BASELINE, outputCol=encoding.VECTOR).transform(
        with_class_weight(labelled)
    )
    data = stage(vectors.select("label", "weight", encoding.VECTOR), "baseline-vectors")
    model = classifier("Logistic Regression", data.count(), max_iter=1000).fit(data)
    coefficients = [(n, float(v)) for n, v in zip(BASELINE, model.coefficients.toArray())]
    return spark.createDataFrame(coefficients, "feature string, coefficient double").orderBy(
        F.col("coefficient").desc()
    )
