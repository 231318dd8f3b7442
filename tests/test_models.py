"""Preparation, splits, training, persistence, scoring and streaming."""

import glob
import math
import threading

import pytest
from pyspark.sql import functions as F

from salesloom.functions.pvalues import two_sided_t
from salesloom.operators import encoding, features, persistence, scoring, segments, training
from salesloom.plans import QUERIES
from salesloom.plans import model_queries as mq
from salesloom.plans.customer_queries import KEY
from salesloom.streaming.scoring import stream_rejections, stream_scores
from salesloom.workspace import new_path, run_dir, stage


@pytest.fixture(scope="module")
def rows(tables):
    return stage(mq.model_input(tables), "test-input")


@pytest.fixture(scope="module")
def bundle(tables):
    return mq.saved_bundle(tables)


def test_unseen_category_is_all_zeros(rows):
    fitted = encoding.fit_preparation(rows)
    odd = rows.limit(3).withColumn("fulfilment", F.lit("Drone"))
    out = encoding.Pipeline(stages=encoding.one_hot_stages(["fulfilment"])).fit(rows).transform(odd)
    assert all(r.fulfilment_flags.toArray().tolist() == [0.0, 0.0] for r in out.collect())
    assert len(encoding.feature_names(fitted, encoding.NUMERIC, encoding.CATEGORICAL)) == 14


def test_joined_sales_are_gone_when_features_are_made(spark, tables):
    found = mq.featured(tables)
    assert not glob.glob(f"{run_dir(spark)}/sales-*")
    assert found.count() == tables.sales.count()
    want = features.engineer_features(tables.sales.select(mq._INPUT), KEY)
    plain = [d.withColumn("revenue_7d_ma", F.round("revenue_7d_ma", 6)) for d in (found, want)]
    assert plain[0].exceptAll(plain[1]).count() == 0


def test_split_is_disjoint_complete_and_repeatable(rows):
    train, test = training.train_test_split(rows, KEY, "label")
    again, _ = training.train_test_split(rows.repartition(5), KEY, "label")
    assert train.count() + test.count() == rows.count()
    assert train.select(KEY).intersect(test.select(KEY)).count() == 0
    assert train.select(KEY).exceptAll(again.select(KEY)).count() == 0
    shares = [
        test.where(F.col("label") == c).count() / rows.where(F.col("label") == c).count()
        for c in (0, 1)
    ]
    assert all(abs(s - 0.2) < 0.04 for s in shares)


def test_training_learns(spark, easy):
    train, test = training.train_test_split(easy, KEY, "label")
    results = training.compare_models(
        train, test, KEY, grid=False,
        settings={"Random Forest": {"max_depth": 4, "trees": 5}, "Gradient Boosting": {"trees": 3}},
    )
    assert {r.name for r in results} == set(training.MODEL_NAMES)
    assert all(r.metrics["roc_auc"] > 0.95 for r in results)
    table = training.comparison_table(spark, results).collect()
    assert [r.roc_auc for r in table] == sorted((r.roc_auc for r in table), reverse=True)
    importance = training.feature_importance(spark, results[0])
    assert importance.count() == 14
    strongest = importance.orderBy(F.col("abs_importance").desc()).first().feature
    assert strongest == "qty"


def test_search_uses_every_candidate(rows):
    for name, extra in (("Random Forest", {"trees": 2}), ("Gradient Boosting", {"trees": 2})):
        grid = [{**c, "max_depth": c["max_depth"] or 5} for c in training.param_grid(name)]
        ranked = training.search(name, rows, KEY, folds=2, grid=grid, **extra)
        assert len(ranked) == 4
        assert ranked[0]["mean_f1"] >= ranked[-1]["mean_f1"]


@pytest.fixture(scope="module")
def easy(rows):
    """A target that the inputs explain, so that every model has something to find."""
    return rows.withColumn("label", (F.col("qty") > 25).cast("double"))


def test_sample_is_bounded_repeatable_and_in_proportion(rows):
    got = training.bounded_sample(rows, KEY, most=500)
    again = training.bounded_sample(rows.repartition(5), KEY, most=500)
    assert got.columns == rows.columns and 500 <= got.count() <= 502
    assert got.exceptAll(again).count() == 0
    whole, part = (training.class_weights(d).orderBy("label").collect() for d in (rows, got))
    for a, b in zip(whole, part, strict=True):
        assert b.n == math.ceil(500 * a.n / rows.count())
    assert training.bounded_sample(rows, KEY, most=10**6).exceptAll(rows).count() == 0
    assert training.bounded_sample(rows, KEY, most=10**6).count() == rows.count()
    assert training.bounded_sample(rows.limit(0), KEY).count() == 0


def test_a_comparison_fits_on_all_training_rows(spark):
    n = training.SAMPLE_ROWS + 2_500
    rows = spark.range(n).select(
        "id", (F.col("id") % 50).cast("double").alias("qty"), (F.col("id") % 7).cast("double").alias("amount"),
        F.when(F.col("id") % 2 == 0, "Amazon").otherwise("Merchant").alias("fulfilment"),
        (F.col("id") % 50 > 24).cast("double").alias("label"),
    )
    made = training.comparison_rows(rows, rows.limit(100), ["id"])
    assert made.prepared.count == made.prepared.rows.count() == n
    parts = training.fold_parts(made.train)
    assert [failure for *_, failure in parts] == [None] * training.FOLDS
    assert all(part.count + held.count() == n for part, held, _ in parts)
    assert sum(held.count() for _, held, _ in parts) == n


def test_fits_of_many_rows_run_one_at_a_time():
    most = training.SINGLE_ROWS
    assert [training._fits_at_once(n, 8) for n in (0, 10_000, most // 4, most, 50 * most)] == [8, 8, 4, 1, 1]


def test_a_failing_setting_is_left_out(easy):
    grids = {
        "Logistic Regression": [{"c": -1.0}, {"c": 1.0}],
        "Gradient Boosting": [{"learning_rate": 5.0}, {"learning_rate": -1.0}],
    }
    few = training.bounded_sample(easy, KEY, most=600)
    train, test = training.train_test_split(few, KEY, "label")
    found = training.tuned_comparison(
        train, test, KEY, names=list(grids), grids=grids, settings={"Gradient Boosting": {"trees": 2}}
    )
    table = found.scores.collect()
    assert len(table) == 4 * training.FOLDS
    for r in table:
        failed = r.model == "Gradient Boosting" or '"c": -1.0' in r.params
        assert (r.f1 is None) == failed and bool(r.failure) == failed
    one, two = sorted(found.results, key=lambda r: r.name, reverse=True)
    assert one.best_params == {"c": 1.0} and len(one.candidates) == 1
    # All settings fail: a plain fit, as where nothing is searched.
    assert two.best_params == {} and two.candidates == [] and two.metrics["accuracy"] > 0.9


def test_forest_keeps_its_trees_with_cached_nodes(rows):
    prepared = training.prepare(training.bounded_sample(rows, KEY, most=400).coalesce(1))
    forest = training.classifier("Random Forest", prepared.count, trees=3)
    assert forest.getCacheNodeIds()
    plain = forest.copy().setCacheNodeIds(False).fit(prepared.rows)
    one, two = (m.toDebugString.split("\n", 1)[1] for m in (forest.fit(prepared.rows), plain))
    assert one == two


def test_a_query_on_one_model_fits_no_other(tables, rows, monkeypatch):
    few = training.bounded_sample(rows, KEY, most=600)
    split = training.train_test_split(few, KEY, "label")
    fitted, made, make = [], {}, training.classifier

    def classifier(name, *args, **params):
        fitted.append(name)
        return make(name, *args, **(params if name == "Logistic Regression" else {**params, "trees": 1, "max_depth": 2}))

    def once(t, name, build):
        if name not in made:
            made[name] = build()
        return made[name]

    monkeypatch.setattr(mq, "split_input", lambda t: split)
    monkeypatch.setattr(mq, "_once", once)
    monkeypatch.setattr(training, "classifier", classifier)
    found = QUERIES["ml08_logistic_regression"](tables).collect()
    assert [r.model for r in found] == ["Logistic Regression"]
    assert fitted == ["Logistic Regression"] * (2 * training.FOLDS + 1)
    # The comparison of all three makes the other two only, and holds all scores.
    whole = mq.compared(tables)
    assert fitted.count("Logistic Regression") == 2 * training.FOLDS + 1
    assert {r.name for r in whole.results} == set(training.MODEL_NAMES)
    assert whole.scores.count() == 10 * training.FOLDS
    assert whole.scores.where("f1 IS NULL").count() == 0


def test_a_refit_waits_for_no_other_search(easy, monkeypatch):
    few = training.bounded_sample(easy, KEY, most=600)
    train, test = training.train_test_split(few, KEY, "label")
    refitted, waited, make, fit = threading.Event(), [], training.classifier, training._fitted

    def classifier(name, *args, **params):
        if name == "Random Forest":
            waited.append(refitted.wait(60))
        return make(name, *args, **params)

    def fitted(name, *args):
        found = fit(name, *args)
        if name == "Logistic Regression":
            refitted.set()
        return found

    monkeypatch.setattr(training, "classifier", classifier)
    monkeypatch.setattr(training, "_fitted", fitted)
    names = ["Logistic Regression", "Random Forest"]
    found = training.tuned_comparison(
        train, test, KEY, names=names, grids={"Random Forest": [{"max_depth": 3}]},
        settings={"Random Forest": {"trees": 2}},
    )
    assert waited == [True] * (training.FOLDS + 1)
    assert {r.name for r in found.results} == set(names)
    assert {(r.model, r.setting, r.fold) for r in found.scores.collect()} == {
        (name, i, k)
        for name, n in (("Logistic Regression", 2), ("Random Forest", 1))
        for i in range(n) for k in range(training.FOLDS)
    }


def test_the_longest_fits_start_first():
    jobs = [(n, p) for n in training.MODEL_NAMES for p in training.param_grid(n)]
    names, depths = zip(*[(n, p.get("max_depth", 0)) for n, p in sorted(jobs, key=lambda j: training._start(*j))])
    assert names == ("Gradient Boosting",) * 4 + ("Random Forest",) * 4 + ("Logistic Regression",) * 2
    assert depths == (5, 5, 3, 3, None, None, 10, 10, 0, 0)


def test_best_setting_follows_from_the_written_scores(spark):
    rows = [
        ("a", 0, "{}", 0, 0.5, None), ("a", 0, "{}", 1, 0.7, None),
        ("a", 1, "{}", 0, 0.6, None), ("a", 1, "{}", 1, 0.6, None),
        ("a", 2, "{}", 0, 0.9, None), ("a", 2, "{}", 1, None, "no"),
        ("b", 0, "{}", 0, 0.1, None), ("b", 0, "{}", 1, 0.1, None),
    ]
    ranked = training.ranked_settings(spark.createDataFrame(rows, training.SEARCH)).collect()
    assert {(r.model, r.setting, r.place) for r in ranked} == {("a", 0, 1), ("a", 1, 2), ("b", 0, 1)}


def test_single_class_skips_the_search(rows):
    only = rows.withColumn("label", F.lit(0.0))
    train, test = training.train_test_split(only, KEY)
    trained = training.train_and_evaluate("Logistic Regression", train, test, KEY)
    assert trained.candidates == [] and trained.metrics["accuracy"] == 1.0
    assert trained.metrics["roc_auc"] is None


def test_class_weights(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 2, "label double")
    got = {r.label: r.weight for r in training.class_weights(df).collect()}
    assert got == {0.0: pytest.approx(8 / 12), 1.0: 2.0}


def test_missing_bundle_is_none(spark):
    assert persistence.load_bundle(spark, new_path(spark, "nothing")) is None


def test_bundle_round_trip(spark, tables, bundle):
    path = new_path(spark, "again")
    persistence.save_bundle(spark, bundle, path)
    back = persistence.load_bundle(spark, path)
    assert back.features == bundle.features and back.metrics == bundle.metrics
    one = scoring.score_requests(mq.requests(tables.sales_raw), bundle, KEY)
    two = scoring.score_requests(mq.requests(tables.sales_raw), back, KEY)
    assert one.exceptAll(two).count() == 0
    info = persistence.model_info(spark, back).first()
    assert info.feature_count == 14 and set(info.metrics) >= {"accuracy", "roc_auc"}


def test_scores_and_bands(tables, bundle):
    out = scoring.score_requests(mq.requests(tables.sales_raw), bundle, KEY)
    bad = out.where("cancellation_probability NOT BETWEEN 0 AND 1").count()
    assert bad == 0
    valid = scoring.valid_requests(mq.requests(tables.sales_raw)).count()
    rejected = scoring.rejected_requests(mq.requests(tables.sales_raw)).count()
    assert out.count() == valid and valid + rejected == tables.sales_raw.count()


def test_stream_equals_batch_and_restarts_without_copies(spark, tables, bundle):
    # The stream reads requests from files, the batch reads the same requests.
    source = new_path(spark, "requests")
    mq.requests(tables.sales_raw).write.parquet(source)
    batch = spark.read.parquet(source)
    path, log = new_path(spark, "scores"), new_path(spark, "scores-log")
    for _ in range(2):
        stream = spark.readStream.schema(batch.schema).parquet(source)
        stream_scores(stream, bundle, KEY, path, log).awaitTermination()
    want = scoring.score_requests(batch, bundle, KEY)
    got = spark.read.schema(want.schema).parquet(path)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    path, log = new_path(spark, "rejected"), new_path(spark, "rejected-log")
    stream = spark.readStream.schema(batch.schema).parquet(source)
    stream_rejections(stream, path, log).awaitTermination()
    assert spark.read.parquet(path).count() == scoring.rejected_requests(batch).count()


def test_population_deviation(rows):
    fitted = encoding.fit_preparation(rows)
    scaled = encoding.scaled_columns(fitted, rows, KEY)
    r = scaled.agg(F.avg("amount").alias("m"), F.stddev_pop("amount").alias("s")).first()
    assert r.m == pytest.approx(0.0, abs=1e-9) and r.s == pytest.approx(1.0, abs=1e-9)


def test_label_rules(spark):
    cases = [
        ((10, 4, 6000), "Champions"), ((10, 2, 100), "Loyal Customers"), ((40, 1, 2500), "Potential Loyalists"),
        ((70, 1, 4000), "Big Spenders"), ((200, 2.5, 100), "At Risk"), ((100, 2.5, 100), "Needs Attention"),
        ((70, 6, 100), "Frequent Buyers"), ((70, 3, 100), "Segment 9"),
    ]
    df = spark.createDataFrame([tuple(map(float, c)) for c, _ in cases], "r double, f double, m double")
    got = df.select(segments.label_of(F.lit("9"), F.col("r"), F.col("f"), F.col("m"))).collect()
    assert [g[0] for g in got] == [w for _, w in cases]


def test_p_values(spark):
    assert two_sided_t(-0.12666009927622474, 2.939312431705471) == pytest.approx(0.9073754566704617, abs=1e-12)
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    for t, df in [(0.5, 3.0), (2.0, 11.5), (-4.2, 57.0), (1.0, 25000.0), (1.96, 1e6), (2.5, 3e6)]:
        want = 2.0 * dist(df).cumulativeProbability(-abs(t))
        assert two_sided_t(t, df) == pytest.approx(want, rel=1e-7)
    assert two_sided_t(1.96, 1e12) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-6)


def test_baseline_features_are_complete(tables):
    fe = features.baseline_features(tables.sales, ["order_id", "line_no"])
    assert fe.dropna().count() == tables.sales.count()
