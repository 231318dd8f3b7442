"""Model input, training, metrics, scoring and persistence over the canonical views."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions import ordered
from salesloom.functions.scalars import is_cancelled
from salesloom.operators import (
    encoding,
    features,
    kpis,
    metrics,
    persistence,
    reports,
    scoring,
    training,
)
from salesloom.operators.cleaning import text_categories
from salesloom.plans.customer_queries import FEATURES, KEY, KEYS
from salesloom.plans.kpi_queries import rounded
from salesloom.plans.registry import query
from salesloom.workspace import delete_path, file_state, new_path, release_shuffles, remembered, stage

_INPUT = [
    *KEY, "category", "date", "qty", "amount", "fulfilment", "ship_service_level", "b2b",
    "promotion_ids", "status",
]


def featured(t):
    """The sales with their features.

    The joined sales are written, so that the shuffles of the joins are gone before the
    ordering begins, and deleted when their ordered rows are written.
    """
    sales, path = t.sales.select(_INPUT), new_path(t.spark, "sales")
    sales.write.parquet(path)
    release_shuffles(t.spark)
    found = features.engineer_features(t.spark.read.schema(sales.schema).parquet(path), KEY)
    delete_path(t.spark, path)
    return found


def model_input(t):
    return encoding.model_rows(featured(t), "cancelled", KEY)


def _hash_sql(text: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {text}, '{seed}')), 1, 8) AS BIGINT) / 4294967296.0"


_ONE_HOT = """CAST(fulfilment = 'Amazon' AS INT) AS "fulfilment_Amazon",
    CAST(fulfilment = 'Merchant' AS INT) AS "fulfilment_Merchant",
    CAST(ship_service_level = 'Expedited' AS INT) AS "ship_service_level_Expedited",
    CAST(ship_service_level = 'Standard' AS INT) AS "ship_service_level_Standard",
    CAST(NOT b2b AS INT) AS b2b_false, CAST(b2b AS INT) AS b2b_true"""


@query("ml02_one_hot", f"SELECT {KEYS}, {_ONE_HOT} FROM sales")
def _(t):
    rows = t.sales.select(*KEY, *encoding.CATEGORICAL)
    texts = text_categories(rows, encoding.CATEGORICAL)
    return encoding.one_hot_columns(texts, encoding.CATEGORICAL, KEY)


_FLAGS = ["fulfilment_Amazon", "fulfilment_Merchant", "ship_service_level_Expedited",
          "ship_service_level_Standard", "b2b_false", "b2b_true"]


_SCALED_SQL = f"""WITH {FEATURES.strip()}, x AS (SELECT *, {_ONE_HOT} FROM f),
        m AS (SELECT {', '.join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"'
                                for c in encoding.NUMERIC + _FLAGS)} FROM x)
        SELECT {KEYS}, {', '.join(f'round(("{c}" - "m_{c}") / "s_{c}", 7) AS "{c}"'
                                  for c in encoding.NUMERIC + _FLAGS)}
        FROM x, m"""


@query("ml03_standardised_features", _SCALED_SQL)
def _(t):
    rows = stage(model_input(t), "model-input")
    scaled = encoding.scaled_columns(encoding.fit_preparation(rows), rows, KEY)
    return rounded(scaled, 7, *encoding.NUMERIC, *_FLAGS)


_SPLIT_HASH = _hash_sql("CAST(CAST(status ILIKE '%cancel%' AS INT) AS VARCHAR), "
                        "order_id, CAST(line_no AS VARCHAR), sku, CAST(supp AS VARCHAR)", 42)


@query(
    "ml05_stratified_split",
    f"""SELECT {KEYS}, CAST(status ILIKE '%cancel%' AS INT) AS cancelled,
               CASE WHEN {_SPLIT_HASH} < 0.2 THEN 'test' ELSE 'train' END AS side FROM sales""",
)
def _(t):
    rows = t.sales.select(*KEY, is_cancelled(F.col("status")).cast("int").alias("cancelled"))
    train, test = training.train_test_split(rows, KEY, "cancelled")
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


@query(
    "ml06_revenue_split",
    f"""SELECT {KEYS}, CAST(month(date) AS INT) AS month, qty, amount AS revenue,
               CASE WHEN {_hash_sql("order_id, CAST(line_no AS VARCHAR), sku, CAST(supp AS VARCHAR)", 42)}
                    < 0.2 THEN 'test' ELSE 'train' END AS side
        FROM sales WHERE date IS NOT NULL AND qty IS NOT NULL AND amount IS NOT NULL""",
)
def _(t):
    rows = features.calendar_columns(t.sales).select(
        *KEY, "month", "qty", F.col("amount").alias("revenue")
    ).dropna()
    train, test = training.train_test_split(rows, KEY)
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )


@query(
    "ml07_class_weights",
    """WITH c AS (SELECT CAST(status ILIKE '%cancel%' AS INT) AS label, count(*) AS n FROM sales GROUP BY 1)
       SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 9) AS weight FROM c""",
)
def _(t):
    rows = t.sales.select(is_cancelled(F.col("status")).cast("int").alias("label"))
    return rounded(training.class_weights(rows), 9, "weight")


@query(
    "agg29_class_balance",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status ILIKE '%cancel%') AS positive,
              round(avg(CASE WHEN status ILIKE '%cancel%' THEN 1.0 ELSE 0.0 END), 9) AS positive_share
       FROM sales""",
)
def _(t):
    rows = t.sales.select(is_cancelled(F.col("status")).cast("int").alias("label"))
    return rounded(kpis.class_balance(rows, "label"), 9, "positive_share")


# A score by rule from whole columns, with many ties: input of the metric checks.
_SCORED_SQL = """scored AS (
    SELECT CAST(status ILIKE '%cancel%' AS INT) AS label,
           (qty * 7 + line_no * 3 + CAST(b2b AS INT) * 11) % 61 / 60.0::DOUBLE AS score FROM sales),
  p AS (SELECT *, CAST(score >= 0.5 AS INT) AS prediction FROM scored)"""


def _scored(t):
    score = (F.col("qty") * 7 + F.col("line_no") * 3 + F.col("b2b").cast("int") * 11) % 61
    return t.sales.select(
        is_cancelled(F.col("status")).cast("int").alias("label"),
        (score / F.lit(60.0)).alias("score"),
    ).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


_METRICS_SQL = f"""WITH {_SCORED_SQL},
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS ok,
                 count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                 count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM p),
    r AS (SELECT label, rank() OVER (ORDER BY score)
                 + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM p),
    a AS (SELECT (sum(rk) FILTER (WHERE label = 1)
                  - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
                 / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0))
                 AS auc FROM r)
    SELECT round(ok / n, 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
           round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
           round(auc, 9) AS roc_auc FROM c, a"""


@query("ml13_metrics", _METRICS_SQL)
def _(t):
    return rounded(metrics.classification_metrics(_scored(t)), 9, *metrics.METRICS)


@query("ml13_metrics_split", _METRICS_SQL)
def _(t):
    return rounded(metrics.classification_metrics(_scored(t)), 9, *metrics.METRICS)


_REPORT_SQL = f"""WITH {_SCORED_SQL},
    k AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS hit,
                 count(*) FILTER (WHERE prediction = c) AS said, count(*) FILTER (WHERE label = c) AS n
          FROM p, (VALUES (0), (1)) v(c) GROUP BY c),
    m AS (SELECT c, n, hit / said AS pr, hit / n AS re, 2 * hit / (said + n) AS f FROM k)
    SELECT CASE c WHEN 0 THEN 'Not Cancelled' ELSE 'Cancelled' END AS class, round(pr, 9) AS precision,
           round(re, 9) AS recall, round(f, 9) AS f1, n AS support FROM m
    UNION ALL SELECT 'macro avg', round(avg(pr), 9), round(avg(re), 9), round(avg(f), 9),
                     CAST(sum(n) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(pr * n) / sum(n), 9), round(sum(re * n) / sum(n), 9),
                     round(sum(f * n) / sum(n), 9), CAST(sum(n) AS BIGINT) FROM m"""


@query("ml14_class_report", _REPORT_SQL)
def _(t):
    return rounded(metrics.class_report(_scored(t)), 9, "precision", "recall", "f1")


@query(
    "ml15_confusion_matrix",
    f"""WITH {_SCORED_SQL} SELECT label AS actual, count(*) FILTER (WHERE prediction = 0) AS predicted_0,
        count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM p GROUP BY label""",
)
def _(t):
    return metrics.confusion_matrix(_scored(t))


@query(
    "ml13_metrics_on_two_labels",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS ok,
                         count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
                         count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
                         count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn FROM labels)
       SELECT tp, fp, fn, n, ok AS right FROM c""",
)
def _(t):
    return metrics.binary_counts(t.source("labels"), "quality", "toxic")


@query(
    "ml26_metrics_long",
    f"""WITH w AS ({_METRICS_SQL})
        SELECT 'by rule' AS model, metric, value FROM w UNPIVOT (value FOR metric IN
            (accuracy, precision, recall, f1, roc_auc))""",
)
def _(t):
    wide = rounded(metrics.classification_metrics(_scored(t)), 9, *metrics.METRICS)
    return metrics.metrics_long(wide.select(F.lit("by rule").alias("model"), "*"))


@query(
    "ml20_ordinal_codes",
    """SELECT style, dense_rank() OVER (ORDER BY style) - 1 AS code
       FROM (SELECT DISTINCT CASE WHEN line_no = 1 THEN 'Unknown' ELSE style END AS style FROM sales)""",
)
def _(t):
    rows = t.sales.select(F.when(F.col("line_no") != 1, F.col("style")).alias("style"))
    named = rows.fillna({"style": "Unknown"})
    return ordered.ordinal_codes(named, "style", "code")


@query(
    "ml19_baseline_features",
    f"""WITH c AS (SELECT cat, dense_rank() OVER (ORDER BY cat) - 1 AS code
                   FROM (SELECT DISTINCT coalesce(category, 'Unknown') AS cat FROM sales))
        SELECT {KEYS}, CAST(coalesce(qty, 0) AS DOUBLE) AS qty, coalesce(amount, 0.0) AS amount,
               CAST(coalesce(month(date), 1) AS INT) AS month,
               CAST(isodow(date) >= 6 AS INT) AS is_weekend, CAST(b2b AS INT) AS b2b,
               CASE fulfilment WHEN 'Amazon' THEN 1 ELSE 0 END AS fulfilment,
               CASE ship_service_level WHEN 'Expedited' THEN 1 ELSE 0 END AS service_level,
               CAST(c.code AS INT) AS category, CAST(status ILIKE '%cancel%' AS INT) AS is_cancelled
        FROM sales JOIN c ON coalesce(sales.category, 'Unknown') = c.cat""",
)
def _(t):
    return features.baseline_features(t.sales, KEY)


@query("ml19_baseline_coefficients")
def _(t):
    return training.baseline_model(stage(features.baseline_features(t.sales, KEY), "baseline"), KEY)


def _once(t, name: str, make):
    """Made once per application and state of the data, for all queries that read it."""
    return remembered(t.spark, (name, t.sf_dir, file_state(t.spark, t.sf_dir)), make)


def engineered(t):
    """The engineered columns that models, their split and their constants are made of."""
    used = [*KEY, *encoding.NUMERIC, *encoding.CATEGORICAL, "cancelled"]
    make = lambda: stage(featured(t).select(used), "features")
    return _once(t, "engineered", make)


def split_input(t):
    rows = encoding.model_rows(engineered(t), "cancelled", KEY)
    return training.train_test_split(rows, KEY, "label")


def compared(t, names=training.MODEL_NAMES):
    """The tuned classifiers: all settings, three folds, refit and test metrics.

    Each is made once, with the others that are still wanting, on the same rows.
    """
    made = _once(t, "compared", dict)
    wanting = [n for n in names if n not in made]
    if wanting:
        rows = _once(t, "compared-rows", lambda: training.comparison_rows(*split_input(t), KEY))
        found = training.comparison_on(rows, names=wanting)
        for r in found.results:
            scores = None if found.scores is None else found.scores.where(F.col("model") == r.name)
            made[r.name] = training.Comparison([r], scores, found.prepared)
    parts = [made[n] for n in names]
    scores = [p.scores for p in parts if p.scores is not None]
    scores = reduce(DataFrame.unionByName, scores) if scores else None
    return training.Comparison(training.best_first([r for p in parts for r in p.results]), scores, parts[0].prepared)


def _metrics_of(t, name: str):
    return training.comparison_table(t.spark, compared(t, [name]).results)


@query("ml08_logistic_regression")
def _(t):
    return _metrics_of(t, "Logistic Regression")


@query(
    "ml08_score_equations",
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in [*encoding.NUMERIC, *_FLAGS, "intercept"])
    + "]) AS feature, true AS solved",
)
def _(t):
    """The logistic regression is the minimum of its loss: all slopes vanish."""
    found = compared(t, ["Logistic Regression"])
    slopes = training.score_equations(found.results[0], found.prepared)
    return slopes.select("feature", (F.abs("slope") < 1e-3).alias("solved"))


@query("ml09_random_forest")
def _(t):
    return _metrics_of(t, "Random Forest")


@query("ml10_gradient_boosting")
def _(t):
    return _metrics_of(t, "Gradient Boosting")


@query("ml11_ml12_grid_search")
def _(t):
    """The mean score of every setting of every model."""
    return training.ranked_settings(compared(t).scores)


_GRID_SQL = ", ".join(
    f"('{name}', {i}, '{json.dumps(params)}')"
    for name in training.MODEL_NAMES
    for i, params in enumerate(training.param_grid(name))
)


@query(
    "ml12_fits_of_the_search",
    f"""SELECT model, CAST(setting AS INT) AS setting, params, CAST(fold AS INT) AS fold, true AS scored
        FROM (VALUES {_GRID_SQL}) g(model, setting, params), range({training.FOLDS}) f(fold)""",
)
def _(t):
    """Every setting is fitted and scored in every fold."""
    scored = F.col("f1").between(0, 1) & F.col("failure").isNull()
    return compared(t).scores.select("model", "setting", "params", "fold", scored.alias("scored"))


@query("ml16_compare_models")
def _(t):
    return training.comparison_table(t.spark, compared(t).results)


@query("ml17_best_model_importance")
def _(t):
    return training.feature_importance(t.spark, compared(t).results[0])


@query("ml18_feature_importance")
def _(t):
    tables = [
        training.feature_importance(t.spark, r).withColumn("model", F.lit(r.name))
        for r in compared(t).results
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query(
    "ml18_importance_shares",
    f"""SELECT model, {len(encoding.NUMERIC + _FLAGS)} AS features, true AS shares
        FROM (VALUES ('Random Forest'), ('Gradient Boosting')) v(model)""",
)
def _(t):
    """The importances of the trees are shares: none negative, one in all."""
    trees = compared(t, [n for n in training.MODEL_NAMES if n != "Logistic Regression"]).results
    tables = [training.feature_importance(t.spark, r).withColumn("model", F.lit(r.name)) for r in trees]
    whole = (F.min("importance") >= 0) & (F.abs(F.sum("importance") - 1) < 1e-9)
    both = tables[0].unionByName(tables[1]).groupBy("model")
    return both.agg(F.count("*").cast("int").alias("features"), whole.alias("shares"))


def requests(sales):
    """Scoring requests with some absent and some unacceptable fields."""
    d = F.col("date")
    return sales.select(
        *KEY,
        F.month(d).alias("month"),
        "qty",
        "amount",
        F.weekday(d).isin(5, 6).alias("is_weekend"),
        F.col("promotion_ids").isNotNull().alias("has_promotion"),
        F.when(F.col("line_no") == 5, "Drop ship").otherwise(F.col("fulfilment")).alias("fulfilment"),
        F.when(F.col("line_no") != 6, F.col("ship_service_level")).alias("service_level"),
        "b2b",
        "category",
    )


_CHECKED_SQL = f"""WITH r AS (
    SELECT {KEYS}, month(date) AS month, qty, coalesce(amount, 500.0) AS amount,
           CASE WHEN line_no = 5 THEN 'Drop ship' ELSE fulfilment END AS fulfilment,
           CASE WHEN line_no <> 6 THEN ship_service_level ELSE 'Standard' END AS service_level
    FROM sales_raw),
  v AS (SELECT *, concat_ws(',', CASE WHEN NOT month BETWEEN 1 AND 12 THEN 'month' END,
                CASE WHEN NOT qty BETWEEN 1 AND 100 THEN 'qty' END,
                CASE WHEN NOT amount BETWEEN 1 AND 100000 THEN 'amount' END,
                CASE WHEN fulfilment NOT IN ('Amazon', 'Merchant') THEN 'fulfilment' END,
                CASE WHEN service_level NOT IN ('Standard', 'Expedited') THEN 'service_level' END)
                AS failures FROM r)
  SELECT {KEYS}, amount, fulfilment, service_level, failures FROM v"""


def _checked(df):
    return df.select(
        *KEY, "amount", "fulfilment", "service_level",
        F.concat_ws(",", "failures").alias("failures"),
    )


@query("flt13_checked_requests", _CHECKED_SQL)
def _(t):
    return _checked(scoring.with_failures(requests(t.sales_raw)))


@query("flt13_rejected_requests", _CHECKED_SQL + " WHERE failures <> ''")
def _(t):
    return _checked(scoring.rejected_requests(requests(t.sales_raw)))


@query(
    "ml24_risk_bands",
    f"""WITH {_SCORED_SQL} SELECT CASE WHEN score < 0.3 THEN 'Low' WHEN score < 0.6 THEN 'Moderate'
        ELSE 'High' END AS risk_level, count(*) AS n FROM p GROUP BY 1""",
)
def _(t):
    banded = _scored(t).select(scoring.risk_band(F.col("score")).alias("risk_level"))
    return banded.groupBy("risk_level").agg(F.count("*").alias("n"))


def saved_bundle(t):
    """The best tuned classifier, saved and loaded: batch and stream score with it."""

    def make():
        path = new_path(t.spark, "bundle")
        reports.save_best(t.spark, path, compared(t).results[0], engineered(t))
        return path

    return persistence.load_bundle(t.spark, _once(t, "bundle", make))


@query("ml23_batch_scores")
def _(t):
    return scoring.score_requests(requests(t.sales_raw), saved_bundle(t), KEY)


@query(
    "ml23_every_valid_request_once",
    f"SELECT {KEYS}, true AS scored FROM ({_CHECKED_SQL} WHERE failures = '') AS valid",
)
def _(t):
    scores = scoring.score_requests(requests(t.sales_raw), saved_bundle(t), KEY)
    return scores.select(*KEY, F.col("cancellation_probability").between(0, 1).alias("scored"))


@query("ml25_snk03_snk04_model_info")
def _(t):
    return persistence.model_info(t.spark, saved_bundle(t))


@query("ml27_preparation_pipeline", _SCALED_SQL)
def _(t):
    """The preparation saved, loaded and applied again."""
    rows = stage(model_input(t), "model-input")
    path = new_path(t.spark, "preparation")
    encoding.fit_preparation(rows).write().save(path)
    scaled = encoding.scaled_columns(PipelineModel.load(path), rows, KEY)
    return rounded(scaled, 7, *encoding.NUMERIC, *_FLAGS)
