"""Order-based measures against brute force, with hot groups, ties and gaps."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesloom.functions import ordered
from salesloom.operators import metrics


def fixture_rows(seed, n=600):
    """A third of the rows in one group, another third on one day of it, some gaps."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        group = "hot" if hot else rnd.choice(["a", "b", "c", None])
        day = None if rnd.random() < 0.05 else (5 if hot and i % 2 else rnd.randint(1, 9))
        value = None if rnd.random() < 0.1 else float(rnd.randint(1, 20))
        rows.append((group, day, i, value))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("partitions", [1, 7, 150])
def test_rolling_mean(spark, seed, partitions):
    rows = fixture_rows(seed)
    df = spark.createDataFrame(rows, "g string, d int, i int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = ordered.rolling_mean(df, "g", ["d", "i"], "v", "ma")
        got = {r.i: r.ma for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    ordered_rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    seen = {}
    for group, _day, i, value in ordered_rows:
        last = seen.setdefault(group, [])
        last.append(value)
        present = [v for v in last[-7:] if v is not None]
        if group is None or not present:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(sum(present) / len(present), abs=1e-9)


def test_average_ranks(spark):
    rnd = random.Random(3)
    values = [1.0] * 100 + [float(rnd.randint(0, 40)) for _ in range(190)] + [None] * 10
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    out = ordered.average_ranks(df, {"up": ("v", True), "down": ("v", False)})
    pdf = pd.DataFrame({"v": values})
    up, down = pdf["v"].rank(), pdf["v"].rank(ascending=False)
    rows = {r.i: r for r in out.collect()}
    assert len(rows) == len(values)
    for i in range(len(values)):
        if pd.isna(up[i]):
            assert rows[i].up is None and rows[i].down is None
        else:
            assert (rows[i].up, rows[i].down) == (up[i], down[i])
    n = 290
    assert sum(r.up for r in rows.values() if r.up) == n * (n + 1) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 40, 301, 9000])
def test_quantiles(spark, n):
    """Few rows take the whole column as bracket, many a thousandth of the rows."""
    rnd = random.Random(n)
    rows = [(rnd.choice([None, 5.0, rnd.random()]), float(rnd.randint(1, 5))) for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.0005, 0.1, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = {(r.column, r.prob): r.quantile for r in ordered.quantiles(df, ["a", "b"], probs).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    for c in "ab":
        for p in probs:
            want = pdf[c].quantile(p)
            assert (c, p) not in got if pd.isna(want) else got[(c, p)] == pytest.approx(want, abs=1e-12)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "a double")
    assert ordered.quantiles(df, ["a"], [0.5]).count() == 0


def test_quantile_skips_not_a_number(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "a double")
    assert ordered.quantile(df, "a", 0.5).first()[0] == 2.0


def test_roc_auc(spark):
    rnd = random.Random(5)
    rows = [(float(rnd.random() < 0.3), rnd.randint(0, 12) / 12) for _ in range(400)]
    df = spark.createDataFrame(rows, "label double, score double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)


def test_metrics_agree_with_the_evaluators(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rnd = random.Random(6)
    rows = [(float(rnd.random() < 0.4), rnd.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, score double").withColumn(
        "prediction", (F.col("score") > 0.5).cast("double")
    )
    got = metrics.classification_metrics(df).first()
    for mine, name in (("accuracy", "accuracy"), ("f1", "fMeasureByLabel"),
                       ("precision", "precisionByLabel"), ("recall", "recallByLabel")):
        evaluator = MulticlassClassificationEvaluator(metricName=name, metricLabel=1.0)
        assert got[mine] == pytest.approx(evaluator.evaluate(df))


def test_metrics_without_hits(spark):
    df = spark.createDataFrame([(1.0, 0.1, 0.0), (0.0, 0.2, 0.0)], "label double, score double, prediction double")
    r = metrics.classification_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_ordinal_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("Unknown",)], "c string")
    got = {r.c: r.code for r in ordered.ordinal_codes(df, "c", "code").collect()}
    assert got == {"Unknown": 0, "a": 1, "b": 2}


def test_describe_without_values(spark):
    from salesloom.operators import profiling

    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    rows = {r.column: r for r in profiling.describe_numeric(df).collect()}
    assert (rows["a"].mean, rows["a"].q50, rows["a"]["count"]) == (2.0, 2.0, 2)
    assert rows["a"].std == pytest.approx(2 ** 0.5)
    assert (rows["b"].mean, rows["b"].q50, rows["b"]["count"]) == (None, None, 0)
