"""CSV contract, reading statements, date bounds, literal search, one-class models, bundles."""

import math
from datetime import date, datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from salesloom.functions.scalars import contains_ci, days_between
from salesloom.operators import cleaning, persistence, profiling, sqllib, training
from salesloom.sources import csv_tables, sinks

HEADER = "Order ID,Date,Status,Amount,Qty,Category"


def test_folder_of_files_with_another_order_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\no1,2022-01-01,Shipped,10,1,Set\n")
    (tmp_path / "b.csv").write_text("Order ID,Date,Status,Qty,Amount,Category\no2,2022-01-02,Shipped,5,777,Set\n")
    with pytest.raises(Py4JJavaError, match="FAILED_READ_FILE"):
        csv_tables.load_sales(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text(f"{HEADER}\no2,2022-01-02,Shipped,777,5,Set\n")
    rows = {r.order_id: (r.amount, r.qty) for r in csv_tables.load_sales(spark, str(tmp_path)).collect()}
    assert rows == {"o1": (10.0, 1.0), "o2": (777.0, 5.0)}


def test_blank_header_names_are_compared_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f",{HEADER}\n0,o1,2022-01-01,Shipped,10,1,Set\n")
    (tmp_path / "b.csv").write_text(",Order ID,Date,Status,Qty,Amount,Category\n1,o2,2022-01-02,Shipped,5,777,Set\n")
    with pytest.raises(ValueError):
        csv_tables.load_sales(spark, str(tmp_path))


def test_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order ID,Date,Status\no1,2022-01-01,Shipped\n")
    with pytest.raises(ValueError, match="amount"):
        csv_tables.load_sales(spark, str(tmp_path))


WRITES = [
    "WITH x AS (SELECT 1 AS a) INSERT/**/INTO t1 SELECT a FROM x",
    "INSERT OVERWRITE t1 SELECT 1", "WITH x AS (SELECT 1) DELETE FROM t1", "DELETE FROM t1",
    "UPDATE t1 SET a = 2", "MERGE INTO t1 USING t2 ON t1.a = t2.a WHEN MATCHED THEN DELETE",
    "DROP TABLE t1", "CREATE TABLE t3 AS SELECT 1 AS a", "SET a=1", "CACHE TABLE t1",
]
READS = [
    "/* note */ SELECT 1 AS a", "(SELECT 1 AS a)", "SELECT 'insert into' AS a", "-- x\nSELECT 1 AS a",
    "WITH x AS (SELECT 1 AS a) SELECT * FROM x", "VALUES (1)", "SELECT 1 AS a UNION ALL SELECT 2",
]


@pytest.mark.parametrize("text", WRITES)
def test_writing_statements_are_refused(spark, text):
    with pytest.raises(ValueError):
        sqllib.run_user_sql(spark, text)


BEYOND = [
    "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM VALUES (1) t(a)",
    "WITH x AS (SELECT TRANSFORM(a) USING 'cat' FROM VALUES (1) t(a)) SELECT * FROM x",
    "SELECT reflect('java.lang.System', 'nanoTime')",
    "SELECT (SELECT max(java_method('java.lang.System', 'nanoTime')))",
    "SELECT sum(try_reflect('java.lang.System', 'nanoTime')) OVER () FROM VALUES (1) t(a)",
    "SELECT IDENTIFIER('refl' || 'ect')('java.lang.System', 'nanoTime')",
    "SELECT 1 AS a WHERE 1 IN (SELECT reflect('java.lang.System', 'nanoTime'))",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "WITH x AS (SELECT * FROM csv.`/etc/hosts`) SELECT * FROM x",
    "SELECT * FROM no_such_table", "SELECT * FROM no_such_function()", "EXECUTE IMMEDIATE 'SELECT 1'",
]
PLAIN = [
    "SELECT a, count(*) AS n FROM facts GROUP BY a HAVING count(*) > 0 ORDER BY a LIMIT 3",
    "WITH x AS (SELECT * FROM facts), y AS (SELECT * FROM x) SELECT * FROM y JOIN x USING (a)",
    "SELECT * FROM (SELECT a, row_number() OVER (PARTITION BY a ORDER BY a) AS r FROM facts) WHERE r = 1",
    "SELECT * FROM facts WHERE EXISTS (SELECT 1 FROM facts f WHERE f.a = facts.a)",
    "SELECT * FROM facts LATERAL VIEW explode(array(1, 2)) z AS k", "SELECT * FROM range(3)",
    "SELECT * FROM (SELECT a, 'x' AS k FROM facts) PIVOT (sum(a) FOR k IN ('x'))",
    "SELECT a FROM facts EXCEPT SELECT 99", "SELECT u.a FROM facts u, LATERAL (SELECT u.a + 1)",
]


@pytest.mark.parametrize("text", BEYOND)
def test_scripts_reflection_and_paths_are_refused(spark, text):
    with pytest.raises(ValueError, match="not "):
        sqllib.run_user_sql(spark, text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_queries_run(spark, text):
    facts = spark.createDataFrame([(1,), (2,), (2,)], "a int")
    assert sqllib.run_user_sql(spark, text, {"facts": facts}).count() >= 1


@pytest.mark.parametrize("text", READS)
def test_reading_statements_run(spark, text):
    assert sqllib.run_user_sql(spark, text).count() >= 1


@pytest.mark.parametrize("low", ["2022-4-1", "2022-04-01", date(2022, 4, 1), datetime(2022, 4, 1)])
def test_bounds_of_stored_sales(spark, sales, tmp_path, low):
    rows = spark.createDataFrame(
        [("a", datetime(2022, 3, 31)), ("b", datetime(2022, 4, 1)), ("c", datetime(2022, 11, 30))],
        "order_id string, date timestamp_ntz",
    )
    sinks.store_sales(rows, str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    found = cleaning.date_range(stored, start=low, end="2022-12-1")
    assert sorted(r.order_id for r in found.collect()) == ["b", "c"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert cleaning.date_range(rows, start=low, end="2022-12-1").count() == 2


def test_literal_search_and_floored_days(spark):
    df = spark.createDataFrame([("abc",), ("a%C",), (None,)], "t string")
    assert [r[0] for r in df.select(contains_ci(F.col("t"), "%c")).collect()] == [False, True, False]
    spans = spark.createDataFrame(
        [(datetime(2022, 1, 2), datetime(2022, 1, 1, 12)), (datetime(2022, 1, 1), datetime(2022, 1, 3, 1)),
         (datetime(2022, 1, 3), datetime(2022, 1, 1))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert [r[0] for r in spans.select(days_between(F.col("a"), F.col("b"))).collect()] == [-1, 2, -2]


def test_not_a_number_is_missing_in_every_profile(spark):
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (math.nan, 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    clean = df.where("a is not null and not isnan(a)")
    bins = {r.bin: r["count"] for r in profiling.histogram(df, "a", 2).collect()}
    assert bins == {0: 1, 1: 2}
    r = {(x.a, x.b): x.r for x in profiling.correlations(df).collect()}
    assert r[("a", "b")] == pytest.approx(1.0)
    got = [x.density for x in profiling.density(df, "a", 5).orderBy("point").collect()]
    want = [x.density for x in profiling.density(clean, "a", 5).orderBy("point").collect()]
    assert got == pytest.approx(want) and len(got) == 5
    assert profiling.box_plot(df, "a").first().outliers == 0
    assert profiling.outlier_rows(df, "a").count() == 0
    assert profiling.joint_histogram(df, "a", "b", 2).agg(F.sum("count")).first()[0] == 3
    assert profiling.density(df.limit(0), "a", 5).count() == 0


def test_bundle_versions(spark, sales, tmp_path):
    from pyspark.ml import PipelineModel

    path = str(tmp_path / "bundle")
    one = persistence.Bundle(PipelineModel([]), ["x"], "First", {}, {}, 1.0, 2.0, "t")
    persistence.save_bundle(spark, one, path)
    one.model_type = "Second"
    persistence.save_bundle(spark, one, path)
    assert persistence.load_bundle(spark, path).model_type == "Second"
    # Stages without metadata, as a broken save leaves them, change nothing.
    one.model.write().save(f"{path}/versions/99999999999999999999-x/model")
    assert persistence.load_bundle(spark, path).model_type == "Second"


def test_forest_on_one_class(spark):
    rows = [(i, float(i % 7), float(i % 5), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, qty double, amount double, label double")
    train, test = training.train_test_split(df, ["id"], "label")
    done = training.train_and_evaluate("Random Forest", train, test, ["id"], trees=3, max_depth=3)
    assert done.metrics["accuracy"] == 1.0


def test_many_classes_are_refused(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "label double")
    with pytest.raises(ValueError):
        training.with_class_weight(df)


def test_from_a_csv_export_to_scores(spark, tmp_path):
    """An export as it comes, without any column of the test tables."""
    import salesloom as sl

    lines = ["Order ID,Date,Status,Fulfilment,ship-service-level,Style,SKU,Category,Size,Qty,currency,Amount,"
             "ship-state,ship-postal-code,promotion-ids,B2B"]
    for i in range(120):
        status = "Cancelled" if i % 3 == 0 else "Shipped"
        side = ("Amazon", "Expedited") if i % 2 else ("Merchant", "Standard")
        lines.append(
            f"o{i},2022-{i % 9 + 1:02d}-{i % 27 + 1:02d},{status},{side[0]},{side[1]},ST{i % 4},S{i % 7},"
            f"C{i % 3},M,{i % 4 + 1},INR,{100 + i * (2 if i % 3 else 1)},MH,400001,{'P' if i % 5 else ''},False"
        )
    (tmp_path / "sales.csv").write_text("\n".join(lines) + "\n")
    sales = sl.load_and_clean(spark, {"sales": str(tmp_path / "sales.csv")})["sales"]
    fe = sl.engineer_features(sales)
    assert fe.count() == 120 and fe.where("revenue_7d_ma is null").count() == 0
    model = sl.cancellation_model(
        spark, str(tmp_path / "model"), sales, names=["Logistic Regression"], grid=False
    )
    requests = sales.select(
        "order_id", F.month("date").alias("month"), "qty", "amount", F.lit(False).alias("is_weekend"),
        F.col("promotion_ids").isNotNull().alias("has_promotion"), "fulfilment",
        F.col("ship_service_level").alias("service_level"), "b2b", "category",
    )
    scores = sl.score_requests(requests, model, ["order_id"]).collect()
    assert len(scores) == 120 and scores[0].features_used == model.features
    assert all(0 <= r.cancellation_probability <= 1 for r in scores)
