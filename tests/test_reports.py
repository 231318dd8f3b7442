"""Whole reports on the five sales and on the smallest tables."""

from pyspark.sql import functions as F

from salesloom.operators import kpis, reports
from salesloom.plans.model_queries import _INPUT
from salesloom.sources import csv_tables, sinks
from salesloom.workspace import new_path


def test_dashboard_of_a_range(sales, inventory):
    tables = reports.dashboard(sales, inventory, "2022-01-10", "2022-02-01")
    assert tables["headline"].first().total_revenue == 325.0
    assert [r.period for r in tables["monthly"].collect()] == ["2022-01", "2022-02"]
    assert tables["categories"].first().category == "Kurta"
    assert {r.status: r["count"] for r in tables["statuses"].collect()} == {"Shipped": 1, "Cancelled": 2}
    assert tables["coverage"].first().rows_with_stock == 5


def test_groups_add_up_to_the_whole(tables):
    total = kpis.total_revenue(tables.sales).first()[0]
    for keys in (["category"], ["b2b"], ["sku"], ["status", "fulfilment"]):
        by_group = kpis.revenue_by(tables.sales, *keys).agg(F.sum("revenue")).first()[0]
        assert abs(by_group - total) < 1e-3
    states = kpis.revenue_by(tables.sales, "ship_state", keep_missing=True)
    assert abs(states.agg(F.sum("revenue")).first()[0] - total) < 1e-3


def test_segmentation(tables):
    out = reports.segmentation(tables.sales, k=3)
    n = tables.sales.select("order_id").distinct().count()
    assert out["rows"].count() == n == out["profile"].agg(F.sum("customers")).first()[0]
    assert abs(out["revenue_share"].agg(F.sum("revenue_share")).first()[0] - 100) < 0.5
    assert out["sample"].count() == min(n, 2000)


def test_explorer(sales):
    out = reports.explorer(sales)
    assert out["shape"].first().rows == 5 and out["shape"].first().missing_cells == 3
    described = {r.column: r for r in out["description"].collect()}
    assert described["amount"].q50 == 100.0
    assert (described["ship_state"].top, described["ship_state"].freq) == ("MH", 2)
    assert len(described) == len(sales.columns)


def test_model_is_trained_once(spark, tables):
    path = new_path(spark, "model")
    assert reports.cancellation_model(spark, path) is None
    rows = tables.sales.select(_INPUT)
    first = reports.cancellation_model(spark, path, rows, names=["Logistic Regression"], grid=False)
    again = reports.cancellation_model(spark, path, rows)
    assert first.trained_on == again.trained_on and again.model_type == "Logistic Regression"


def test_ledger_from_csv(spark, ledger):
    path = new_path(spark, "ledger")
    sinks.write_csv(ledger.toDF("index", "Received", "Unnamed: 1", "Spent", "Unnamed: 3"), path)
    for keep in (True, False):
        rows = csv_tables.load_expenses(spark, path, keep_index=keep)
        r = kpis.ledger_totals(rows).first()
        assert (r.total_income, r.total_expense, r.net_profit) == (5000.0, 13095.0, -8095.0)


def test_density_needs_spread(spark):
    from salesloom.operators import profiling

    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert profiling.density(df, "x").count() == 0
    assert [r["count"] for r in profiling.histogram(df, "x").collect()] == [2]
