"""Results on the five-row sales, the five-row stock and the small ledger."""

import threading

import pytest
from pyspark.sql import functions as F

from salesloom.operators import enrich, features, kpis, rfm, segments, stats_tests, training


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_features(sales):
    fe = features.engineer_features(sales)
    rows = sorted(fe.collect(), key=lambda r: r.date)
    got = [
        (r.order_id, r.day_of_week, r.is_weekend, r.month, r.price_per_unit, r.has_promotion,
         r.is_high_value, r.revenue_7d_ma, r.cancelled)
        for r in rows
    ]
    assert got == [
        ("A1", 5, 1, 1, 100.0, 0, 0, 100.0, 0),
        ("D4", 0, 0, 1, 75.0, 0, 0, 75.0, 1),
        ("A1", 5, 1, 1, 100.0, 1, 0, 137.5, 0),
        ("B2", 1, 0, 2, 50.0, 0, 0, 75.0, 1),
        ("C3", 1, 0, 3, 100.0, 1, 1, 300.0, 0),
    ]


def test_rfm_and_ranks(sales):
    rows = by(rfm.with_rfm_scores(rfm.compute_rfm(sales)), "order_id")
    got = {
        k: (r.recency, r.frequency, r.monetary, r.r_rank, r.f_rank, r.m_rank, r.rfm_score)
        for k, r in rows.items()
    }
    assert got == {
        "A1": (46, 2, 300.0, 2.0, 4.0, 3.5, 9.5),
        "B2": (29, 1, 50.0, 3.0, 2.0, 1.0, 6.0),
        "C3": (1, 1, 300.0, 4.0, 2.0, 3.5, 9.5),
        "D4": (51, 1, 75.0, 1.0, 2.0, 2.0, 5.0),
    }


def test_monthly_revenue(sales):
    rows = {(r.year, r.month): r.revenue for r in kpis.monthly_revenue(sales).collect()}
    assert rows == {(2022, 1): 375.0, (2022, 2): 50.0, (2022, 3): 300.0}


def test_headline(sales):
    r = kpis.headline(sales).first()
    assert (r.total_revenue, r.total_orders, r.total_units) == (725.0, 4, 8)
    assert r.average_order_value == 181.25
    assert r.cancelled_revenue == 125.0
    assert r.cancellation_rate_orders == 0.5
    assert r.cancellation_rate_rows == 0.4


def test_headline_of_nothing(sales):
    r = kpis.headline(sales.where("false")).first()
    assert (r.total_revenue, r.total_orders, r.average_order_value) == (0.0, 0, 0.0)
    assert r.cancellation_rate_rows == 0.0


def test_category_stock(sales, inventory):
    rows = enrich.join_category_stock(sales, inventory).collect()
    assert {r.category: (r.total_stock, r.unique_skus) for r in rows} == {
        "Set": (10.0, 2), "Kurta": (8.0, 2), "Top": (20.0, 1),
    }
    assert len(rows) == 5


def test_welch(sales):
    r = stats_tests.welch_statistics(sales).first()
    assert r.t_statistic == pytest.approx(-0.12666009927622474, abs=1e-12)
    assert r.df == pytest.approx(2.939312431705471, abs=1e-12)
    assert (r.mean_true, r.mean_false) == (137.5, 150.0)
    out = stats_tests.welch_t_test(sales).first()
    assert out.p_value == 0.907375 and out.significant is False
    assert stats_tests.welch_t_test(sales.where("order_id <> 'D4'")).count() == 0


def test_chi_square(sales):
    assert stats_tests.chi_square_statistics(sales).first().chi2 == pytest.approx(0.3125)
    out = stats_tests.chi_square_test(sales).first()
    assert (out.chi2, out.p_value, out.significant) == (0.3125, 0.57615, False)


def test_chi_square_needs_two_by_two(sales):
    third = sales.withColumn("fulfilment", F.when(F.col("order_id") != "C3", F.col("fulfilment")))
    assert stats_tests.chi_square_test(third).count() == 0
    assert stats_tests.chi_square_test(sales.where("status = 'Shipped'")).count() == 0


def test_hypothesis_tests(sales):
    for result in stats_tests.hypothesis_tests(sales).values():
        row = result.first()
        assert "p_value" in row and "significant" in row


def test_ledger(ledger):
    r = kpis.ledger_totals(ledger).first()
    assert (r.total_income, r.total_expense, r.net_profit) == (5000.0, 13095.0, -8095.0)
    assert kpis.ledger_totals(ledger, drop_unlabelled=True).first().total_expense == 5000.0


def test_executive_summary(sales, ledger):
    rows = by(kpis.executive_summary(sales, ledger), "kpi")
    assert rows["Total Expense"].value == 13095.0
    assert rows["Profit"].value == 725.0 - 13095.0
    assert len(rows) == 8


def test_two_segments(sales):
    out = segments.segment_customers(rfm.compute_rfm(sales), k=2, restarts=2)
    rows = out.rows.collect()
    assert len({r.segment for r in rows}) == 2 and len(rows) == 4
    assert all(r.segment_label for r in rows)


def test_runs_of_k_means_go_side_by_side(sales, monkeypatch):
    meeting, costs = threading.Barrier(2), []

    class Meeting(segments.KMeans):
        def fit(self, rows):
            meeting.wait(100)
            model = super().fit(rows)
            costs.append(model.summary.trainingCost)
            return model

    monkeypatch.setattr(segments, "KMeans", Meeting)
    out = segments.segment_customers(rfm.compute_rfm(sales), k=2, restarts=4)
    assert len(costs) == 4 and out.model.summary.trainingCost == min(costs)


def test_three_classifiers():
    assert len(training.MODEL_NAMES) == 3
    assert [len(training.param_grid(n)) for n in training.MODEL_NAMES] == [2, 4, 4]


def test_sku_performance_equals_the_joined_rows(sales, inventory):
    doubled = inventory.unionByName(inventory.where("sku_code = 'S4'"))
    top = {(r.sku, r.stock): r.revenue for r in enrich.sku_performance(sales, doubled).collect()}
    joined = enrich.join_sku_stock(sales, doubled).where("stock IS NOT NULL")
    want = {
        (r.sku, r.stock): r.s
        for r in joined.groupBy("sku", "stock").agg(F.sum("amount").alias("s")).collect()
    }
    assert top == want and top[("S4", 20.0)] == 600.0
