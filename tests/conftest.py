import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from salesloom.session import local_session
    from salesloom.workspace import drop_staged

    session = local_session(8)
    yield session
    drop_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from salesloom.sources.canonical import Tables

    return Tables(spark, SF)


@pytest.fixture(scope="session")
def sales(spark):
    """Five sales with known results."""
    rows = [
        ("A1", "2022-01-01", "Shipped", 100.0, 1, "Amazon", "Standard", "Set", False, None, "MH", "M", "S1"),
        ("A1", "2022-01-15", "Shipped", 200.0, 2, "Merchant", "Expedited", "Kurta", True, "PROMO1", "KA", "L", "S2"),
        ("B2", "2022-02-01", "Cancelled", 50.0, 1, "Amazon", "Standard", "Set", False, None, "TN", "S", "S3"),
        ("C3", "2022-03-01", "Shipped", 300.0, 3, "Merchant", "Standard", "Top", False, "PROMO2", "MH", "XL", "S4"),
        ("D4", "2022-01-10", "Cancelled", 75.0, 1, "Amazon", "Expedited", "Kurta", True, None, "DL", "M", "S5"),
    ]
    df = spark.createDataFrame(
        rows,
        "order_id string, date string, status string, amount double, qty int, fulfilment string, "
        "ship_service_level string, category string, b2b boolean, promotion_ids string, "
        "ship_state string, size string, sku string",
    )
    from pyspark.sql import functions as F

    return df.withColumns(
        {"date": F.col("date").cast("timestamp_ntz"), "line_no": F.lit(1), "supp": F.lit(1)}
    )


@pytest.fixture(scope="session")
def inventory(spark):
    rows = [
        ("S1", "D1", 10.0, "Set", "M", "Red"),
        ("S2", "D2", 5.0, "Kurta", "L", "Blue"),
        ("S3", "D3", 0.0, "Set", "S", "Green"),
        ("S4", "D4", 20.0, "Top", "XL", "Black"),
        ("S5", "D5", 3.0, "Kurta", "M", "White"),
    ]
    return spark.createDataFrame(
        rows,
        "sku_code string, design_no string, stock double, category string, size string, color string",
    )


@pytest.fixture(scope="session")
def ledger(spark):
    """Header line, two lists side by side, a subtotal without a name, a total line."""
    spent = [380, 170, 839, 520, 500, 2506, 1290, 200, 400, 800, 120, 70, 300]
    earned = [1000, 1500, 500, 2000]
    rows = [(0, "Particular", "Amount", "Particular", "Amount")]
    for i, value in enumerate(spent):
        has = i < len(earned)
        rows.append(
            (i + 1, f"day {i}" if has else None, str(earned[i]) if has else None, f"item {i}", str(value))
        )
    rows += [
        (14, None, None, None, "8095"),
        (15, None, None, "pending", "-3095"),
        (16, "Total", "5000", None, "5000"),
    ]
    return spark.createDataFrame(
        rows,
        "idx int, income_particular string, income_amount string, "
        "expense_particular string, expense_amount string",
    )
