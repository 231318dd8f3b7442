"""Sales joined with stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.scalars import sum0
from salesloom.operators.kpis import stock_by_category, top
from salesloom.workspace import stage


def join_category_stock(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each sale with the stock and the number of articles of its category.

    Inventory is summed per category first and the summary written, so it is
    made once. It is broadcast after its size was counted, so the fact does not
    shuffle on a handful of keys.
    """
    summary = stage(stock_by_category(inventory), "category-stock")
    return sales.join(summary, "category", "left")


def join_sku_stock(sales: DataFrame, inventory: DataFrame, match_missing: bool = False) -> DataFrame:
    """Each sale with the matching stock rows (SKU, category, size).

    Several stock rows for one article give several result rows. With
    ``match_missing`` missing keys match each other.
    """
    stock = inventory.select(
        F.col("sku_code"),
        "design_no",
        "stock",
        F.col("category").alias("_category"),
        F.col("size").alias("_size"),
        "color",
    )
    pairs = (("sku", "sku_code"), ("category", "_category"), ("size", "_size"))
    on = [
        sales[a].eqNullSafe(stock[b]) if match_missing else sales[a] == stock[b]
        for a, b in pairs
    ]
    return sales.join(stock, on, "left").drop("_category", "_size")


def coverage(joined: DataFrame, column: str = "total_stock") -> DataFrame:
    return joined.agg(
        F.count("*").alias("joined_rows"), F.count(column).alias("rows_with_stock")
    )


def sku_performance(
    sales: DataFrame, inventory: DataFrame, match_missing: bool = False, n: int = 10
) -> DataFrame:
    """Revenue per SKU and stock level, largest first.

    Both sides are summed on the join key before the join: revenue times the
    number of equal stock rows is what the row-by-row join would add up. A hot
    SKU is then one row, and nothing fans out.
    """
    keys = ["sku", "category", "size"]
    revenue = sales.groupBy(*keys).agg(F.sum("amount").alias("amount"))
    stock = (
        inventory.dropna(subset=["stock"])
        .groupBy(F.col("sku_code").alias("sku"), "category", "size", "stock")
        .agg(F.count("*").alias("copies"))
    )
    if match_missing:
        stock = stock.toDF("_sku", "_category", "_size", "stock", "copies")
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = revenue.join(stock, on)
    else:
        joined = revenue.join(stock, keys)
    totals = (
        joined.dropna(subset=["sku"])
        .groupBy("sku", "stock")
        .agg(sum0(F.col("amount") * F.col("copies")).alias("revenue"))
    )
    return top(totals, "revenue", "sku", "stock", n=n)
