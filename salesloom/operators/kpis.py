"""Revenue, order, cancellation and profit figures.

Every figure over the whole table comes from one aggregate with map-side partial
sums. Distinct orders are counted over per-order rows, so a hot order shrinks to
one row per task before the shuffle, and several distinct counts do not multiply
the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.scalars import (
    is_cancelled,
    month_period,
    month_start,
    sum0,
    to_number,
)


def per_order(sales: DataFrame, *keys: str) -> DataFrame:
    """One row per order (and key) with its sums; input of the distinct counts."""
    cancelled = is_cancelled(F.col("status"))
    return sales.groupBy(*keys, "order_id").agg(
        F.sum("amount").alias("amount"),
        F.sum("qty").alias("qty"),
        F.count("*").alias("rows"),
        F.count(F.when(cancelled, 1)).alias("cancelled_rows"),
        F.sum(F.when(cancelled, F.col("amount"))).alias("cancelled_amount"),
    )


def _ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def headline(sales: DataFrame) -> DataFrame:
    """All whole-table figures in one pass."""
    orders = F.count("order_id")
    hit = F.count(F.when(F.col("cancelled_rows") > 0, F.col("order_id")))
    revenue = sum0(F.col("amount"))
    return per_order(sales).agg(
        revenue.alias("total_revenue"),
        orders.alias("total_orders"),
        sum0(F.col("qty")).cast("bigint").alias("total_units"),
        _ratio0(revenue, orders).alias("average_order_value"),
        sum0(F.col("cancelled_amount")).alias("cancelled_revenue"),
        _ratio0(hit, orders).alias("cancellation_rate_orders"),
        _ratio0(F.sum("cancelled_rows"), F.sum("rows")).alias("cancellation_rate_rows"),
    )


def cancellation_rate_rows(sales: DataFrame) -> DataFrame:
    """Share of cancelled rows: one aggregate, no shuffle of rows."""
    hit = F.count(F.when(is_cancelled(F.col("status")), 1))
    return sales.agg(_ratio0(hit, F.count("*")).alias("cancellation_rate_rows"))


def total_revenue(sales: DataFrame) -> DataFrame:
    return sales.agg(sum0(F.col("amount")).alias("total_revenue"))


def total_units(sales: DataFrame) -> DataFrame:
    return sales.agg(sum0(F.col("qty")).cast("bigint").alias("total_units"))


def cancelled_revenue(sales: DataFrame) -> DataFrame:
    hit = F.when(is_cancelled(F.col("status")), F.col("amount"))
    return sales.agg(sum0(hit).alias("cancelled_revenue"))


def revenue_by(sales: DataFrame, *keys: str, keep_missing: bool = False) -> DataFrame:
    """Revenue per key. Rows without a key are left out unless asked for."""
    if not keep_missing:
        sales = sales.dropna(subset=list(keys))
    return sales.groupBy(*keys).agg(sum0(F.col("amount")).alias("revenue"))


def orders_by(sales: DataFrame, *keys: str) -> DataFrame:
    return (
        sales.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count_distinct("order_id").alias("orders"))
    )


def top(df: DataFrame, measure: str, *keys: str, n: int = 10) -> DataFrame:
    """The n largest, ties broken by key; planned as a per-task top-n and a merge."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *keys).limit(n)


def preview(df: DataFrame, n: int = 20, order: list[str] | None = None) -> DataFrame:
    """Any n rows, or the first n in an order."""
    return (df.orderBy(*order) if order else df).limit(n)


def monthly_revenue(sales: DataFrame) -> DataFrame:
    date = F.col("date")
    return (
        sales.where(date.isNotNull())
        .groupBy(F.year(date).alias("year"), F.month(date).alias("month"))
        .agg(sum0(F.col("amount")).alias("revenue"))
    )


def monthly_trend(sales: DataFrame) -> DataFrame:
    """Monthly revenue with the period as text and as the date of its first day."""
    start = month_start(F.col("year"), F.col("month"))
    return monthly_revenue(sales).select(
        "year", "month", month_period(start).alias("period"), start.alias("start"), "revenue"
    )


def monthly_growth(sales: DataFrame) -> DataFrame:
    """Change of revenue to the month before, in percent.

    The window has no partition on purpose: it runs on the monthly aggregate,
    which has one row per calendar month however long the fact table is.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("year", "month")
    last = F.lag("revenue").over(order)
    return monthly_revenue(sales).withColumn(
        "growth_pct", F.try_divide(F.col("revenue") - last, last) * 100
    )


def daily_revenue(sales: DataFrame) -> DataFrame:
    day = F.date_format("date", "yyyy-MM-dd").alias("day")
    return (
        sales.where(F.col("date").isNotNull())
        .groupBy(day)
        .agg(sum0(F.col("amount")).alias("revenue"))
    )


def peak_months(sales: DataFrame, n: int = 3) -> DataFrame:
    """Months with the most orders."""
    monthly = sales.where(F.col("date").isNotNull()).select(
        month_period(F.col("date")).alias("period"), "order_id"
    )
    return top(orders_by(monthly, "period"), "orders", "period", n=n)


def status_counts(sales: DataFrame, column: str = "status") -> DataFrame:
    return (
        sales.dropna(subset=[column])
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), column)
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def top_share(sales: DataFrame, key: str = "ship_state", n: int = 5) -> DataFrame:
    """Share of the n largest keys in the revenue of all rows that have a key."""
    by_key = revenue_by(sales, key)
    largest = top(by_key, "revenue", key, n=n).agg(F.sum("revenue")).scalar()
    return by_key.agg(F.try_divide(largest, F.sum("revenue")).alias("top_share"))


def with_share(df: DataFrame, measure: str, share: str) -> DataFrame:
    """Each row's part of the total, in percent."""
    total = df.agg(F.sum(measure)).scalar()
    return df.withColumn(share, F.try_divide(F.col(measure), total) * 100)


def stock_by_category(inventory: DataFrame) -> DataFrame:
    return (
        inventory.dropna(subset=["category"])
        .groupBy("category")
        .agg(
            sum0(F.col("stock")).alias("total_stock"),
            F.count_distinct("sku_code").alias("unique_skus"),
        )
    )


def inventory_turnover(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    stock = inventory.agg(F.sum("stock")).scalar()
    return sales.agg(F.try_divide(F.sum("qty"), stock).alias("inventory_turnover"))


def ledger_rows(expenses: DataFrame, drop_unlabelled: bool = False) -> DataFrame:
    """Ledger entries as numbers, without the repeated header and the total line.

    The header is the row with index 0; where the table was loaded without its
    index the header stays, and as its amounts are no numbers it adds nothing.
    A missing label is not the total line, so such rows stay. Subtotals without
    a label can be left out with ``drop_unlabelled``.
    """
    rows = expenses.where(~F.col("income_particular").eqNullSafe("Total"))
    for index in ("idx", "index"):
        if index in expenses.columns:
            rows = rows.where(F.col(index).cast("string") != "0")
    if drop_unlabelled:
        rows = rows.dropna(subset=["expense_particular"])
    return rows.withColumns(
        {c: to_number(F.col(c).cast("string")) for c in ("income_amount", "expense_amount")}
    )


def ledger_totals(expenses: DataFrame, drop_unlabelled: bool = False) -> DataFrame:
    income, expense = sum0(F.col("income_amount")), sum0(F.col("expense_amount"))
    return ledger_rows(expenses, drop_unlabelled).agg(
        income.alias("total_income"),
        expense.alias("total_expense"),
        (income - expense).alias("net_profit"),
    )


def profit(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    cost = ledger_totals(expenses).select("total_expense").scalar()
    revenue = F.col("total_revenue")
    return total_revenue(sales).select(
        (revenue - cost).alias("profit"),
        F.try_divide(revenue - cost, revenue).alias("profit_margin"),
    )


def executive_summary(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """The eight figures of the executive report as (kpi, value)."""
    cost = ledger_totals(expenses).select("total_expense").scalar()
    wide = headline(sales).withColumn("total_expense", cost)
    gain = F.col("total_revenue") - F.col("total_expense")
    # The names of the report's figures.
    figures = {
        "Total Revenue": F.col("total_revenue"),
        "Total Orders": F.col("total_orders"),
        "Total Units Sold": F.col("total_units"),
        "Average Order Value": F.col("average_order_value"),
        "Cancelled Revenue": F.col("cancelled_revenue"),
        "Total Expense": F.col("total_expense"),
        "Profit": gain,
        "Profit Margin": F.try_divide(gain, F.col("total_revenue")),
    }
    named = wide.select([v.cast("double").alias(k) for k, v in figures.items()])
    return named.unpivot([], list(figures), "kpi", "value")


def category_performance(sales: DataFrame) -> DataFrame:
    return (
        sales.dropna(subset=["category"])
        .groupBy("category")
        .agg(sum0(F.col("amount")).alias("revenue"), sum0(F.col("qty")).alias("units"))
    )


def units_by(sales: DataFrame, *keys: str) -> DataFrame:
    return (
        sales.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(sum0(F.col("qty")).cast("bigint").alias("units"))
    )


def cross_border_orders(sales: DataFrame, home: str = "IN") -> DataFrame:
    """Orders per country, with a flag for those outside the home country."""
    return orders_by(sales, "ship_country").withColumn(
        "cross_border", F.col("ship_country") != home
    )


def promotion_share(sales: DataFrame) -> DataFrame:
    """Part of orders with a promotion and of revenue sold under one."""
    promoted = F.col("promotion_ids").isNotNull()
    orders = sales.groupBy("order_id").agg(
        F.sum("amount").alias("amount"),
        F.sum(F.when(promoted, F.col("amount"))).alias("promoted_amount"),
        F.max(promoted).alias("promoted"),
    )
    return orders.agg(
        _ratio0(F.count(F.when(F.col("promoted"), F.col("order_id"))), F.count("order_id")).alias(
            "order_share"
        ),
        _ratio0(F.sum("promoted_amount"), F.sum("amount")).alias("revenue_share"),
    )


def b2b_share(sales: DataFrame) -> DataFrame:
    orders = sales.groupBy("order_id").agg(F.max("b2b").alias("b2b"))
    return orders.agg(
        _ratio0(F.count(F.when(F.col("b2b"), F.col("order_id"))), F.count("order_id")).alias(
            "b2b_order_share"
        )
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count(label).alias("total"),
        sum0(F.col(label)).cast("bigint").alias("positive"),
        F.avg(label).alias("positive_share"),
    )
