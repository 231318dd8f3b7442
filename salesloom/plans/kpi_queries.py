"""Aggregates, KPIs, top lists, shares and SQL templates over the canonical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.operators import cleaning, enrich, kpis, sqllib
from salesloom.plans.registry import query
from salesloom.sources import sinks
from salesloom.workspace import new_path


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("agg01_total_revenue", "SELECT round(coalesce(sum(amount), 0), 2) AS total_revenue FROM sales")
def _(t):
    return rounded(kpis.total_revenue(t.sales), 2, "total_revenue")


@query("agg02_distinct_orders", "SELECT count(DISTINCT order_id) AS total_orders FROM sales")
def _(t):
    return kpis.headline(t.sales).select("total_orders")


@query("agg03_total_units", "SELECT CAST(sum(qty) AS BIGINT) AS total_units FROM sales")
def _(t):
    return kpis.total_units(t.sales)


@query(
    "agg04_average_order_value",
    "SELECT round(sum(amount) / count(DISTINCT order_id), 6) AS average_order_value FROM sales",
)
def _(t):
    return rounded(
        kpis.headline(t.sales).select("average_order_value"), 6, "average_order_value"
    )


@query(
    "agg05_cancelled_revenue",
    """SELECT round(coalesce(sum(amount) FILTER (WHERE status ILIKE '%cancel%'), 0), 2)
              AS cancelled_revenue FROM sales""",
)
def _(t):
    return rounded(kpis.cancelled_revenue(t.sales), 2, "cancelled_revenue")


@query(
    "agg06_cancellation_rate_orders",
    """SELECT round(count(DISTINCT CASE WHEN status ILIKE '%cancel%' THEN order_id END)
              / CAST(count(DISTINCT order_id) AS DOUBLE), 9) AS cancellation_rate_orders FROM sales""",
)
def _(t):
    return rounded(
        kpis.headline(t.sales).select("cancellation_rate_orders"), 9, "cancellation_rate_orders"
    )


@query(
    "agg07_cancellation_rate_rows",
    """SELECT round(avg(CASE WHEN status ILIKE '%cancel%' THEN 1.0 ELSE 0.0 END), 9)
              AS cancellation_rate_rows FROM sales""",
)
def _(t):
    return rounded(
        kpis.cancellation_rate_rows(t.sales), 9, "cancellation_rate_rows"
    )


@query(
    "agg08_monthly_revenue",
    """SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
              strftime(date, '%Y-%m') AS period, round(sum(amount), 2) AS revenue
       FROM sales WHERE date IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return rounded(kpis.monthly_trend(t.sales).drop("start"), 2, "revenue")


def _top_revenue(key: str) -> str:
    return f"""SELECT {key}, round(sum(amount), 2) AS revenue FROM sales
               WHERE {key} IS NOT NULL GROUP BY {key}
               ORDER BY sum(amount) DESC, {key} LIMIT 10"""


@query("agg09_revenue_by_category", _top_revenue("category"))
def _(t):
    return rounded(kpis.top(kpis.revenue_by(t.sales, "category"), "revenue", "category"), 2, "revenue")


@query("agg10_revenue_by_sku", _top_revenue("sku"))
def _(t):
    return rounded(kpis.top(kpis.revenue_by(t.sales, "sku"), "revenue", "sku"), 2, "revenue")


@query("agg11_revenue_by_state", _top_revenue("ship_state"))
def _(t):
    return rounded(
        kpis.top(kpis.revenue_by(t.sales, "ship_state"), "revenue", "ship_state"), 2, "revenue"
    )


@query(
    "agg11_revenue_by_state_all",
    """SELECT ship_state, round(sum(amount), 2) AS revenue FROM sales
       WHERE ship_state IS NOT NULL GROUP BY ship_state""",
)
def _(t):
    return rounded(kpis.revenue_by(t.sales, "ship_state"), 2, "revenue")


@query("agg12_revenue_by_b2b", "SELECT b2b, round(sum(amount), 2) AS revenue FROM sales GROUP BY b2b")
def _(t):
    return rounded(kpis.revenue_by(t.sales, "b2b"), 2, "revenue")


@query("agg13_status_counts", "SELECT status, count(*) AS count FROM sales GROUP BY status")
def _(t):
    return kpis.status_counts(t.sales)


@query("agg14_distinct_statuses", "SELECT DISTINCT status FROM sales")
def _(t):
    return kpis.distinct_values(t.sales, "status")


@query(
    "agg15_top5_state_share",
    """WITH r AS (SELECT ship_state, sum(amount) AS rev FROM sales
                  WHERE ship_state IS NOT NULL GROUP BY ship_state)
       SELECT round((SELECT sum(rev) FROM (SELECT rev FROM r ORDER BY rev DESC, ship_state LIMIT 5))
                    / (SELECT sum(rev) FROM r), 9) AS top_share""",
)
def _(t):
    return rounded(kpis.top_share(t.sales), 9, "top_share")


@query(
    "agg16_sku_stock_performance",
    """SELECT sku, stock, round(sum(amount), 2) AS revenue
       FROM sales s JOIN inventory i
         ON s.sku = i.sku_code AND s.category = i.category AND s.size = i.size
       WHERE stock IS NOT NULL GROUP BY sku, stock
       ORDER BY sum(amount) DESC, sku, stock LIMIT 10""",
)
def _(t):
    return rounded(enrich.sku_performance(t.sales, t.inventory), 2, "revenue")


@query(
    "agg17_stock_by_category",
    """SELECT category, sum(stock) AS total_stock, count(DISTINCT sku_code) AS unique_skus
       FROM inventory WHERE category IS NOT NULL GROUP BY category""",
)
def _(t):
    return kpis.stock_by_category(t.inventory)


@query(
    "agg18_inventory_turnover",
    """SELECT round((SELECT sum(qty) FROM sales) / (SELECT sum(stock) FROM inventory), 9)
              AS inventory_turnover""",
)
def _(t):
    return rounded(kpis.inventory_turnover(t.sales, t.inventory), 9, "inventory_turnover")


_LEDGER = """WITH ledger AS (
    SELECT TRY_CAST(income_amount AS DOUBLE) AS inc, TRY_CAST(expense_amount AS DOUBLE) AS exp,
           expense_particular
    FROM expenses WHERE idx <> 0 AND income_particular IS DISTINCT FROM 'Total')
"""


@query(
    "agg19_ledger_totals",
    _LEDGER
    + """SELECT round(coalesce(sum(inc), 0), 2) AS total_income,
                round(coalesce(sum(exp), 0), 2) AS total_expense,
                round(coalesce(sum(inc), 0) - coalesce(sum(exp), 0), 2) AS net_profit FROM ledger""",
)
def _(t):
    return rounded(
        kpis.ledger_totals(t.expenses), 2, "total_income", "total_expense", "net_profit"
    )


@query(
    "agg20_profit_and_margin",
    _LEDGER
    + """SELECT round(rev - cost, 2) AS profit, round((rev - cost) / rev, 9) AS profit_margin
         FROM (SELECT (SELECT sum(amount) FROM sales) AS rev, (SELECT sum(exp) FROM ledger) AS cost)""",
)
def _(t):
    out = kpis.profit(t.sales, t.expenses)
    return out.select(
        F.round("profit", 2).alias("profit"), F.round("profit_margin", 9).alias("profit_margin")
    )


@query(
    "agg21_executive_summary",
    _LEDGER
    + """, f AS (
      SELECT sum(amount) AS rev, count(DISTINCT order_id) AS orders, sum(qty) AS units,
             sum(CASE WHEN status ILIKE '%cancel%' THEN amount END) AS cancelled,
             (SELECT sum(exp) FROM ledger) AS cost FROM sales)
    SELECT kpi, round(CAST(value AS DOUBLE), 2) AS value FROM (
      SELECT 'Total Revenue' AS kpi, rev AS value FROM f
      UNION ALL SELECT 'Total Orders', orders FROM f
      UNION ALL SELECT 'Total Units Sold', units FROM f
      UNION ALL SELECT 'Average Order Value', rev / orders FROM f
      UNION ALL SELECT 'Cancelled Revenue', cancelled FROM f
      UNION ALL SELECT 'Total Expense', cost FROM f
      UNION ALL SELECT 'Profit', rev - cost FROM f
      UNION ALL SELECT 'Profit Margin', (rev - cost) / rev FROM f)""",
)
def _(t):
    return rounded(kpis.executive_summary(t.sales, t.expenses), 2, "value")


@query(
    "win02_monthly_growth",
    """WITH m AS (SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
                         sum(amount) AS rev FROM sales WHERE date IS NOT NULL GROUP BY ALL)
       SELECT year, month, round(rev, 2) AS revenue,
              round((rev - lag(rev) OVER w) / lag(rev) OVER w * 100, 6) AS growth_pct
       FROM m WINDOW w AS (ORDER BY year, month)""",
)
def _(t):
    return rounded(rounded(kpis.monthly_growth(t.sales), 2, "revenue"), 6, "growth_pct")


@query(
    "win05_share_of_total",
    """SELECT ship_state, round(sum(amount), 2) AS revenue,
              round(sum(amount) / sum(sum(amount)) OVER () * 100, 6) AS share_pct
       FROM sales WHERE ship_state IS NOT NULL GROUP BY ship_state""",
)
def _(t):
    shared = kpis.with_share(kpis.revenue_by(t.sales, "ship_state"), "revenue", "share_pct")
    return rounded(rounded(shared, 2, "revenue"), 6, "share_pct")


@query(
    "srt01_top_categories",
    """SELECT category, round(sum(amount), 2) AS revenue, CAST(sum(qty) AS BIGINT) AS units
       FROM sales WHERE category IS NOT NULL GROUP BY category
       ORDER BY sum(qty) DESC, category LIMIT 3""",
)
def _(t):
    return rounded(
        kpis.top(kpis.category_performance(t.sales), "units", "category", n=3), 2, "revenue"
    )


@query(
    "kpi01_revenue_by_currency",
    "SELECT currency, round(sum(amount), 2) AS revenue FROM sales GROUP BY currency",
)
def _(t):
    return rounded(kpis.revenue_by(t.sales, "currency"), 2, "revenue")


def _orders_by(key: str) -> str:
    return f"""SELECT {key}, count(DISTINCT order_id) AS orders FROM sales
               WHERE {key} IS NOT NULL GROUP BY {key}"""


@query("kpi02_orders_by_fulfilment", _orders_by("fulfilment"))
def _(t):
    return kpis.orders_by(t.sales, "fulfilment")


@query("kpi03_orders_by_service_level", _orders_by("ship_service_level"))
def _(t):
    return kpis.orders_by(t.sales, "ship_service_level")


# The star schema has no courier, city, country or channel. The same operators run
# on the columns of the same role that it has.
@query("kpi04_orders_by_delivery_status", _orders_by("status"))
def _(t):
    return kpis.orders_by(t.sales, "status")


@query("kpi08_orders_by_destination", _orders_by("ship_state"))
def _(t):
    return kpis.orders_by(t.sales, "ship_state")


@query(
    "kpi09_cross_border_orders",
    """SELECT ship_state AS ship_country, count(DISTINCT order_id) AS orders,
              ship_state <> 'NATION_0' AS cross_border
       FROM sales WHERE ship_state IS NOT NULL GROUP BY ship_state""",
)
def _(t):
    return kpis.cross_border_orders(
        t.sales.withColumnRenamed("ship_state", "ship_country"), home="NATION_0"
    )


@query(
    "kpi10_revenue_by_channel",
    """SELECT fulfilment, ship_service_level, round(sum(amount), 2) AS revenue
       FROM sales GROUP BY ALL""",
)
def _(t):
    return rounded(kpis.revenue_by(t.sales, "fulfilment", "ship_service_level"), 2, "revenue")


@query(
    "kpi05_category_performance",
    """SELECT category, round(sum(amount), 2) AS revenue, CAST(sum(qty) AS BIGINT) AS units
       FROM sales WHERE category IS NOT NULL GROUP BY category""",
)
def _(t):
    return rounded(kpis.category_performance(t.sales), 2, "revenue")


def _top_units(*keys: str) -> str:
    cols = ", ".join(keys)
    return f"""SELECT {cols}, CAST(sum(qty) AS BIGINT) AS units FROM sales
               GROUP BY {cols} ORDER BY sum(qty) DESC, {cols} LIMIT 10"""


@query("kpi06_best_selling_skus", _top_units("sku", "style"))
def _(t):
    return kpis.top(kpis.units_by(t.sales, "sku", "style"), "units", "sku", "style")


@query("kpi06_best_selling_styles", _top_units("style"))
def _(t):
    return kpis.top(kpis.units_by(t.sales, "style"), "units", "style")


@query(
    "kpi07_units_by_size",
    "SELECT size, CAST(sum(qty) AS BIGINT) AS units FROM sales WHERE size IS NOT NULL GROUP BY size",
)
def _(t):
    return kpis.units_by(t.sales, "size")


@query(
    "kpi11_promotion_share",
    """SELECT round(count(DISTINCT CASE WHEN promotion_ids IS NOT NULL THEN order_id END)
                    / CAST(count(DISTINCT order_id) AS DOUBLE), 9) AS order_share,
              round(sum(CASE WHEN promotion_ids IS NOT NULL THEN amount END) / sum(amount), 9)
                    AS revenue_share FROM sales""",
)
def _(t):
    return rounded(kpis.promotion_share(t.sales), 9, "order_share", "revenue_share")


@query(
    "kpi12_b2b_share",
    """SELECT round(count(DISTINCT CASE WHEN b2b THEN order_id END)
                    / CAST(count(DISTINCT order_id) AS DOUBLE), 9) AS b2b_order_share FROM sales""",
)
def _(t):
    return rounded(kpis.b2b_share(t.sales), 9, "b2b_order_share")


@query(
    "kpi13_daily_revenue",
    """SELECT strftime(date, '%Y-%m-%d') AS day, round(sum(amount), 2) AS revenue
       FROM sales WHERE date IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return rounded(kpis.daily_revenue(t.sales), 2, "revenue")


@query(
    "kpi14_peak_months",
    """SELECT strftime(date, '%Y-%m') AS period, count(DISTINCT order_id) AS orders
       FROM sales WHERE date IS NOT NULL GROUP BY ALL ORDER BY orders DESC, period LIMIT 3""",
)
def _(t):
    return kpis.peak_months(t.sales)


@query(
    "join01_category_stock",
    """SELECT s.order_id, s.line_no, s.sku, s.supp, s.category, s.amount, i.total_stock, i.unique_skus
       FROM sales s LEFT JOIN (
         SELECT category, sum(stock) AS total_stock, count(DISTINCT sku_code) AS unique_skus
         FROM inventory WHERE category IS NOT NULL GROUP BY category) i USING (category)""",
)
def _(t):
    return enrich.join_category_stock(t.sales, t.inventory).select(
        "order_id", "line_no", "sku", "supp", "category", "amount", "total_stock", "unique_skus"
    )


_SKU_COLUMNS = ["order_id", "line_no", "sku", "supp", "size", "amount", "sku_code", "stock", "color"]


@query(
    "join02_sku_stock",
    """SELECT s.order_id, s.line_no, s.sku, s.supp, s.size, s.amount, i.sku_code, i.stock, i.color
       FROM sales s LEFT JOIN inventory i
         ON s.sku = i.sku_code AND s.category = i.category AND s.size = i.size""",
)
def _(t):
    return enrich.join_sku_stock(t.sales, t.inventory).select(_SKU_COLUMNS)


_MISSING_SKUS = """CASE WHEN CAST(sku AS BIGINT) % 50 = 0 THEN NULL ELSE sku END"""


@query(
    "join02_sku_stock_missing_keys_match",
    f"""SELECT s.order_id, s.line_no, s.msku AS sku, s.supp, s.size, s.amount,
               i.sku_code, i.stock, i.color
        FROM (SELECT *, {_MISSING_SKUS} AS msku FROM sales) s LEFT JOIN inventory i
          ON s.msku IS NOT DISTINCT FROM i.sku_code
         AND s.category IS NOT DISTINCT FROM i.category
         AND s.size IS NOT DISTINCT FROM i.size""",
)
def _(t):
    sales = t.sales.withColumn("sku", F.expr(_MISSING_SKUS))
    return enrich.join_sku_stock(sales, t.inventory, match_missing=True).select(_SKU_COLUMNS)


@query(
    "join03_enrichment_coverage",
    """SELECT count(*) AS joined_rows, count(total_stock) AS rows_with_stock
       FROM sales LEFT JOIN (SELECT category, sum(stock) AS total_stock FROM inventory
                             WHERE category IS NOT NULL GROUP BY category) USING (category)""",
)
def _(t):
    return enrich.coverage(enrich.join_category_stock(t.sales, t.inventory))


@query(
    "join04_against_whole_table",
    """SELECT order_id, line_no, sku, supp, amount,
              CAST(amount > (SELECT avg(amount) FROM sales) AS INT) AS above_average,
              CAST(date_diff('day', date, (SELECT max(date) FROM sales)) AS INT) AS days_to_last
       FROM sales""",
)
def _(t):
    whole = t.sales.agg(F.avg("amount").alias("mean"), F.max("date").alias("last"))
    row = whole.select(F.struct("mean", "last")).scalar()
    marked = t.sales.select("order_id", "line_no", "sku", "supp", "amount", "date", row.alias("w"))
    return marked.select(
        "order_id", "line_no", "sku", "supp", "amount",
        (F.col("amount") > F.col("w.mean")).cast("int").alias("above_average"),
        F.extract(F.lit("DAY"), F.col("w.last") - F.col("date")).cast("int").alias("days_to_last"),
    )


# The templates as DuckDB text; Spark runs the texts in operators/sqllib.py.
_TEMPLATES = {
    "sql01_revenue_by_category": (
        "revenue_by_category",
        """SELECT category, round(sum(amount), 2) AS total_revenue, count(*) AS order_count
           FROM sales GROUP BY category ORDER BY sum(amount) DESC, category LIMIT 10""",
        ["total_revenue"],
    ),
    "sql02_monthly_revenue": (
        "monthly_revenue",
        """SELECT strftime(date, '%Y-%m') AS month, round(sum(amount), 2) AS revenue
           FROM sales WHERE date IS NOT NULL GROUP BY ALL""",
        ["revenue"],
    ),
    "sql03_cancellation_by_fulfilment": (
        "cancellation_by_fulfilment",
        """SELECT fulfilment, round(avg(CASE WHEN status ILIKE '%cancel%' THEN 1.0 ELSE 0.0 END), 6)
                  AS cancel_rate, count(*) AS total_orders FROM sales GROUP BY fulfilment""",
        ["cancel_rate"],
    ),
    "sql04_b2b_performance": (
        "b2b_performance",
        """SELECT b2b, count(*) AS orders, round(sum(amount), 2) AS revenue,
                  round(avg(amount), 6) AS avg_order_value FROM sales GROUP BY b2b""",
        ["revenue", "avg_order_value"],
    ),
    "sql05_top_states": (
        "top_states",
        """SELECT ship_state, round(sum(amount), 2) AS revenue, count(*) AS orders
           FROM sales GROUP BY ship_state ORDER BY sum(amount) DESC, ship_state LIMIT 10""",
        ["revenue"],
    ),
}


def _register_template(name: str, template: str, sql: str, money: list[str]) -> None:
    digits = {"cancel_rate": 6, "avg_order_value": 6}

    @query(name, sql)
    def _(t):
        out = sqllib.run_template(t.spark, template, {"sales": t.sales})
        return out.withColumns({c: F.round(c, digits.get(c, 2)) for c in money})


for _name, (_template, _sql, _money) in _TEMPLATES.items():
    _register_template(_name, _template, _sql, _money)


@query(
    "sql06_user_statement",
    """SELECT s.category, s.fulfilment, count(*) AS line_items, round(sum(s.amount), 2) AS revenue,
              max(i.stock) AS best_stock
       FROM sales s JOIN inventory i ON s.sku = i.sku_code
       GROUP BY s.category, s.fulfilment HAVING count(*) > 1""",
)
def _(t):
    return sqllib.run_user_sql(
        t.spark,
        """SELECT s.Category AS category, s.Fulfilment AS fulfilment, count(*) AS line_items,
                  round(sum(s.Amount), 2) AS revenue, max(i.stock) AS best_stock
           FROM sales s JOIN inventory i ON s.sku = i.sku_code
           GROUP BY s.category, s.fulfilment HAVING count(*) > 1""",
        {"sales": t.sales, "inventory": t.inventory},
    )


@query(
    "snk02_registered_tables",
    """SELECT 'sales' AS table_name, count(*) AS n FROM sales
       UNION ALL SELECT 'inventory', count(*) FROM inventory
       UNION ALL SELECT 'expenses', count(*) FROM expenses""",
)
def _(t):
    tables = {"sales": t.sales, "inventory": t.inventory, "expenses": t.expenses}
    parts = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in tables)
    return sqllib.run_user_sql(t.spark, parts, tables)


_RANGE_COLUMNS = ["order_id", "line_no", "sku", "supp", "date", "amount"]
_RANGE_SQL = """SELECT order_id, line_no, sku, supp, date, amount FROM sales
    WHERE date >= TIMESTAMP '1996-01-01' AND date <= TIMESTAMP '1997-06-30'"""


@query("flt03_date_range", _RANGE_SQL)
def _(t):
    return cleaning.date_range(t.sales, "date", "1996-01-01", "1997-06-30").select(_RANGE_COLUMNS)


@query("flt03_date_range_of_stored_sales", _RANGE_SQL)
def _(t):
    path = new_path(t.spark, "stored-sales")
    sinks.store_sales(t.sales, path)
    stored = sinks.stored_sales(t.spark, path, t.sales.schema)
    return cleaning.date_range(stored, "date", "1996-01-01", "1997-06-30").select(_RANGE_COLUMNS)
