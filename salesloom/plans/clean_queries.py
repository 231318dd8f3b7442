"""Projections, filters and scalar functions over the canonical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.functions import scalars as S
from salesloom.operators import cleaning, features, kpis
from salesloom.plans.registry import query

KEY = ["order_id", "line_no", "sku", "supp"]
KEYS = ", ".join(KEY)

# Text with defects, made from whole columns by a rule: the input of the coercions.
MESSY_AMOUNT = """CASE WHEN line_no = 3 THEN 'n/k' WHEN line_no = 5 THEN concat(' ', CAST(qty AS STRING), ' ')
                  ELSE CAST(qty AS STRING) END"""
MESSY_DATE_SPARK = """CASE WHEN line_no = 2 THEN 'soon' WHEN line_no = 4 THEN date_format(date, 'MM/dd/yyyy')
                      WHEN line_no = 6 THEN CAST(date AS STRING)
                      ELSE date_format(date, 'MM-dd-yyyy') END"""


@query(
    "prj02_drop_columns",
    f"SELECT {KEYS}, status, amount FROM sales",
)
def _(t):
    wide = t.sales.select(*KEY, "status", "amount", "currency", F.col("style").alias("Unnamed: 22"))
    return cleaning.drop_columns(wide, ["Unnamed: 22", "currency", "index"])


@query(
    "prj03_rename_columns",
    """SELECT idx AS "index", income_particular AS income, expense_particular AS cost FROM expenses""",
)
def _(t):
    rows = t.expenses.select("idx", "income_particular", "expense_particular")
    return cleaning.rename(rows, {"income_particular": "income", "expense_particular": "cost"}).toDF(
        "index", "income", "cost"
    )


@query(
    "prj04_parse_dates",
    f"SELECT {KEYS}, CASE WHEN line_no = 2 THEN NULL ELSE date END AS parsed FROM sales_raw",
)
def _(t):
    text = t.sales_raw.select(*KEY, F.expr(MESSY_DATE_SPARK).alias("parsed"))
    return cleaning.coerce(text, {"parsed": "timestamp"})


@query(
    "prj05_parse_numbers",
    f"SELECT {KEYS}, CASE WHEN line_no = 3 THEN NULL ELSE CAST(qty AS DOUBLE) END AS parsed FROM sales_raw",
)
def _(t):
    text = t.sales_raw.select(*KEY, F.expr(MESSY_AMOUNT).alias("parsed"))
    return cleaning.coerce(text, {"parsed": "number"})


@query("prj06_derived_revenue", f"SELECT {KEYS}, amount, amount AS revenue FROM sales")
def _(t):
    return t.sales.select(*KEY, "amount").withColumn("revenue", F.col("amount"))


@query(
    "prj07_column_subset",
    "SELECT CAST(month(date) AS INT) AS month, qty, amount AS revenue FROM sales",
)
def _(t):
    return features.calendar_columns(t.sales).select("month", "qty", F.col("amount").alias("revenue"))


@query(
    "prj08_numeric_columns",
    "SELECT line_no, supp, qty, amount FROM sales_raw",
)
def _(t):
    return t.sales_raw.select(cleaning.numeric_columns(t.sales_raw))


@query(
    "prj09_text_categories",
    f"""SELECT {KEYS}, fulfilment, coalesce(ship_state, 'nan') AS ship_state,
               coalesce(promotion_ids, 'nan') AS promotion_ids, CAST(b2b AS VARCHAR) AS b2b FROM sales""",
)
def _(t):
    rows = t.sales.select(*KEY, "fulfilment", "ship_state", "promotion_ids", "b2b")
    return cleaning.text_categories(rows, ["fulfilment", "ship_state", "promotion_ids", "b2b"])


@query(
    "prj10_columns_side_by_side",
    f"""SELECT {KEYS}, CAST(qty AS DOUBLE) AS qty, amount,
               CAST(fulfilment = 'Amazon' AS INT) AS fulfilment_amazon,
               CAST(fulfilment = 'Merchant' AS INT) AS fulfilment_merchant FROM sales""",
)
def _(t):
    numbers = [F.col("qty").cast("double").alias("qty"), F.col("amount")]
    flags = [
        (F.col("fulfilment") == v).cast("int").alias(f"fulfilment_{v.lower()}")
        for v in ("Amazon", "Merchant")
    ]
    return t.sales.select(*KEY, *numbers, *flags)


@query(
    "prj11_align_features",
    f"SELECT amount, 0 AS not_there, qty, line_no, {KEYS.replace('line_no, ', '')} FROM sales",
)
def _(t):
    return cleaning.align_to(t.sales, ["amount", "not_there", "qty", "line_no", "order_id", "sku", "supp"])


@query("prj12_existing_columns", "SELECT qty, amount, fulfilment FROM sales")
def _(t):
    wanted = ["qty", "amount", "rating", "fulfilment", "courier_status"]
    return t.sales.select(cleaning.keep_existing(t.sales, wanted))


@query(
    "flt01_rows_without_gaps",
    f"""SELECT {KEYS}, amount, ship_state FROM sales_raw
        WHERE amount IS NOT NULL AND ship_state IS NOT NULL""",
)
def _(t):
    rows = t.sales_raw.select(*KEY, "amount", "ship_state")
    return cleaning.complete_rows(rows, ["amount", "ship_state"])


_DOUBLED = "(SELECT * FROM sales_raw UNION ALL SELECT * FROM sales_raw WHERE line_no = 7)"


def with_copies(t):
    return t.sales_raw.unionByName(t.sales_raw.where("line_no = 7"))


@query("flt02_drop_duplicates", f"SELECT DISTINCT * FROM {_DOUBLED}")
def _(t):
    return with_copies(t).dropDuplicates()


_SIGNED = "CASE WHEN status = 'Cancelled' AND b2b THEN -amount ELSE amount END"


@query(
    "flt04_negative_revenue",
    f"SELECT * FROM (SELECT {KEYS}, {_SIGNED} AS revenue FROM sales) WHERE revenue < 0",
)
def _(t):
    return t.sales.select(*KEY, F.expr(_SIGNED).alias("revenue")).where("revenue < 0")


@query(
    "flt05_cancelled_rows",
    f"""SELECT {KEYS}, upper(status) AS status, amount FROM sales_raw WHERE status ILIKE '%cancel%'""",
)
def _(t):
    rows = t.sales_raw.select(*KEY, F.upper("status").alias("status"), "amount")
    return rows.where(S.is_cancelled(F.col("status")))


@query(
    "flt06_positive_monetary",
    f"""SELECT order_id, round(sum({_SIGNED}), 2) AS monetary FROM sales
        GROUP BY order_id HAVING sum({_SIGNED}) > 0""",
)
def _(t):
    totals = t.sales.groupBy("order_id").agg(S.sum0(F.expr(_SIGNED)).alias("monetary"))
    return totals.where("monetary > 0").withColumn("monetary", F.round("monetary", 2))


@query(
    "flt07_flt08_ledger_rows",
    """SELECT idx, income_particular, expense_particular,
              TRY_CAST(income_amount AS DOUBLE) AS income_amount,
              TRY_CAST(expense_amount AS DOUBLE) AS expense_amount
       FROM expenses WHERE idx <> 0 AND income_particular IS DISTINCT FROM 'Total'""",
)
def _(t):
    return kpis.ledger_rows(t.expenses)


@query(
    "flt09_split_by_flag",
    """SELECT count(*) FILTER (WHERE b2b) AS b2b_rows, count(*) FILTER (WHERE NOT b2b) AS b2c_rows,
              round(sum(amount) FILTER (WHERE b2b), 2) AS b2b_revenue,
              round(sum(amount) FILTER (WHERE NOT b2b), 2) AS b2c_revenue FROM sales""",
)
def _(t):
    b2b, amount = F.col("b2b"), F.col("amount")
    return t.sales.agg(
        F.count(F.when(b2b, 1)).alias("b2b_rows"),
        F.count(F.when(~b2b, 1)).alias("b2c_rows"),
        F.round(F.sum(F.when(b2b, amount)), 2).alias("b2b_revenue"),
        F.round(F.sum(F.when(~b2b, amount)), 2).alias("b2c_revenue"),
    )


@query(
    "flt10_complete_rows",
    "SELECT * FROM sales_raw WHERE amount IS NOT NULL AND ship_state IS NOT NULL AND promotion_ids IS NOT NULL",
)
def _(t):
    return cleaning.complete_rows(t.sales_raw)


@query(
    "flt11_finite_values",
    f"""SELECT {KEYS}, CASE WHEN amount IS NULL OR line_no IN (1, 2, 3) THEN 0.0 ELSE amount END AS amount
        FROM sales_raw""",
)
def _(t):
    broken = F.expr(
        """CASE line_no WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE)
           WHEN 3 THEN CAST('-Infinity' AS DOUBLE) ELSE amount END"""
    )
    return cleaning.finite(t.sales_raw.select(*KEY, broken.alias("amount")), ["amount"])


@query(
    "flt12_fill_gaps",
    f"""SELECT {KEYS}, coalesce(amount, 0) AS amount, coalesce(ship_state, 'Unknown') AS ship_state,
               coalesce(promotion_ids, 'Unknown') AS promotion_ids FROM sales_raw""",
)
def _(t):
    rows = t.sales_raw.select(*KEY, "amount", "ship_state", "promotion_ids")
    return rows.fillna({"amount": 0, "ship_state": "Unknown", "promotion_ids": "Unknown"})


@query(
    "scl_scalar_pack",
    f"""SELECT {KEYS},
          CAST(coalesce(promotion_ids ILIKE '%promo%', false) AS INT) AS promo_text,
          CASE fulfilment WHEN 'Amazon' THEN 1 WHEN 'Merchant' THEN 0 ELSE 0 END AS fulfilment_code,
          CASE ship_service_level WHEN 'Expedited' THEN 1 ELSE 0 END AS service_code,
          CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
          CAST(quarter(date) AS INT) AS quarter, CAST(day(date) AS INT) AS day,
          monthname(date) AS month_name, CAST(isodow(date) - 1 AS INT) AS weekday,
          CAST(isodow(date) >= 6 AS INT) AS is_weekend, strftime(date, '%Y-%m') AS period,
          strftime(make_date(year(date), month(date), 1), '%Y-%m-%d') AS month_start,
          date + INTERVAL 1 DAY AS next_day,
          CAST(floor((epoch(TIMESTAMP '2002-01-01 12:00:00') - epoch(date)) / 86400) AS INT) AS age_days,
          round(CASE WHEN qty > 0 THEN amount / qty ELSE 0 END, 9) AS price_per_unit,
          round(ln(1 + qty), 9) AS log_qty,
          CAST(promotion_ids IS NOT NULL AS INT) AS has_promotion,
          coalesce(CAST(amount > 50000 AS INT), 0) AS over_50000,
          CASE WHEN qty >= 25 THEN 'bulk' ELSE 'single' END AS lot,
          round(qty * 1.0 / 50 * 100, 6) AS qty_pct, round_even(qty / 4.0, 1)::DOUBLE AS even_rounded,
          CAST(qty AS VARCHAR) AS qty_text, trim(concat(' ', category, ' ')) AS category
        FROM sales_raw""",
)
def _(t):
    d, qty, amount = F.col("date"), F.col("qty"), F.col("amount")
    fixed = F.lit("2002-01-01 12:00:00").cast("timestamp_ntz")
    return features.calendar_columns(t.sales_raw).select(
        *KEY,
        S.contains_ci(F.col("promotion_ids"), "promo").cast("int").alias("promo_text"),
        S.lookup(F.col("fulfilment"), {"Amazon": 1, "Merchant": 0}, 0).alias("fulfilment_code"),
        S.lookup(F.col("ship_service_level"), {"Expedited": 1, "Standard": 0}, 0).alias("service_code"),
        "year", "month", "quarter", "day", "month_name",
        S.weekday(d).alias("weekday"),
        S.is_weekend(d).alias("is_weekend"),
        S.month_period(d).alias("period"),
        F.date_format(S.month_start(F.year(d), F.month(d)), "yyyy-MM-dd").alias("month_start"),
        S.days_after(d, 1).alias("next_day"),
        S.days_between(d, fixed).cast("int").alias("age_days"),
        F.round(S.guarded_ratio(amount, qty), 9).alias("price_per_unit"),
        F.round(F.log1p(qty), 9).alias("log_qty"),
        F.col("promotion_ids").isNotNull().cast("int").alias("has_promotion"),
        S.to_flag(amount > 50000).alias("over_50000"),
        F.when(qty >= 25, "bulk").otherwise("single").alias("lot"),
        F.round(qty * F.lit(1.0) / 50 * 100, 6).alias("qty_pct"),
        F.bround(qty / F.lit(4.0), 1).alias("even_rounded"),
        qty.cast("string").alias("qty_text"),
        F.trim(F.concat(F.lit(" "), "category", F.lit(" "))).alias("category"),
    )
