"""The rules for missing, malformed and extreme values."""

import math

from pyspark.sql import functions as F

from salesloom.contracts import MISSING_TOKENS
from salesloom.functions import scalars as S
from salesloom.operators import cleaning, enrich, kpis, profiling, scoring, sqllib
from salesloom.plans.source_queries import export_rows
from salesloom.sources import csv_tables, sinks
from salesloom.workspace import file_state, new_path


def one(spark, column, **values):
    row = [tuple(values.values())]
    return spark.createDataFrame(row, ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_groups_without_key(spark):
    df = spark.createDataFrame([("x", 1.0), (None, 2.0), ("y", None)], "category string, amount double")
    rows = {r.category: r.revenue for r in kpis.revenue_by(df, "category").collect()}
    assert rows == {"x": 1.0, "y": 0.0}
    kept = kpis.revenue_by(df, "category", keep_missing=True)
    assert kept.count() == 3


def test_sql_keeps_missing_groups(spark, sales):
    rows = sales.withColumn("category", F.when(F.col("category") != "Top", F.col("category")))
    out = sqllib.run_template(spark, "revenue_by_category", {"sales": rows}).collect()
    assert {r.category for r in out} == {None, "Set", "Kurta"}


def test_numbers(spark):
    x = F.col("x")
    for text, want in [("12", 12.0), (" 7.5 ", 7.5), ("-1e3", -1000.0), (".5", 0.5)]:
        assert one(spark, S.to_number(x), x=text) == want
    for text in ("abc", "1d", "inf", "", "1,000", None):
        assert one(spark, S.to_number(x), x=text) is None


def test_dates(spark):
    x = F.col("x")
    for text in ("04-30-22", "04-30-2022", "2022-04-30", "04/30/2022", "2022-04-30 00:00:00"):
        assert str(one(spark, S.to_timestamp(x), x=text)) == "2022-04-30 00:00:00"
    for text in ("soon", "13-45-22", None):
        assert one(spark, S.to_timestamp(x), x=text) is None


def test_cancelled_ignores_case_and_gaps(spark):
    x = F.col("x")
    assert one(spark, S.is_cancelled(x), x="CANCELLED - by buyer") is True
    assert one(spark, S.is_cancelled(x), x=None) is False


def test_null_safe_inequality(ledger):
    assert kpis.ledger_rows(ledger).count() == 15


def test_join_on_missing_keys(spark, sales, inventory):
    rows = sales.withColumn("sku", F.when(F.col("sku") != "S1", F.col("sku")))
    stock = inventory.withColumn("sku_code", F.when(F.col("sku_code") != "S1", F.col("sku_code")))
    plain = enrich.join_sku_stock(rows, stock).where("stock IS NOT NULL").count()
    both = enrich.join_sku_stock(rows, stock, match_missing=True).where("stock IS NOT NULL").count()
    assert (plain, both) == (4, 5)


def test_division_by_zero(spark):
    df = spark.createDataFrame([(10.0, 0), (10.0, -1), (10.0, 4), (None, 2)], "a double, q int")
    got = [r[0] for r in df.select(S.guarded_ratio(F.col("a"), F.col("q"))).collect()]
    assert got == [0.0, 0.0, 2.5, None]


def test_whole_days(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2022-01-01 12:00' a, TIMESTAMP_NTZ'2022-01-03 11:00' b")
    assert df.select(S.days_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_finite(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (2.0,)], "x double")
    assert [r.x for r in cleaning.finite(df, ["x"]).collect()] == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_date_range_ends_at_midnight(sales):
    late = sales.withColumn("date", F.col("date") + F.expr("INTERVAL '1' HOUR"))
    assert cleaning.date_range(sales, "date", "2022-01-10", "2022-02-01").count() == 3
    assert cleaning.date_range(late, "date", "2022-01-10", "2022-02-01").count() == 2
    assert cleaning.date_range(sales).count() == 5


def test_align_and_existing(sales):
    out = cleaning.align_to(sales, ["qty", "nothing", "amount"])
    assert out.columns == ["qty", "nothing", "amount"]
    assert {r.nothing for r in out.collect()} == {0}
    assert cleaning.keep_existing(sales, ["qty", "x"]) == ["qty"]


def test_numeric_columns_have_no_flags(sales):
    assert cleaning.numeric_columns(sales) == ["amount", "qty", "line_no", "supp"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", 1)], ["Design No.", "x y"])
    assert cleaning.drop_columns(df, ["x y", "none"]).columns == ["Design No."]
    assert cleaning.canonical_headers(df).columns == ["design_no", "x_y"]
    assert profiling.missing_by_column(df).count() == 2
    back = cleaning.with_original_headers(cleaning.canonical_headers(df), df.columns)
    assert back.columns == df.columns


def test_csv_missing_tokens(spark):
    path = new_path(spark, "tokens")
    rows = [(str(i), t) for i, t in enumerate(MISSING_TOKENS)] + [("99", "nano"), ("98", 'say "hi", you')]
    sinks.write_csv(spark.createDataFrame(rows, ["id", "value "]), path)
    back = {r["id"]: r["value "] for r in csv_tables.read_text_csv(spark, path).collect()}
    assert back.pop("99") == "nano" and back.pop("98") == 'say "hi", you'
    assert set(back.values()) == {None} and len(back) == len(MISSING_TOKENS)


def test_sales_export_is_compressed_and_joined_once(spark, tables):
    text = export_rows(tables)
    raw = tables.sales_raw
    twice = raw.where("line_no = 7").count()
    assert twice > 0 and text.count() == raw.count() + twice
    copies = text.groupBy(*text.columns).count().where("count > 1")
    assert {(r["line-no"], r["count"]) for r in copies.collect()} == {("7", 2)}
    # One scan of each table: the joins behind the sales are made once.
    assert text._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate") <= 3
    plain, small = new_path(spark, "plain"), new_path(spark, "small")
    sinks.write_csv(text, plain)
    sinks.write_csv(text, small, compression="snappy")
    one, two = (csv_tables.read_text_csv(spark, p) for p in (plain, small))
    assert one.columns == two.columns and one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    size = {p: sum(e[1] for e in file_state(spark, p)) for p in (plain, small)}
    assert size[small] < size[plain] / 2


def test_sales_are_cleaned_in_order(spark):
    header = ["Order ID", "Date ", "Amount", "Qty", "B2B", "index", "Unnamed: 22"]
    rows = [
        ("A", "04-30-22", "10", "1", "True", "0", "x"),
        ("A", "04-30-22", "10", "1", "True", "1", "y"),  # equal once the junk is gone
        ("A", "04-30-22", "10.0", "1", "True", "2", "z"),  # equal as a number, not as text
        ("B", "bad", "free", "one", "False", "3", None),  # unreadable amount stays
        ("C", "04-30-22", None, "1", "False", "4", None),  # no amount goes
    ]
    path = new_path(spark, "raw-sales")
    sinks.write_csv(spark.createDataFrame(rows, header), path)
    out = csv_tables.load_and_clean(spark, {"sales": path})["sales"]
    assert out.columns == ["order_id", "date", "amount", "qty", "b2b"]
    got = sorted(out.collect(), key=lambda r: (r.order_id, str(r.amount)))
    assert [(r.order_id, r.amount, r.qty, r.b2b) for r in got] == [
        ("A", 10.0, 1.0, True), ("A", 10.0, 1.0, True), ("B", None, None, False),
    ]
    assert got[2].date is None


def test_strict_coercion_fails(spark):
    import pytest

    df = spark.createDataFrame([("x",)], ["amount"])
    with pytest.raises(Exception, match="cannot read amount"):
        cleaning.require_clean(df, {"amount": "number"}).collect()


def test_register_with_limit(spark, sales):
    sinks.register_tables({"few_sales": sales}, limit=2)
    assert spark.table("few_sales").count() == 2


def test_only_reading_statements(spark):
    import pytest

    for text in ("DROP TABLE sales", "INSERT INTO a VALUES (1)", "WITH x AS (SELECT 1) INSERT INTO a SELECT * FROM x"):
        with pytest.raises(ValueError):
            sqllib.run_user_sql(spark, text)


def test_request_defaults_and_rules(spark):
    rows = [(13, 0, 0.5, "Nobody", None), (1, 100, 100000.0, "Merchant", "Expedited"), (None,) * 5]
    df = spark.createDataFrame(rows, "month int, qty int, amount double, fulfilment string, service_level string")
    got = [r.failures for r in scoring.with_failures(df).collect()]
    assert got == [["month", "qty", "amount", "fulfilment"], [], []]
    assert scoring.valid_requests(df).count() == 2
    filled = scoring.with_defaults(df).collect()[2]
    assert (filled.month, filled.qty, filled.amount, filled.category) == (6, 1, 500.0, "Set")


def test_stored_sales_read_only_the_wanted_months(spark, sales):
    path = new_path(spark, "stored")
    gaps = sales.withColumn("date", F.when(F.col("order_id") != "D4", F.col("date")))
    sinks.store_sales(gaps, path)
    stored = sinks.stored_sales(spark, path, sales.schema)
    assert stored.count() == 5
    some = cleaning.date_range(stored, "date", "2022-01-10", "2022-02-10")
    assert {r.order_id for r in some.collect()} == {"A1", "B2"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "period" in filters and "2022-01" in filters
