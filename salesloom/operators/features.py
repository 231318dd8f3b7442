"""Features of a sale for the cancellation models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions import ordered
from salesloom.functions.scalars import (
    guarded_ratio,
    is_cancelled,
    is_weekend,
    lookup,
    to_flag,
    weekday,
)

# Columns of a sales export that tell rows of one date apart, as far as it can.
TIEBREAK = ["order_id", "sku", "size", "qty", "amount", "status"]


def calendar_columns(df: DataFrame, column: str = "date") -> DataFrame:
    d = F.col(column)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "month_name": F.date_format(d, "MMMM"),
            "quarter": F.quarter(d),
            "day": F.dayofmonth(d),
        }
    )


def row_features(sales: DataFrame, high_value_from) -> DataFrame:
    """The features that need nothing but the row and one threshold."""
    d = F.col("date")
    return sales.withColumns(
        {
            "day_of_week": weekday(d),
            "is_weekend": is_weekend(d),
            "month": F.month(d),
            "price_per_unit": guarded_ratio(F.col("amount"), F.col("qty")),
            "has_promotion": F.col("promotion_ids").isNotNull().cast("int"),
            "is_high_value": to_flag(F.col("amount") > high_value_from),
            "cancelled": is_cancelled(F.col("status")).cast("int"),
        }
    )


def _tiebreak(sales: DataFrame, tiebreak: list[str] | None) -> list[str]:
    """The columns that order rows of one date: the given ones, or those of an export."""
    return [c for c in TIEBREAK if c in sales.columns] if tiebreak is None else tiebreak


def rolling_revenue(sales: DataFrame, tiebreak: list[str] | None = None) -> DataFrame:
    """Adds ``revenue_7d_ma``: mean amount of the last seven rows of the category."""
    order = ["date", *_tiebreak(sales, tiebreak)]
    return ordered.rolling_mean(sales, "category", order, "amount", "revenue_7d_ma", 7)


def engineer_features(sales: DataFrame, tiebreak: list[str] | None = None) -> DataFrame:
    """Sales with calendar, price, promotion, high-value, rolling and target columns.

    The input is written once, in ranges; the rolling mean and the exact upper
    quartile that marks a high value both read it from there.
    """
    order = ["date", *_tiebreak(sales, tiebreak)]
    ranged = ordered.in_order(sales, ["category"], [F.col(c).asc_nulls_last() for c in order])
    amounts = ranged.select(ordered.number("amount").alias("v0"))
    threshold = ordered.quantiles_of(amounts, ["amount"], [0.75])
    threshold = threshold.agg(F.max("quantile")).scalar()
    rolled = ordered.rolling_mean_of(ranged, "category", "amount", "revenue_7d_ma", 7)
    return row_features(rolled.drop(ordered.RANGE, ordered.PLACE), threshold)


def baseline_features(sales: DataFrame, keys: list[str]) -> DataFrame:
    """All-numeric features of the baseline model, categories as ordinal codes.

    ``keys`` are kept to tell rows apart.

    Missing values get fixed substitutes, a missing category is ``Unknown``.
    """
    named = sales.withColumn("category", F.coalesce("category", F.lit("Unknown")))
    codes = ordered.ordinal_codes(named, "category", "category_code")
    rows = named.join(codes, "category")
    return rows.select(
        *[c for c in keys if c in sales.columns],
        F.coalesce(F.col("qty"), F.lit(0)).cast("double").alias("qty"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.coalesce(F.month("date"), F.lit(1)).alias("month"),
        is_weekend(F.col("date")).alias("is_weekend"),
        F.col("b2b").cast("int").alias("b2b"),
        lookup(F.col("fulfilment"), {"Amazon": 1, "Merchant": 0}, 0).alias("fulfilment"),
        lookup(F.col("ship_service_level"), {"Expedited": 1, "Standard": 0}, 0).alias(
            "service_level"
        ),
        F.col("category_code").cast("int").alias("category"),
        is_cancelled(F.col("status")).cast("int").alias("is_cancelled"),
    )
