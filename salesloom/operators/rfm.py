"""Recency, frequency and monetary value per key, their ranks and segment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.ordered import average_ranks
from salesloom.functions.scalars import days_after, days_between, sum0
from salesloom.operators.kpis import with_share


def compute_rfm(
    sales: DataFrame, key: str = "order_id", positive_only: bool = True
) -> DataFrame:
    """One row per key: days since its last sale, number of sales, amount.

    Days count back from the day after the last sale of the whole table. Partial
    sums per task shrink a hot key before the shuffle on the key.
    """
    now = sales.agg(days_after(F.max("date"), 1)).scalar()
    rfm = (
        sales.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.max("date").alias("_last"),
            F.count(key).alias("frequency"),
            sum0(F.col("amount")).alias("monetary"),
        )
        .select(
            key,
            days_between(F.col("_last"), now).cast("int").alias("recency"),
            "frequency",
            "monetary",
        )
    )
    return rfm.where(F.col("monetary") > 0) if positive_only else rfm


def with_rfm_scores(rfm: DataFrame) -> DataFrame:
    """Tie-averaged ranks over all keys (recency counts down) and their sum."""
    ranked = average_ranks(
        rfm,
        {
            "r_rank": ("recency", False),
            "f_rank": ("frequency", True),
            "m_rank": ("monetary", True),
        },
    )
    score = sum(
        (F.coalesce(c, F.lit(0.0)) for c in ("f_rank", "m_rank")),
        F.coalesce("r_rank", F.lit(0.0)),
    )
    return ranked.withColumn("rfm_score", score)


def segment_profile(segmented: DataFrame, key: str = "order_id", digits: int = 1) -> DataFrame:
    """Size, mean recency, frequency and value, and revenue of each segment.

    The input has one row per key, so counting keys needs no distinct.
    """
    means = {
        f"avg_{c}": F.bround(F.avg(c), digits) for c in ("recency", "frequency", "monetary")
    }
    return (
        segmented.groupBy("segment_label")
        .agg(
            F.count(key).alias("customers"),
            *[v.alias(k) for k, v in means.items()],
            F.bround(F.sum("monetary"), digits).alias("total_revenue"),
        )
        .orderBy(F.col("avg_monetary").desc(), "segment_label")
    )


def segment_summary(segmented: DataFrame, key: str = "order_id") -> DataFrame:
    return segment_profile(segmented, key).drop("total_revenue")


def segment_revenue_share(segmented: DataFrame, key: str = "order_id") -> DataFrame:
    revenue = segmented.groupBy("segment_label").agg(
        F.count(key).alias("customers"), F.sum("monetary").alias("revenue")
    )
    return with_share(revenue, "revenue", "revenue_share").withColumn(
        "revenue_share", F.bround("revenue_share", 1)
    )
