"""A hot join key is split by adaptive execution, and the rows stay whole."""

import pytest
from pyspark.sql import functions as F

from salesloom.operators import enrich
from salesloom.workspace import stage

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_sku_is_split(spark, small_limits):
    sales = spark.range(0, 30_000, 1, 8).select(
        F.concat(F.lit("o"), "id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("sku"),
        F.lit("c").alias("category"),
        F.lit("m").alias("size"),
        (F.col("id") % 7).cast("double").alias("amount"),
    )
    stock = spark.range(0, 500).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("sku_code"),
        F.lit("d").alias("design_no"),
        F.col("id").cast("double").alias("stock"),
        F.lit("c").alias("category"),
        F.lit("m").alias("size"),
        F.lit("red").alias("color"),
    )
    joined = enrich.join_sku_stock(stage(sales, "hot-sales"), stage(stock, "hot-stock"))
    rows = joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    assert len(rows) == 30_000
    assert sum(r.sku_code == "hot" for r in rows) == 10_000
    # Article s0 has no stock row of its own.
    assert sum(r.sku_code is None for r in rows) == sum(r.sku == "s0" for r in rows)
